"""The SQL of the corpus queries against the queries, on small tables with nulls, copies and odd texts."""

import random

import pytest

duckdb = pytest.importorskip("duckdb")

from tracehound.llm import queries  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(300)] + ["É", "漢字", "a#", "<b>", "\U0001f600"]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    line = "notice for all of our many readers of this site"
    secrets = ["password=abcdefghijkl99", "AKIA" + "Z9" * 8, "deadbeefdeadbeef01", "q7Gh2kLp9XzR4tVb8NmW1sYc", "test_key=q7Gh2kLp9XzR4tVb8NmW1sYc", "usr/share/doc/package2", "xyz1xyz1xyz1xyz1xyz1"]
    texts = [None, "", " \n\t ", "one", "One two", "one  TWO", "a b c", "word " * 100, "x" * 450, "\n\n".join([line] * 3)]
    base = prose(150)
    for k in range(80):
        own = prose(rng.choice([4, 40, 200]))
        near = base.split()
        near[rng.randrange(150)] = f"new{k}"
        texts.append(rng.choice([own, f"{own} {rng.choice(secrets)} {prose(5)}", " ".join(near), f"{line}\n\n{own}", f"{own}\n{base[:300]}", base]))
    docs = [(k, t, None if k % 17 == 0 else f"s{k % 2}") for k, t in enumerate(texts)]
    talk = [(c, t, rng.choice(["system", "user", "assistant", None]) if t else "system", rng.choice([None, "", f"text {c} {t} " * rng.choice([1, 400]), "\\# <x> </turn> ### a:"])) for c in range(12) for t in range(rng.choice([1, 5, 40]))]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{out}/conversations.parquet")
    return str(out)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_equals_query(spark, folder, name):
    db = duckdb.connect()
    for table in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    result = db.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    want = sorted(map(str, result.fetchall()))
    got = queries.QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == want
