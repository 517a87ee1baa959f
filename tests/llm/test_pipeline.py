"""The pipeline against its parts' brute-force versions on a small corpus."""

import random

import public_tokenizers as P
import pytest
import tiktoken

from tracehound.llm import byte_bpe

line = pytest.importorskip("corpus_pipeline")


def test_run(spark, tmp_path):
    rng = random.Random(9)
    prose = lambda n: " ".join(f"v{rng.randrange(5000)}" for _ in range(n))
    item = prose(30)
    good = [prose(120) for _ in range(20)]
    near = good[0].split()
    near[60] = "changed"
    rows = [(i, t) for i, t in enumerate(good)]
    rows += [(20, good[1]), (21, " ".join(near)), (22, f"{prose(50)} {item} {prose(9)}"), (23, None), (24, "too short"), (25, "again " * 60), (26, f"{prose(40)} password=abcdefghijkl99 {prose(5)}")]
    docs = [(i, t, "en", f"s{i % 2}", len(t) if t else None, "mine") for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, comp string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {i: t for i, t in rows if i < 20 or i == 26}
    want[26] = want[26].replace("password=abcdefghijkl99", "[SECRET]")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: r.ids for r in line.run(spark, str(tmp_path)).collect()}
    assert got == {i: enc.encode_ordinary(t) for i, t in want.items()}
    kept, n = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in line.STAGES[:-1]:
        columns = kept.columns
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == columns
        n.append(kept.count())
    assert n == [24, 22, 21, 21] and all(r.n_chars == len(r.text) for r in kept.collect())
    empty = spark.createDataFrame([], kept.schema)
    for _, stage in line.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
