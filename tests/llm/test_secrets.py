"""Secret scan against Python's re and a direct entropy computation."""

import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tracehound.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 16]
    return sorted(out)


def texts():
    rng = random.Random(5)
    parts = ["password=", "TOKEN: ", "secret : ", "Api_Key='", 'apikey":"', "passwd=\"", "token:secret=abcdefghijklmnop", "token: secret: abcdefghijklmnop", "AKIA", "AKIAAKIA" + "Z" * 12, "AKIA" + "0" * 14, "é漢\U0001f600",
             "deadbeefdeadbeef", "0123456789abcde", "abcdef0123456789f", "\n", " ", "words here ", "x", "_", "Zm9vYmFyYmF6cXV4MTIzNDU2Nzg5MHF3ZXJ0eQ", "q7Gh2kLp9XzR4tVb8NmW1sYc", "A" * 30 + "1"]
    out = [None, "", " ", "password=short", "password=" + "a1" * 200] + ["".join(rng.choice(parts) for _ in range(rng.choice([2, 6, 40]))) for _ in range(150)]
    return out + ["token=abcdefghijkl, " * 3000]


def test_base_spans(spark):
    data = texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(data)] + [(None, data[4], "x")], "doc_id long, text string, spans string").repartition(4)
    got = secrets.secret_report(docs).collect()
    assert len(got) == len(data) + 1
    for r in got:
        want = base((data[4] if r.doc_id is None else data[r.doc_id]) or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in want) for n in range(3))
        line = [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(line).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if not x.startswith("entropy") and x] == line


def test_window_entropy(spark):
    rng = random.Random(2)
    data = ["".join(rng.choice("abcd0123456789XYZ") for _ in range(rng.randint(20, 90))) for _ in range(60)] + ["a" * 25]

    def want(s):
        h = lambda w: -sum(c / 20 * math.log2(c / 20) for c in Counter(w).values())
        return max(h(s[i : i + 20]) for i in range(len(s) - 19))

    got = spark.createDataFrame([(s,) for s in data], "s string").select("s", secrets.window_entropy(F.col("s")).alias("h")).collect()
    assert all(abs(r.h - want(r.s)) < 1e-9 for r in got)


def test_entropy_spans_and_allowed(spark):
    data = ["key q7Gh2kLp9XzR4tVb8NmW1sYc end", "id 123e4567-e89b-12d3-a456-426614174000 end", "retitioningandthehablebleening", "see /usr/share/doc/package2 now", "EXAMPLEq7Gh2kLp9XzR4tVb8NmW1sYc"]
    docs = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.secret_report(docs).collect()}
    assert got == {0: "entropy:4:28", 1: "", 2: "", 3: "", 4: ""}


def test_redaction(spark):
    data = [None, "", "a token=abcdefghijkl b deadbeefdeadbeef0 c", "token=deadbeefdeadbeef0", "é password: 0123456789abcdef01 é", "clean"]
    docs = spark.createDataFrame([(i, t, 5, "k") for i, t in enumerate(data)], "doc_id long, text string, n_chars long, base string")
    got = sorted(map(tuple, secrets.redact(docs).collect()))
    assert secrets.redact(docs).columns == docs.columns
    assert [r[1] for r in got] == [None, "", "a [SECRET] b [SECRET] c", "[SECRET]", "é [SECRET] é", "clean"]
    assert [r[2] for r in got] == [5, 5, 23, 8, 12, 5] and got[2][3] == "k"


def test_short_candidates_and_names(spark):
    data = ["see Zk9QmT4xLw2RbV7n here", "test_key=q7Gh2kLp9XzR4tVb8NmW1sYc", "sample/q7Gh2kLp9XzR4tVb8NmW1sYc", "my_example_name_of_2024", "xyz1xyz1xyz1xyz1xyz1", "zzzzzzzzzzzzzzzz1"]
    docs = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.secret_report(docs).collect()}
    assert got == {0: "entropy:4:20", 1: "entropy:9:33", 2: "entropy:0:31", 3: "", 4: "", 5: ""}


def test_running(spark):
    data = [[], [3], list(range(200)), [5, 1, 9, 2] * 100]
    c = F.col("a")
    got = spark.createDataFrame([(x,) for x in data], "a array<int>").select("a", secrets.running(c, F.lit(0), lambda s, x: s + x).alias("s"), secrets.running(c, F.lit(0), F.greatest).alias("m")).collect()
    for r in got:
        assert r.s == [sum(r.a[: i + 1]) for i in range(len(r.a))] and r.m == [max(r.a[: i + 1]) for i in range(len(r.a))]


def test_random_spans_are_cut_right(spark):
    rng = random.Random(8)
    parts = ["password=abcdefghijkl", "deadbeefdeadbeef0", "q7Gh2kLp9XzR4tVb8NmW1sYc", " é漢\U0001f600 ", "w " * 3000, "\n", "token=deadbeefdeadbeef0q7Gh2kLp9XzR4tVb8NmW1sYc/"]
    data = ["".join(rng.choice(parts) for _ in range(12)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    where = {r.doc_id: [(x.start, x.end) for x in r.spans] for r in secrets.find_secrets(docs).collect()}
    for r in secrets.redact(docs).collect():
        out, at = "", 0
        for a, e in where[r.doc_id]:
            if a >= at:
                out += data[r.doc_id][at:a] + "[SECRET]"
            at = max(at, e)
        assert r.text == out + data[r.doc_id][at:]


def test_long_texts(spark):
    """A run of millions of token characters, and many spans: neither may cost its square."""
    rng = random.Random(1)
    run = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(2_000_000))
    data = [run, "token=abcdefghijkl, q7Gh2kLp9XzR4tVb8NmW1sYc " * 20_000, "a1/" * 200_000]
    docs = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.spans for r in secrets.secret_report(docs).collect()}
    assert got[0] == f"entropy:0:{len(run)}" and got[1].count("assign:") == got[1].count("entropy:") == 20_000 and got[2] == ""
    assert {r.doc_id: r.text for r in secrets.redact(docs).collect()} == {0: "[SECRET]", 1: "[SECRET], [SECRET] " * 20_000, 2: data[2]}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert secrets.secret_report(docs).count() == 0 and secrets.redact(docs).columns == docs.columns and secrets.redact(docs).count() == 0
