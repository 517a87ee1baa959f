"""Quality rules against plain Python."""

import random
import re
from collections import Counter

from tracehound.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(grams)
    inside = set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            inside |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), failed


def rows():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(30)] + ["a#", "<b>", "é", " x", " "]
    out = [(0, None), (1, ""), (2, " \n\t \n"), (3, "one two three four five"), (4, "a b c d e a b c d e"), (5, "x " * 300), (6, "only\x00nul \x1c sep")]
    for i in range(7, 160):
        n = rng.choice([3, 12, 60, 400])
        out.append((i, "".join(rng.choice(vocab) + rng.choice([" ", " ", "\n", "\t", "  ", "\r\n"]) for _ in range(n))))
    return out + [(8, out[8][1]), (None, "null id " * 3), (None, "plain words " + " ".join(f"q{i}" for i in range(30)))]


def test_base_statistics(spark):
    data = rows()
    docs = spark.createDataFrame([(d, t, "s", 1) for d, t in data], "doc_id long, text string, source string, n_words int").repartition(4)
    got = quality.judge(docs, quality.Rules(line_docs=1000)).drop("key").collect()
    assert len(got) == len(data)
    assert sorted((str(r[0]), *r[1:7]) for r in got) == sorted((str(d), *base(t)) for d, t in data)
    assert all(r.kept == (not r.base_failed) for r in got)  # no line is frequent


def test_frequent_lines_and_depletion(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(20))
    data = [(i, f"Cookie Notice for all of our many readers of this here site\n{body(i)}", "h") for i in range(40)]
    data += [(100 + i, f"cookie notice for all of our many readers of this here site  \nshort{i} tail", "h") for i in range(5)]
    data += [(200, "cookie notice for all of our many readers of this here site\nshort one", "other"), (201, None, None), (202, data[0][1], "h")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    kept = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert all(kept[i] for i in range(40)) and not any(kept[100 + i] for i in range(5)) and kept[200] and kept[202] and not kept[201]
    clean = {r.doc_id: r.text for r in quality.clean(docs).collect()}
    assert set(clean) == {k for k, v in kept.items() if v} and clean[3] == body(3) and clean[200] == data[45][1]
    joined = quality.judge(docs, quality.Rules(broadcast_lines=0)).collect()
    assert {r.doc_id: r.kept for r in joined} == kept


def test_copies_count_once(spark):
    text = "\n".join(" ".join(f"l{j}k{k}" for k in range(9)) for j in range(5))
    docs = spark.createDataFrame([(i, text, "h") for i in range(60)], "doc_id long, text string, source string")
    assert all(r.kept for r in quality.judge(docs).collect())


def test_line_limit_is_the_same_in_large_hosts(spark):
    line = "notice for all of our many readers of this site"
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(20))
    data = [(i, f"{line}\n{body(i)}" if i < 45 else f"rare line\n{body(i)}" if i < 80 else body(i), "h") for i in range(2000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    clean = {r.doc_id: r.text for r in quality.clean(docs).collect()}
    assert len(clean) == 2000 and all(clean[i] == (body(i) if i < 45 else data[i][1]) for i in clean)


def test_paragraph_breaks_stay(spark):
    data = [(i, f"first part {i} " + " ".join(f"w{i}x{k}" for k in range(12)) + f"\n\n \nsecond part {i}", "h") for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    assert sorted(map(tuple, quality.clean(docs).collect())) == data and all(r.kept for r in quality.judge(docs).collect())


def test_repeated_rows_with_frequent_lines(spark):
    line = "notice for all of our many readers of this site"
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(20))
    data = [(i, f"{line}\n{body(i)}", "h") for i in range(45)]
    data += [data[3]] * 4 + [(3, data[3][1], "other")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    assert [r.kept for r in quality.judge(docs).collect()] == [True] * 50
    got = [tuple(r) for r in quality.clean(docs).collect()]
    assert got.count((3, body(3), "h")) == 5 and got.count((3, data[3][1], "other")) == 1 and len(got) == 50


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, n_chars long")
    assert quality.judge(docs).count() == 0 and quality.clean(docs).columns == docs.columns
