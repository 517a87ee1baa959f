"""Jaccard join against a comparison of all pairs."""

import random
import re

import numpy as np
import pytest

from tracehound.llm import jaccard


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    out = [None, "", " \t", "One", "one", "one  TWO", "One two", "a b c", "A B\nC", "É b c", "é b c", "x " * 50, "x " * 80]
    line = prose(30)
    for n in (12, 40, 120, 300):
        base = prose(n)
        for _ in range(18):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            if rng.random() < 0.3:
                t = t[: int(len(t) * rng.uniform(0.85, 1))]
            out.append(" ".join(t))
        out += [" ".join(prose(n)) for _ in range(8)] + [" ".join(line + prose(n // 6)) for _ in range(6)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_against_all_pairs(spark, size, percent):
    rows = [(i + 5, t) for i, t in enumerate(corpus(size))]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, comp long").repartition(5)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs, size, percent).collect())
    want = brute(rows, size, percent)
    assert got == want
    keep = jaccard.keep_one(docs, size, percent)
    assert keep.columns == docs.columns and sorted(r.doc_id for r in keep.collect()) == sorted(d for d, _, c in want if c == d)


def test_repeated_ids(spark):
    texts = corpus(8)[:50]
    rows = [(None if i % 9 == 0 else i // 2, t) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], rows[9]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: tuple(map(str, r))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs, 3, 90).collect()), key=key)
    assert got == sorted(brute(rows, 3, 90), key=key)


def test_folded_parities():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**64, n, np.uint64)) for n in (0, 1, 5, 90, 3000)]
    sets += [np.unique(np.concatenate([s[::2], rng.integers(0, 2**64, 4, np.uint64)])) for s in sets]
    bits = jaccard.folded(sets)
    for i, s in enumerate(sets):
        for j, t in enumerate(sets):
            differ = sum(int(x).bit_count() for x in (bits[i] ^ bits[j]).view(np.uint64))
            assert differ <= len(np.setxor1d(s, t))
    assert jaccard.folded([]).shape == (0, 2)
    wide = jaccard.folded(sets, jaccard.WIDE).view(np.uint64)
    for i, s in enumerate(sets):
        for j, t in enumerate(sets):
            assert np.bitwise_count(wide[i] ^ wide[j]).sum() <= len(np.setxor1d(s, t))


@pytest.mark.parametrize("few", [1, 2, 10**6])
def test_short_and_long_lists(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard, "FEW", few)
    rows = [(i, t) for i, t in enumerate(corpus(11))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect())
    assert got == brute(rows, 3, 90)


@pytest.mark.parametrize("block", [1 << 20, 1 << 16])
def test_near_copies_below_the_limit(spark, monkeypatch, block):
    """A large group whose members mostly don't link is compared without rows for its pairs."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(900)]
    rows = []
    for i in range(160):
        t = list(base)
        for k in range(rng.choice([5, 10, 11, 12, 13, 14, 15])):
            t[rng.randrange(len(t))] = f"new{i}.{k}"
        rows.append((i, " ".join(t)))
    made, written = [], jaccard.written

    def counted(df, tag):
        out = written(df, tag)
        if tag in ("pairs", "groups", "links"):
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect())
    assert got == brute(rows, 3, 90) and 10 < len({c for _, _, c in got}) < len(rows)
    if block == 1 << 20:  # many small cells give more of the links
        assert max(made) <= 4 * len(rows)  # 12,600 pairs otherwise


def test_keep_one_of_near_copies_below_the_limit(spark, monkeypatch):
    """As the pipeline calls it: five words, 80 per cent."""
    rng = random.Random(4)
    rows = []
    for i in range(120):
        t = [f"w{k}" for k in range(900)]
        for k in range(rng.choice([5, 12, 14, 15, 16, 17, 18])):
            t[rng.randrange(len(t))] = f"new{i}.{k}"
        rows.append((i, " ".join(t)))
    made, written = [], jaccard.written

    def counted(df, tag):
        out = written(df, tag)
        if tag in ("pairs", "groups", "links"):
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    keep = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in keep.collect()) == [d for d, _, c in brute(rows, 5, 80) if c == d]
    assert max(made) <= 8 * len(rows)


@pytest.mark.parametrize("repeated", [False, True])
def test_links_against_all_pairs(spark, monkeypatch, repeated):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    base = [f"b{k}" for k in range(200)]
    texts = [None, "", "one two", "One two", "alone " * 3] + [" ".join([*base[:i], f"new{i}", *base[i + 1 :]]) for i in range(0, 200, 7)] + [" ".join(base)] * 5
    rows = list(enumerate(texts)) + [(0, texts[-1])] * 2 * repeated
    sets = {r: shingles(r[1], 3) for r in rows}
    want = {r: sum(q != r and bool(s & t) and 100 * len(s & t) >= 90 * len(s | t) for q, t in sets.items()) for r, s in sets.items()}
    got = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sorted((r.doc_id, r.n_links) for r in got) == sorted((r[0], want[r]) for r in rows) and max(want.values()) >= 30


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.similar_groups(docs).count() == 0 and jaccard.keep_one(docs).count() == 0
