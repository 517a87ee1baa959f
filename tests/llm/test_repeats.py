"""Repeat removal against a brute-force search of all strings."""

import hashlib
import random
from collections import Counter

import pytest

from tracehound.llm import repeats


def brute(texts, width):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + width] for b in data for i in range(len(b) - width + 1))
    out = []
    for b in data:
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        left = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(left).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(70), prose(200)
    out = [None, "", "short", base, base, "x" * 700, "x" * 199, "ab" * 300, prose(30) + base[:250], base[100:420] + prose(20)]
    for _ in range(25):
        t = base.split(" ")
        for _ in range(rng.choice([1, 2, 6])):
            t[rng.randrange(len(t))] = word()
        out.append(" ".join(t))
        out.append(prose(rng.randint(5, 60)) + " " + passage + " " + prose(rng.randint(5, 60)))
        out.append(prose(rng.randint(1, 150)))
    return out


@pytest.mark.parametrize("segment", [1 << 20, 700])
def test_against_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    texts = corpus(segment)
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes long").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 200)


def test_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BROADCAST_KEYS", 0)
    texts = corpus(9)[:40]
    rows = [(None if i % 7 == 0 else i // 2, t) for i, t in enumerate(texts)] + [(0, texts[3]), (0, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = repeats.remove_repeats(docs).collect()
    want = brute([t for _, t in rows], 200)
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=key) == sorted(((d, *w) for (d, _), w in zip(rows, want)), key=key)


def test_empty(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
