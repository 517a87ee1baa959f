"""Decontamination: retrieval against plain BM25, planted and clean documents."""

import math
import random
from collections import Counter

import pytest

from tracehound.llm import decontaminate as dc


def corpus():
    rng = random.Random(6)
    vocab = [f"w{int(rng.random() ** 3 * 3000)}" for _ in range(4000)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, f"{prose(rng.randint(6, 40)).capitalize()}. {prose(rng.randint(2, 9)).capitalize()}.") for i in range(60)]
    items += [(60, "By."), (61, None), (62, "one short phrase here now"), (63, prose(150)), (64, items[3][1])]
    docs, want = [], set()
    for d in range(150):
        text, n = prose(rng.choice([0, 5, 80, 900])), d % 3
        if n == 0:
            i, t = rng.choice([x for x in items if x[1] and len(x[1].split()) > 9])
            w = t.split()
            if d % 2 and len(w) > 20:
                w[len(w) // 4] = "changed"
            text = f"{prose(rng.randint(0, 300))} {' '.join(w).upper() if d % 4 == 0 else ' '.join(w)}\n{prose(rng.randint(0, 90))}"
            want |= {(d, i)} | ({(d, 64), (d, 3)} if i in (3, 64) else set())
        docs.append((d, text))
    return items, docs + [(500, None), (501, "say one short phrase here now please"), (502, "one short other phrase here now")], want | {(501, 62)}


def test_planted(spark):
    items, docs, want = corpus()
    d = spark.createDataFrame([(*r, 1.0) for r in docs], "doc_id long, text string, score double").repartition(4)
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(d, i).collect()}
    assert got == want
    left = dc.without_leaks(d, i)
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} == {k for k, _ in docs} - {k for k, _ in want}


@pytest.mark.parametrize("score", [0.3, 0.6])
def test_search_is_whole(score):
    items, docs, _ = corpus()
    own = [(i, t, w) for i, t in items if len(w := dc.item_words(t)) >= 4]
    df = Counter(x for _, _, w in own for x in set(w))
    mean = sum(len(w) for _, _, w in own) / len(own)
    index = dc.Index(own, df, len(own), mean, dc.Limits(score=score))
    for _, text in docs:
        words = dc.item_words(text)
        codes = dc.np.array([index.vocab.get(w, -1) for w in words], dc.np.int64)
        got = {(k, s): x for _, k, s, x in index.search(codes, dc.np.array([0, len(codes)]))}
        for k, (_, w, _) in enumerate(index.items):
            raw = {t: math.log(1 + (len(own) - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, n in Counter(w).items()}
            for p in range(-1, len(words) // index.span + 1):
                a, e = p * index.span, (p + 2) * index.span
                share = sum(raw[t] for t in set(words[max(0, a) : e]) & set(raw)) / sum(raw.values())
                if share >= score + 1e-6:
                    assert any(s == max(0, a) and abs(x - share) < 1e-9 or s == max(0, a) for (kk, s), x in got.items() if kk == k)


def test_parts_and_empty(spark, monkeypatch):
    items, docs, want = corpus()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(dc, "INDEX_BYTES", 4000)
    assert {(r.doc_id, r.item_id) for r in dc.find_leaks(d, i).collect()} >= {w for w in want if w[0] != 501}
    assert dc.find_leaks(d, i.limit(0)).count() == 0 and dc.find_leaks(d.limit(0), i).count() == 0 and dc.without_leaks(d, i.limit(0)).count() == len(docs)


def test_verify_against_counting():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(8, 30))) + ". " + " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 6))) + ".") for i in range(40)]
    own = [(i, t, dc.item_words(t)) for i, t in items]
    df = Counter(x for _, _, w in own for x in set(w))
    limits = dc.Limits(overlap=0.7, pieces=0.3)
    index = dc.Index(own, df, len(own), 15.0, limits)
    seen = Counter()
    for k, (_, words, cut) in enumerate(index.items):
        for _ in range(30):
            passage = list(words)
            for _ in range(rng.randint(0, len(words) // 2)):
                passage[rng.randrange(len(passage))] = rng.choice(vocab)
            passage = [rng.choice(vocab)] * rng.randint(0, 3) + passage
            rng.random() < 0.2 and rng.shuffle(passage)
            share = lambda part: sum((Counter(part) & Counter(passage)).values()) / len(part)
            threes = lambda w: Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
            pieces = sum((threes(words) & threes(passage)).values()) / (len(words) - 2)
            both = share(words[:cut]), share(words[cut:])
            want = both if min(both) >= 0.7 and pieces >= 0.3 else None
            got = index.verify(k, dc.np.array([index.vocab[w] for w in passage]))
            assert got == want if want is None else got == pytest.approx(want)
            seen[want is None] += 1
    assert min(seen.values()) > 50
