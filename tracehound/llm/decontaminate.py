"""Benchmark decontamination: every passage of every document asks a BM25 index of the test items.

Scores are shares of an item's score for its own text. Items lie in blocks; a block's bound for a
passage sums the largest share of each term in it. A term is essential for an item if the cheaper
terms together stay below the threshold, so a block is only looked at when the passage holds an
essential term of one of its items and the block's bound reaches the threshold. What is retrieved
is then verified: words and three-word pieces of the item's question and answer must be there.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, row_key, written

K1, B = 1.2, 0.75
BLOCK = 16
#: Trimmed from words: ASCII punctuation, and quotation marks and dashes of other scripts.
PUNCTUATION = string.punctuation + "\u00a1\u00ab\u00bb\u00bf\u2013\u2014\u2018\u2019\u201a\u201c\u201d\u201e\u2026"
#: Bytes of item texts that one index may hold; a larger benchmark is searched in several passes.
INDEX_BYTES = 32_000_000


@dataclass(frozen=True)
class Limits:
    #: Least share of an item's own BM25 score.
    score: float = 0.6
    #: Least share of words of the question and of the answer, and of their three-word pieces.
    overlap: float = 0.8
    pieces: float = 0.5
    #: Shorter items are ordinary phrases; they must occur word for word, and those below least are left out.
    short: int = 8
    least: int = 4


def normal(words):
    return pc.utf8_lower(pc.utf8_trim(words, PUNCTUATION))


def item_words(text: str | None) -> list[str]:
    return [w for w in normal(pa.array((text or "").split() or [""], pa.string())).to_pylist() if w]


def answer_start(text: str) -> int:
    """Words before the answer: the last sentence, or the last third of a single one."""
    parts = re.split(r"(?<=[.!?])\s+", text.strip())
    n, tail = len(item_words(text)), len(item_words(parts[-1]))
    return n - tail if len(parts) > 1 and 0 < tail < n else n - max(1, n // 3)


class Index:
    """Items of one length class. ids, texts: the items; df, total, mean: statistics of all items."""

    def __init__(self, items: list[tuple], df: dict[str, int], total: int, mean: float, limits: Limits):
        self.limits = limits
        self.items = [(i, w, answer_start(t)) for i, t, w in sorted(items, key=lambda x: (len(x[2]), str(x[0])))]
        self.vocab: dict[str, int] = {}
        self.words = [[self.vocab.setdefault(x, len(self.vocab)) for x in w] for _, w, _ in self.items]
        self.span = max(32, math.ceil(1.25 * max(map(len, self.words))))  # passages are twice as long and begin every span words
        names = list(self.vocab)
        idf = np.array([math.log(1 + (total - df[x] + 0.5) / (df[x] + 0.5)) for x in names])
        rows = []
        for k, w in enumerate(self.words):
            tf = Counter(w)
            raw = {t: idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(w) / mean)) for t, n in tf.items()}
            own, below = sum(raw.values()), 0.0
            for t, x in sorted(raw.items(), key=lambda p: (p[1], p[0])):
                below += x / own
                rows.append((t, k, x / own, below >= limits.score - 1e-9))
        rows.sort()
        t, k, share, needed = (np.array(c) for c in zip(*rows))
        self.post = self._lists(t, k, share)
        key = t * (len(self.items) // BLOCK + 1) + k // BLOCK
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.blocks = self._lists(t[first], (k // BLOCK)[first], np.maximum.reduceat(share, first), np.logical_or.reduceat(needed, first))
        self.essential = np.zeros(len(names) + 1, bool)
        self.essential[t[needed]] = True
        self.names = pa.array(names, pa.string())

    def _lists(self, term, *cols):
        start = np.searchsorted(term, np.arange(len(self.vocab) + 1))
        return start, cols

    @staticmethod
    def _expand(lists, terms):
        """For each term the rows of its list: index into terms, and the columns."""
        start, cols = lists
        n = start[terms + 1] - start[terms]
        which = np.repeat(np.arange(len(terms)), n)
        at = np.repeat(start[terms] - (np.cumsum(n) - n), n) + np.arange(len(which))
        return which, [c[at] for c in cols]

    def search(self, codes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(text, item, first word of the passage, share) of all passages and items that reach the threshold.

        codes: term of each word of all texts, -1 for words that no item has; bounds: the texts' ends.
        """
        n = np.diff(bounds)
        places = n // self.span + 2
        base = np.cumsum(places) - places
        hit = np.flatnonzero(codes >= 0)
        if not len(hit):
            return
        text = np.searchsorted(bounds, hit, "right") - 1
        late = base[text] + (hit - bounds[text]) // self.span + 1  # the passage that begins in the word's own stretch
        wanted = np.zeros(int(places.sum()) + 1, bool)
        strong = self.essential[codes[hit]]
        wanted[late[strong]] = wanted[late[strong] - 1] = True
        size = len(self.vocab)
        pairs = np.unique(np.concatenate([p[wanted[p]] * size + codes[hit][wanted[p]] for p in (late, late - 1)]))
        passage, term = pairs // size, pairs % size
        which, (block, bound, needed) = self._expand(self.blocks, term)
        key = passage[which] * (len(self.items) // BLOCK + 1) + block
        keys, inverse = np.unique(key, return_inverse=True)
        enough = (np.bincount(inverse, bound) >= self.limits.score - 1e-9) & (np.bincount(inverse, needed) > 0)
        keys = keys[enough]
        if not len(keys):
            return
        inside = np.isin(passage, np.unique(keys // (len(self.items) // BLOCK + 1)))
        passage, term = passage[inside], term[inside]
        which, (item, share) = self._expand(self.post, term)
        open_ = np.isin(passage[which] * (len(self.items) // BLOCK + 1) + item // BLOCK, keys)
        pairs, inverse = np.unique(passage[which][open_] * len(self.items) + item[open_], return_inverse=True)
        scores = np.bincount(inverse, share[open_])
        for pair, score in zip(pairs[scores >= self.limits.score - 1e-9], scores[scores >= self.limits.score - 1e-9]):
            p, k = divmod(int(pair), len(self.items))
            d = int(np.searchsorted(base, p, "right")) - 1
            yield d, k, max(0, (p - int(base[d]) - 1) * self.span), float(score)

    def verify(self, k: int, passage: np.ndarray) -> tuple[float, float] | None:
        """Shares of the question's and the answer's words in the passage, if they and their pieces suffice."""
        words, cut = self.words[k], self.items[k][2]
        held = passage.tolist()
        if len(words) < self.limits.short:
            n = len(words)
            return (1.0, 1.0) if any(held[i : i + n] == words for i in range(len(held) - n + 1)) else None
        there = Counter(held)
        out = []
        for part in (words[:cut], words[cut:]):
            want = Counter(part)
            out.append(sum(min(c, there[t]) for t, c in want.items()) / max(1, len(part)))
        runs = lambda w: Counter(zip(w, w[1:], w[2:]))
        want, have = runs(words), runs(held)
        pieces = sum(min(c, have[t]) for t, c in want.items()) / (len(words) - 2)
        return (out[0], out[1]) if min(out) >= self.limits.overlap and pieces >= self.limits.pieces else None


def _indexes(items: DataFrame, limits: Limits) -> Iterator[list[Index]]:
    """Indexes by length class for each part of the benchmark that fits INDEX_BYTES."""
    rows = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, w, len(x)) for i, x in zip(b.column(0).to_pylist(), map(item_words, b.column(1).to_pylist())) for w in dict.fromkeys(x)]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64()))], ["part", "term", "n"])

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // INDEX_BYTES)
    slot = F.pmod(F.xxhash64("text"), F.lit(max(1, parts))).cast("long")
    rows = rows.withColumn("part", slot)
    found = written(rows.select("part", "text").mapInArrow(terms, "part long, term string, n long"), "terms")
    df = written(found.groupBy("term").agg(F.count("*").alias("df")), "df")
    for p in range(parts):
        own = [(r.item_id, r.text, w) for r in rows.where(F.col("part") == p).distinct().collect() if len(w := item_words(r.text)) >= limits.least]  # INDEX_BYTES at most
        if not own:
            continue
        stats = {r["term"]: r["df"] for r in df.join(found.where(F.col("part") == p).select("term").distinct(), "term").collect()}
        total, mean = max(len(own), rows.count()), max(1.0, float(np.mean([len(w) for _, _, w in own])))
        classes: dict[int, list] = {}
        for x in own:
            classes.setdefault(max(6, len(x[2]).bit_length()), []).append(x)
        yield [Index(c, stats, total, mean, limits) for _, c in sorted(classes.items())]


def find_leaks(docs: DataFrame, items: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, key, item_id, start, score, question, answer: items that documents hold, once a pair.

    docs: doc_id, text; items: item_id, text. start is the first word of the best passage. Null and
    empty texts hold nothing; items of fewer than limits.least words are left out. Whole texts are
    searched; items with equal text are all reported.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, key long, item_id long, start long, score double, question double, answer double"
    out = None
    for indexes in _indexes(items, limits):
        shared = spark.sparkContext.broadcast(indexes)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = pc.ascii_split_whitespace(b.column(2))
                bounds = np.asarray(lists.offsets).astype(np.int64)
                bounds -= bounds[0]
                coded = lists.flatten().dictionary_encode()
                codes, words = np.asarray(coded.indices), normal(coded.dictionary)
                real = np.asarray(pc.greater(pc.binary_length(words), 0).fill_null(False)) if len(words) else np.zeros(0, bool)
                keep = real[codes]
                bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
                codes = codes[keep]
                best: dict[tuple[int, object], tuple] = {}
                for index in shared.value:
                    own = np.asarray(pc.index_in(words, index.names).fill_null(-1)).astype(np.int64)[codes]
                    for d, k, start, score in index.search(own, bounds):
                        got = index.verify(k, own[bounds[d] + start : min(bounds[d + 1], bounds[d] + start + 2 * index.span)])
                        item = index.items[k][0]
                        if got and (score, -start) > best.get((d, item), (-1, 0))[:2]:
                            best[d, item] = (score, -start, *got)
                ids, keys = b.column(0), b.column(1)
                at = pa.array([d for d, _ in best], pa.int64())
                cols = [ids.take(at), keys.take(at), pa.array([i for _, i in best], pa.int64()), pa.array([-v[1] for v in best.values()], pa.int64()), *(pa.array([v[j] for v in best.values()], pa.float64()) for j in (0, 2, 3))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "key", "item_id", "start", "score", "question", "answer"])

        found = rows.mapInArrow(scan, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def without_leaks(docs: DataFrame, items: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Rows of docs that hold no item; the columns of docs."""
    bad = written(find_leaks(docs, items, limits).select(F.col("doc_id").alias("_th_d"), F.col("key").alias("_th_k")).distinct(), "leaks")
    small = F.broadcast(bad) if bad.count() <= 1_000_000 else bad
    rows = docs.withColumn("_th_key", row_key())
    left = rows.join(small, F.col("doc_id").cast("long").eqNullSafe(F.col("_th_d")) & (F.col("_th_key") == F.col("_th_k")), "left_anti")
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))
