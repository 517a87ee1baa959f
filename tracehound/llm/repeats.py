"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Two suffixes belong together when their first `width` bytes agree; their order beyond, and among
groups, doesn't matter. The key of a suffix is therefore split into digits, each pass deals the
suffixes that are still in doubt by the next digit, and a group of one leaves at once:

1. The first digit is the key's least `gram`-byte piece (by a hash, leftmost of equals): equal keys
   have it in the same place. Neighbouring suffixes share it, so a run of suffixes is one row.
2. The second digit is the run's whole text. Equal runs are repeated in full.
3. Runs that share the first digit with a different run are cut into sections of up to `step`
   suffixes, aligned at the piece. A section's union text seen twice: all its suffixes repeat; its
   core text (what all suffixes of such a section share) seen once: none does.
4. Sections still in doubt are dealt by the complete key of each suffix.

Counts are summed in each task before a shuffle, so a string in a third of all documents stays
harmless; positions come back by joins that Spark can split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, released, uid_of, written

WIDTH, GRAM, STEP = 200, 32, 16
#: Suffixes handled at once; bounds a worker's memory for texts of any length.
SEGMENT = 1 << 19
#: Row keys are sent to every task up to this many, joined beyond.
BROADCAST_KEYS = 1_000_000

_INDEX = np.uint64((1 << 24) - 1)


@cache
def _powers(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value for each byte, and the powers of an odd base and of its inverse modulo 2**64."""
    rng = np.random.default_rng(seed)
    values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = int(rng.integers(1 << 40, 1 << 62)) * 8 + 5
    n = SEGMENT + 4096
    out = [values]
    for b in (base, pow(base, -1, 1 << 64)):
        a = np.full(n, b, np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return tuple(out)


class Hashes:
    """Hashes of any piece of data (uint8, at most SEGMENT + 4096 bytes) from prefix sums."""

    def __init__(self, data: np.ndarray, seed: int):
        values, up, self.down = _powers(seed)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def sliding_least(a: np.ndarray, m: int) -> np.ndarray:
    """Least of each m neighbours."""
    n = len(a)
    rows = np.pad(a, (0, -n % m), constant_values=np.uint64(2**64 - 1)).reshape(-1, m)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - m + 1], ahead[m - 1 : n])


def segments(lengths: list[int], width: int) -> Iterator[list[tuple[int, int, int]]]:
    """Pieces (text, from, to) that together make one array of up to SEGMENT bytes; long texts overlap by width - 1."""
    part, size = [], 0
    for k, n in enumerate(lengths):
        at = 0
        while n - at >= width:
            end = min(n, at + SEGMENT)
            if size + end - at > SEGMENT and part:
                yield part
                part, size = [], 0
            part.append((k, at, end))
            size += end - at
            at = end - width + 1
            if end == n:
                break
    if part:
        yield part


def runs_of(texts: list[bytes], width: int = WIDTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of suffixes with one first digit: text, first, count, digit, hash of the run's text and place."""
    for part in segments([len(t) for t in texts], width):
        data = np.frombuffer(b"".join(texts[k][a:e] for k, a, e in part), np.uint8)
        if len(data) < width:
            continue
        h = Hashes(data, 1)
        at = np.arange(len(data) - gram + 1)
        grams = h.of(at, at + gram)
        best = (sliding_least((grams & ~_INDEX) | at.astype(np.uint64), width - gram + 1) & _INDEX).astype(np.int64)
        sizes = np.array([e - a for _, a, e in part])
        ends = np.cumsum(sizes)
        ok = np.zeros(len(data) + 1, np.int8)
        np.add.at(ok, ends - sizes, 1)
        np.add.at(ok, ends - width + 1, -1)
        ok = np.cumsum(ok)[: len(best)] > 0
        change = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (ok[1:] != ok[:-1])]))
        stop = np.concatenate([change[1:], [len(best)]])
        change, stop = change[ok[change]], stop[ok[change]]
        piece = np.searchsorted(ends, change, "right")
        shift = np.array([a for _, a, _ in part]) - (ends - sizes)
        anchor = best[change]
        full = Hashes(data, 2).of(change, stop - 1 + width)
        place = mixed(full + ((anchor - change).astype(np.uint64) << np.uint64(32)) + (stop - change).astype(np.uint64))
        yield np.array([k for k, _, _ in part])[piece], change + shift[piece], stop - change, anchor - change, grams[anchor], place


def as_long(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64))


def only(rows: DataFrame, keys: DataFrame, how: str = "left_semi", key: str = "uid") -> DataFrame:
    """Rows that have (or lack) a key, without moving the texts where the keys are few enough to be sent around."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, key, how)


def _first_pass(rows: DataFrame, width: int, gram: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uid, texts = np.asarray(b.column(0)), b.column(1).cast(pa.binary()).to_pylist()
            for text, first, n, off, digit, place in runs_of(texts, width, gram):
                cols = [uid[text], (first << 20) | (n << 10) | off, digit, place]
                yield pa.RecordBatch.from_arrays([as_long(c) for c in cols], ["uid", "run", "digit", "place"])

    return rows.select("uid", "text").mapInArrow(scan, "uid long, run long, digit long, place long")


def _with_text(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts with the wanted lists of them."""
    return only(rows, wanted.select("uid")).select("uid", "text").join(wanted, "uid")


def _sections(rows: DataFrame, wanted: DataFrame, width: int, step: int) -> DataFrame:
    """Sections of the wanted runs: uid, first, n, digit, slot (place beside the digit's piece), union, core, weight."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uid, text, want in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                run = np.array([w["run"] for w in want], np.int64)
                digit, weight = np.array([w["digit"] for w in want], np.int64), np.array([w["weight"] for w in want], np.int64)
                first, n, off = run >> 20, (run >> 10) & 1023, run & 1023
                # suffix first + i lies off - i bytes before the piece; sections are cut where that is a multiple of step
                low = (off - n + 1) // step
                count = off // step - low + 1
                which = np.repeat(np.arange(len(run)), count)
                slot = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
                piece = (first + off)[which]
                a = np.maximum(piece - (slot * step + step - 1), first[which])
                e = np.minimum(piece - slot * step, (first + n - 1)[which])  # last suffix
                inner = piece - slot * step  # where the section's last possible suffix starts
                union, core = _hash_ranges(text, a, e + width), _hash_ranges(text, inner, inner - step + 1 + width)
                union = mixed(union + ((piece - a).astype(np.uint64) << np.uint64(16)) + (e - a).astype(np.uint64))
                core = mixed(core + slot.astype(np.uint64))
                cols = [np.full(len(a), uid), (a << 20) | (e - a + 1), digit[which], slot, union, core, weight[which]]
                yield pa.RecordBatch.from_arrays([as_long(np.asarray(c)) for c in cols], ["uid", "part", "digit", "slot", "whole", "core", "weight"])

    return _with_text(rows, wanted).select("uid", "text", "want").mapInArrow(scan, "uid long, part long, digit long, slot long, whole long, core long, weight long")


def _hash_ranges(text: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of text[start:end]; what lies far apart is hashed in separate segments."""
    out = np.zeros(len(start), np.uint64)
    order = np.argsort(start, kind="stable")
    k = 0
    while k < len(order):
        base = int(start[order[k]])
        stop = int(np.searchsorted(start[order], base + SEGMENT, "left"))
        pick = order[k:stop]
        data = np.frombuffer(text, np.uint8)[base : min(len(text), int(end[pick].max()))]
        out[pick] = Hashes(data, 3).of(start[pick] - base, end[pick] - base)
        k = stop
    return out


def _suffixes(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Each suffix of the wanted sections: uid, at, digit, slot, key, weight."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uid, text, want in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                part, digit, slot, weight = (np.array([w[c] for w in want], np.int64) for c in ("part", "digit", "slot", "weight"))
                n = part & ((1 << 20) - 1)
                which = np.repeat(np.arange(len(part)), n)
                at = (part >> 20)[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                cols = [np.full(len(at), uid), at, digit[which], slot[which], _hash_ranges(text, at, at + width), weight[which]]
                yield pa.RecordBatch.from_arrays([as_long(np.asarray(c)) for c in cols], ["uid", "at", "digit", "slot", "key", "weight"])

    return _with_text(rows, wanted).select("uid", "text", "want").mapInArrow(scan, "uid long, at long, digit long, slot long, key long, weight long")


def repeated_ranges(rows: DataFrame, width: int = WIDTH, gram: int = GRAM, step: int = STEP) -> DataFrame:
    """uid, first, last: byte ranges that repeated strings of width bytes cover (they may overlap)."""
    cover = lambda first, n: [F.col("uid"), first.alias("first"), (first + n + width - 1).alias("last")]
    runs = written(_first_pass(rows, width, gram), "first")  # counted, and then joined with the counts
    digits = runs.groupBy("digit").agg(F.count("*").alias("c"), F.min("place").alias("lo"), F.max("place").alias("hi")).where("c > 1")
    digits = written(digits.select("digit", (F.col("lo") != F.col("hi")).alias("doubt")), "digits")  # a table of its own lets Spark split hot digits in the join
    shared = written(runs.join(digits, "digit"), "runs")
    released(runs, digits)
    first, n = F.shiftright("run", 20), F.shiftright("run", 10).bitwiseAND(1023)
    sure = shared.where("not doubt").select(*cover(first, n))
    doubt = shared.where("doubt")
    equal = written(doubt.groupBy("digit", "place").agg(F.count("*").alias("weight"), F.min(F.struct("uid", "run")).alias("one")), "equal")
    twice = doubt.join(equal.where("weight > 1").select("digit", "place"), ["digit", "place"], "left_semi").select(*cover(first, n))
    wanted = equal.select("one.uid", F.struct("one.run", "digit", F.least("weight", F.lit(2)).alias("weight")).alias("w")).groupBy("uid").agg(F.collect_list("w").alias("want"))
    parts = written(_sections(rows, written(wanted, "wanted"), width, step), "sections")
    whole = parts.groupBy("digit", "slot", "whole").agg(F.sum("weight").alias("whole_n"))
    core = parts.groupBy("digit", "slot", "core").agg(F.sum("weight").alias("core_n"))
    core = written(core.where("core_n > 1").select("digit", "slot", "core"), "cores")
    whole = written(whole.where("whole_n > 1").select("digit", "slot", "whole", F.lit(True).alias("again")), "wholes")
    open_ = parts.join(core, ["digit", "slot", "core"], "left_semi").join(whole, ["digit", "slot", "whole"], "left")
    open_ = written(open_, "open")
    part_first, part_n = F.shiftright("part", 20), F.col("part").bitwiseAND((1 << 20) - 1)
    repeated = open_.where("again and weight = 1").select(*cover(part_first, part_n))
    # Suffixes of a section that is not repeated may also lie in one that is; sections whose core is shared take part.
    slots = open_.where("again is null").select("digit", "slot").distinct()
    last = open_.join(slots, ["digit", "slot"], "left_semi").select("uid", F.struct("part", "digit", "slot", "whole", "weight", F.coalesce("again", F.lit(False)).alias("again")).alias("w"))
    # one row for each distinct union: the others say nothing new
    last = last.groupBy("w.digit", "w.slot", "w.whole").agg(F.min(F.struct("uid", "w.part")).alias("one"), F.sum("w.weight").alias("weight"))
    last = last.select("one.uid", F.struct("one.part", "digit", "slot", F.least("weight", F.lit(2)).alias("weight")).alias("w")).groupBy("uid").agg(F.collect_list("w").alias("want"))
    keys = written(_suffixes(rows, written(last, "wanted"), width), "suffixes")
    often = keys.groupBy("digit", "slot", "key").agg(F.sum("weight").alias("t")).where("t > 1")
    often = written(often.select("digit", "slot", "key"), "often")
    single = keys.where("weight = 1").join(often, ["digit", "slot", "key"], "left_semi")
    single = single.select("uid", F.col("at").alias("first"), (F.col("at") + width).alias("last"))
    return sure.unionByName(twice).unionByName(repeated).unionByName(single)


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left) for every row of docs.

    docs: doc_id, text (null: empty) and any further columns. A byte goes when it lies in a string
    of width bytes that also starts elsewhere in any document. Rows with equal ids are documents of
    their own; an empty table gives an empty result.
    """
    arrow_rows(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), uid_of(docs)[0].alias("uid"))
    ranges = repeated_ranges(rows, width, gram).groupBy("uid").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    ranges = written(ranges, "ranges")
    untouched = only(rows, ranges.select("uid"), "left_anti")
    size = F.octet_length("text").cast("long")
    plain = untouched.select("doc_id", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.encode("text", "UTF-8").alias("kept"))
    touched = only(rows, ranges.select("uid")).join(ranges, "uid").select("doc_id", "text", "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text, ranges in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2)):
                n = len(text)
                edge = np.zeros(n + 1, np.int32)
                np.add.at(edge, np.asarray(ranges.values.field("first")), 1)
                np.add.at(edge, np.asarray(ranges.values.field("last")), -1)
                gone = np.cumsum(edge[:n]) > 0
                left = np.frombuffer(text, np.uint8)[~gone].tobytes()
                spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                for o, v in zip(out, (n, n - len(left), spans, hashlib.sha256(left).hexdigest(), left)):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return plain.unionByName(touched.mapInArrow(cut, schema))
