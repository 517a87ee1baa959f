"""Exact token ids of whole texts, computed once per distinct space-delimited piece.

A text is cut before each space that stands between two characters other than white space. The
pre-tokenizers accepted here never join characters across such a cut, so the ids of a text are those
of its pieces in order. Texts for which that can't be shown (runs of white space, white space at
an end) are encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut at once: the distinct pieces of so much text are far fewer than its pieces.
BLOCK_BYTES = 16 << 20


def gathered(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, joined until their text column holds limit bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += pc.sum(pc.binary_length(b.column(column))).as_py() or 0
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
            pa.default_memory_pool().release_unused()  # the worker may go on with another operator
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def flat_ids(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the lists and all their ids."""
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return size, np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum()))


Encode = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


class PieceTable:
    """Piece -> slice of a flat id array, kept for the life of a Python worker, in Arrow and NumPy arrays.

    encode: Arrow strings -> sizes, flat ids; spaced: the same for strings that start with their only
    space, if there is a faster way. joined: pieces keep the space before them and need characters
    other than white space at both ends. limit bounds the entries kept.
    """

    def __init__(self, encode: Encode, joined: bool = True, spaced: Encode | None = None, limit: int = 300_000):
        self.encode, self.joined, self.spaced, self.limit = encode, joined, spaced or encode, limit
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.off, self.len, self.hits = (np.zeros(0, np.int64) for _ in range(3))
        self.whole, self.flat = np.zeros(0, bool), np.zeros(0, np.uint32)

    def shrink(self) -> None:
        """Keeps the pieces that came up most often."""
        keep = np.sort(np.argsort(-self.hits, kind="stable")[: self.limit // 2])
        self.flat = take_runs(self.flat, self.off, self.len, keep)
        self.known, self.len, self.whole, self.hits = self.known.take(pa.array(keep)), self.len[keep], self.whole[keep], self.hits[keep] // 2
        self.off = np.cumsum(self.len) - self.len

    def slots(self, pieces: pa.Array, encode: Encode) -> np.ndarray:
        """Slots of distinct pieces; what is new gets encoded."""
        at = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(pc.is_null(at))
        if len(new):
            mark = np.zeros(len(new), bool)
            if self.joined:
                inner = pc.replace_substring_regex(new, "^ ", "")
                mark = np.asarray(pc.or_(pc.equal(inner, ""), pc.not_equal(pc.utf8_trim_whitespace(inner), inner)))
            size = np.zeros(len(new), np.int64)
            size[~mark], ids = encode(new.filter(pa.array(~mark)))
            base = len(self.known)
            self.off = np.concatenate([self.off, len(self.flat) + np.cumsum(size) - size])
            self.len, self.whole = np.concatenate([self.len, size]), np.concatenate([self.whole, mark])
            self.hits, self.flat = np.concatenate([self.hits, np.zeros(len(new), np.int64)]), np.concatenate([self.flat, ids])
            self.known = pa.concat_arrays([self.known, new])
            out = np.array(at.fill_null(-1), np.int64)
            out[out < 0] = np.arange(base, base + len(new))
            return out
        return np.asarray(at, np.int64)

    def lay(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """Slots of all pieces, each text's first piece and count, and the ids of texts encoded whole."""
        if len(self.known) > self.limit:
            self.shrink()
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
        bounds = np.asarray(lists.offsets).astype(np.int64)
        bounds -= bounds[0]
        coded = lists.flatten().dictionary_encode()
        codes, words = np.asarray(coded.indices), coded.dictionary
        starts, counts = bounds[:-1], np.diff(bounds)
        if self.joined:
            slots = self.slots(pc.binary_join_element_wise("", words, " "), self.spaced)[codes]
            if len(starts):
                firsts = words.take(pa.array(codes[starts])).dictionary_encode()
                slots[starts] = self.slots(firsts.dictionary, self.encode)[np.asarray(firsts.indices)]
        else:
            slots = self.slots(words, self.encode)[codes]
        self.hits += np.bincount(slots, minlength=len(self.hits))
        whole: dict[int, np.ndarray] = {}
        bad = self.whole[slots]
        if bad.any():
            picks = np.unique(np.repeat(np.arange(len(starts)), counts)[bad])
            for a in range(0, len(picks), 64):
                some = picks[a : a + 64]
                size, ids = self.encode(texts.take(pa.array(some)))
                ends = np.cumsum(size)
                whole |= {int(i): ids[e - n : e] for i, n, e in zip(some, size, ends)}
        return slots, starts, counts, whole

    def counts(self, texts: pa.Array) -> np.ndarray:
        slots, starts, counts, whole = self.lay(texts)
        sums = np.concatenate([[0], np.cumsum(self.len[slots])])
        out = sums[starts + counts] - sums[starts]
        for i, ids in whole.items():
            out[i] = len(ids)
        return out

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, gathered for some texts at a time."""
        slots, starts, counts, whole = self.lay(texts)
        for a in range(0, len(starts), 256):
            first, stop = starts[a], starts[a : a + 256][-1] + counts[a : a + 256][-1]
            n = self.len[slots[first:stop]]
            flat, ends = take_runs(self.flat, self.off, self.len, slots[first:stop]), np.concatenate([[0], np.cumsum(n)])
            for i in range(a, min(a + 256, len(starts))):
                at = starts[i] - first
                yield whole[i] if i in whole else flat[ends[at] : ends[at + counts[i]]]


def take_runs(flat: np.ndarray, off: np.ndarray, length: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """The runs flat[off[k] : off[k] + length[k]] of all picks, one after another."""
    n = length[picks]
    ends = np.cumsum(n)
    return flat[np.repeat(off[picks] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
