"""Token counts of whole texts; huge texts by overlapping chunks spliced where both encodings agree."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows
from .pieces import gathered
from .token_store import library_table

CHUNK, OVERLAP = 1 << 14, 1 << 9
_OFFSETS: dict[str, Callable] = {}


class Tokens:
    """The tokens of a chunk that begins at `base` of its text; only those places are asked for that a splice looks at."""

    def __init__(self, encoding, base: int = 0):
        self.ids, self.place, self.base = encoding.ids, encoding.token_to_chars, base

    def moved(self, base: int) -> Tokens:
        self.base = base
        return self

    def start(self, k: int) -> int:
        return self.place(k)[0] + self.base

    def first(self, place: int) -> int:
        """Index of the first token that begins at place or later."""
        return bisect_left(range(len(self.ids)), place, key=self.start)

    def between(self, low: int, high: int) -> list[int]:
        """Ids of the tokens that begin at low to high - 1."""
        return self.ids[self.first(low) : self.first(high)]

    def placed(self, low: int, high: int) -> list[tuple[int, int, int]]:
        """(id, start, end) of the tokens that begin at low to high - 1."""
        return [(self.ids[k], *(x + self.base for x in self.place(k))) for k in range(self.first(low), self.first(high))]


def spliced(encode: Callable[[str], Tokens], text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of text from chunk encodings.

    A splice point is a token start that both chunks have, right after a white space character
    (there the pre-tokenizer always cuts, so neither side depends on the other), with equal tokens
    behind it as far as the left chunk surely knows them. Where the overlap has none it is widened,
    and once it covers the left chunk, that chunk grows.
    """
    out: list[int] = []
    left, end = 0, min(chunk, len(text))
    cur, at = encode(text[:end]), 0  # tokens from absolute position at on are still to be given out
    while end < len(text):
        width = overlap
        while True:
            if width >= end - max(left, at):
                end = min(len(text), end + (end - left))
                cur = encode(text[left:end]).moved(left)
                if end == len(text):
                    break
                width = overlap
                continue
            start = end - width
            stop = min(len(text), start + chunk)
            nxt = encode(text[start:stop]).moved(start)
            cut = _common(cur, nxt, text, max(start, at) + 1, end)
            if cut is not None:
                out += cur.between(at, cut)
                left, end, cur, at = start, stop, nxt, cut
                break
            width *= 2
    return out + cur.between(at, len(text) + 1)


def _common(cur: Tokens, nxt: Tokens, text: str, low: int, end: int) -> int | None:
    """First agreed token start from low on that follows white space."""
    last = next((k for k in range(end - 1, low - 1, -1) if text[k].isspace()), None)  # the left chunk knows all tokens before it
    if last is None:
        return None
    mine, theirs = cur.placed(low, last), nxt.placed(low, last)
    for k, (_, start, _) in enumerate(mine):
        if text[start - 1].isspace() and mine[k:] == [t for t in theirs if t[1] >= start]:
            return start
    return None


def with_offsets(path: str) -> Callable[[str], Tokens]:
    if path not in _OFFSETS:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)

        def encode(text: str) -> Tokens:
            return Tokens(tok.encode(text, add_special_tokens=False))

        _OFFSETS[path] = encode
    return _OFFSETS[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text; null text: empty).

    Texts of up to one chunk are encoded piece by piece where the tokenizer file is known to cut at
    spaces, whole otherwise; longer ones by spliced(). Repeated rows give repeated rows, an empty
    table an empty result; ties don't matter.
    """
    arrow_rows(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, usable = library_table(tokenizer)
        encode = with_offsets(tokenizer)
        for b in gathered(batches):
            text = b.column(1)
            long = np.flatnonzero(np.asarray(pc.utf8_length(text)) > chunk)
            short = pc.if_else(pc.greater(pc.utf8_length(text), chunk), "", text) if len(long) else text
            if not usable:
                n = np.concatenate([pieces.encode(short[a : a + 256])[0] for a in range(0, len(short), 256)])
            else:
                n = pieces.counts(short if pieces.joined else pc.replace_substring(short, "\n", " "))
            for i in long:
                n[i] = len(spliced(encode, text[int(i)].as_py(), chunk))
            size = pc.binary_length(text).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
