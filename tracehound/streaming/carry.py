"""Matches in byte streams: chunks of each source arrive in order; a tail is carried from chunk to chunk."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tracehound.operators.signatures import Finder, compiled

STATE = "carry binary, next_offset long"
HITS = "source_path string, hit long, offset long, signature_id string"


def carve_stream(parts: DataFrame, signatures: DataFrame) -> DataFrame:
    """Matches in a stream of (source_path, chunk_start, content), each one once, as in the whole source.

    Bytes that came before are skipped. After a gap the carry is empty: nothing is matched across it.
    Null or empty content has no matches.
    """
    table = compiled(signatures)
    tail = max((len(s.magic) for s in table), default=1) - 1

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        find = Finder(table).matches
        carry, after = (bytes(state.get[0]), state.get[1]) if state.exists else (b"", 0)
        rows = sorted(((int(s), bytes(c)) for f in frames for s, c in zip(f["chunk_start"], f["content"]) if c is not None), key=lambda x: (x[0], -len(x[1])))
        out: list[tuple] = []
        for start, data in rows:
            if start > after:
                carry, after = b"", start
            data = data[after - start :]
            if not data:
                continue
            base, held = after - len(carry), carry + data
            out += [(key[0], base + hit, base + hit - s.offset, s.id) for s, hit in find(held) if hit + len(s.magic) > len(carry) and base + hit >= s.offset]
            after += len(data)
            carry = held[len(held) - min(tail, len(held)) :]
        state.update((carry, after))
        yield pd.DataFrame(out, columns=["source_path", "hit", "offset", "signature_id"])

    rows = parts.select("source_path", "chunk_start", "content")
    return rows.groupBy("source_path").applyInPandasWithState(step, HITS, STATE, "append", GroupStateTimeout.NoTimeout)


def latest_by_key(batch: DataFrame, held: DataFrame | None, key: str, order: list[str]) -> DataFrame:
    """held with the batch's rows put over it: the last write of each key wins. For foreachBatch."""
    rows = batch if held is None else held.unionByName(batch)
    columns = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_b"))
    return best.select(key, *(F.col(f"_b.{c}").alias(c) for c in columns))
