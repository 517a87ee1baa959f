"""Byte statistics of evidence: entropy, rolling entropy, transition counts, scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4096


def shannon(data: np.ndarray) -> float:
    if not len(data):
        return 0.0
    p = np.bincount(data, minlength=256) / len(data)
    p = p[p > 0]
    return float(abs((p * np.log2(p)).sum()))


def _per_source(evidence: DataFrame, schema: str, fn) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *r) for p, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in fn(np.frombuffer(d or b"", np.uint8))]
            kinds = [{"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]] for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names)

    return evidence.select("source_path", "content").mapInArrow(scan, schema)


def entropy(evidence: DataFrame) -> DataFrame:
    return _per_source(evidence, "source_path string, entropy double", lambda d: [(shannon(d),)])


def rolling_entropy(evidence: DataFrame, window: int = 1024, step: int = 512) -> DataFrame:
    """A row a window; one for the whole source if it is shorter than the window."""
    starts = lambda d: range(0, len(d) - window + 1, step) if len(d) >= window else [0]
    return _per_source(evidence, "source_path string, window_start long, entropy double", lambda d: [(s, shannon(d[s : s + window])) for s in starts(d)])


def transitions(evidence: DataFrame) -> DataFrame:
    """Distinct byte transitions of each full 4096-byte block, as a share of 65,536."""

    def blocks(d: np.ndarray) -> list[tuple[int, float]]:
        n = len(d) // BLOCK
        x = d[: n * BLOCK].reshape(n, BLOCK).astype(np.int64)
        return [(k, len(np.unique(row[:-1] * 256 + row[1:])) / 65536) for k, row in enumerate(x)]

    return _per_source(evidence, "source_path string, block long, score double", blocks)


def classifier_score(entropy_bits: Column, ascii_share: Column, prior: Column) -> Column:
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    text = clamp(0.6 * ascii_share + 0.4 * (1 - F.abs(ascii_share - 0.45)))
    return clamp(0.55 * clamp(entropy_bits / 8) + 0.35 * text + prior)
