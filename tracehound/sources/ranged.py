"""Byte ranges of files as rows, for sources larger than one row can hold.

The paths must be readable where executors run (a mounted share or device). Only a range is in memory at once.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed value: no range is larger than this.
MAX_BLOCK = 64 << 20
#: Ranges in one task; small files share a task.
RANGES_PER_TASK = 16


def regular_files(root: str) -> list[str]:
    """The root itself or the regular files below it; links aren't followed, unreadable folders left out."""
    if not os.path.exists(root):
        raise ValueError(f"source not found: {root}")
    if not os.path.isdir(root):
        return [root]
    found = (os.path.join(d, x) for d, _, names in os.walk(root) for x in names)
    return sorted(f for f in found if not os.path.islink(f) and os.path.isfile(f))


def size_of(path: str) -> int:
    """Bytes of a file or block device."""
    if stat.S_ISCHR(os.stat(path).st_mode):
        return 0
    with open(path, "rb") as f:
        return f.seek(0, os.SEEK_END)


class _Ranges(InputPartition):
    """Pieces (path, first chunk, end, size of the file) that one task reads."""

    def __init__(self, pieces: list[tuple[str, int, int, int]]):
        self.pieces = pieces


class _Reader(DataSourceReader):
    """Chunks that reach into the bytes start to stop - 1 or into the last tail bytes; only these are read."""

    def __init__(self, options: dict):
        roots = [x for x in options.get("path", "").split("\n") if x.strip()]
        if not roots:
            raise ValueError("no source given")
        self.roots = roots
        self.chunk, self.overlap = int(options.get("chunk", 8 << 20)), int(options.get("overlap", 0))
        self.start, self.stop, self.tail = int(options.get("start", 0)), int(options.get("stop", -1)), int(options.get("tail", 0))
        if self.chunk < 1024:
            raise ValueError("chunk below 1024")
        if self.overlap < 0 or self.chunk + self.overlap > MAX_BLOCK:
            raise ValueError(f"a range holds at most {MAX_BLOCK} bytes")

    def spans(self, total: int) -> list[tuple[int, int]]:
        """First chunks and ends of what is asked for of a file; apart from each other."""
        down = lambda n: max(0, n) // self.chunk * self.chunk
        stop = total if self.stop < 0 else min(total, self.stop)
        asked = [(down(self.start), stop)] if self.start < stop else []
        if self.tail and total:
            asked.append((down(total - self.tail), total))
        out: list[tuple[int, int]] = []
        for a, e in sorted(asked):
            if out and a < down(out[-1][1] + self.chunk - 1):
                out[-1] = (out[-1][0], max(out[-1][1], e))
            else:
                out.append((a, e))
        return out

    def partitions(self) -> list[_Ranges]:
        out: list[_Ranges] = []
        held, n = [], 0
        step = self.chunk * RANGES_PER_TASK
        for path in dict.fromkeys(f for r in self.roots for f in regular_files(r)):
            total = size_of(path)
            for first, end in self.spans(total):
                for a in range(first, end, step):
                    held.append((path, a, min(a + step, end), total))
                    n += -(-(held[-1][2] - a) // self.chunk)
                    if n >= RANGES_PER_TASK:
                        out.append(_Ranges(held))
                        held, n = [], 0
        return out + ([_Ranges(held)] if held else [])

    def read(self, partition: _Ranges) -> Iterator[tuple]:
        for path, first, end, total in partition.pieces:
            with open(path, "rb") as f:
                for at in range(first, end, self.chunk):
                    f.seek(at)
                    yield path, total, at, f.read(self.chunk + self.overlap)


class ByteRanges(DataSource):
    """Format "byte_ranges"; options path (roots, one a line), chunk, overlap, start, stop, tail."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "source_path string, length long, chunk_start long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def chunks(spark: SparkSession, roots: list[str], chunk: int = 8 << 20, overlap: int = 0, start: int = 0, stop: int | None = None, tail: int = 0) -> DataFrame:
    """source_path, length, chunk_start, content of every chunk, with what follows it up to overlap.

    Of files larger than that only the chunks that reach into bytes start to stop - 1, and into the last tail bytes.
    """
    spark.dataSource.register(ByteRanges)
    options = {"chunk": chunk, "overlap": overlap, "start": start, "stop": -1 if stop is None else stop, "tail": tail}
    return spark.read.format("byte_ranges").option("path", "\n".join(roots)).options(**options).load()


def read_ranges(files: DataFrame, chunk: int = 8 << 20, overlap: int = 0) -> DataFrame:
    """chunks() of files that are themselves rows (source_path, length); read where the rows are."""
    if chunk < 1024 or overlap < 0 or chunk + overlap > MAX_BLOCK:
        raise ValueError(f"a range holds 1024 to {MAX_BLOCK} bytes")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(chunk).cast("long")))
    rows = files.select("source_path", "length").distinct().where("length > 0").select("source_path", "length", starts.alias("chunk_start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (path, at) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                with open(path, "rb") as f:
                    f.seek(at)
                    yield pa.RecordBatch.from_arrays([*b.slice(k, 1).columns, pa.array([f.read(chunk + overlap)], pa.binary())], ["source_path", "length", "chunk_start", "content"])

    return rows.mapInArrow(read, "source_path string, length long, chunk_start long, content binary")


def edges(files: DataFrame, head: int, tail: int) -> DataFrame:
    """source_path, length, content (the first head and the last tail bytes; the whole of smaller files), read where the rows are."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, sizes, parts = b.column(0).to_pylist(), [], []
            for path in paths:
                size = size_of(path)
                with open(path, "rb") as f:
                    data = f.read(head if size > head + tail else size)
                    if size > head + tail:
                        f.seek(size - tail)
                        data += f.read(tail)
                sizes.append(size)
                parts.append(data)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(parts, pa.binary())], ["source_path", "length", "content"])

    return files.select("source_path").mapInArrow(read, "source_path string, length long, content binary")


def rows_of(spark: SparkSession, files: list[str]) -> DataFrame:
    """The files as rows (source_path), dealt out so that executors share the reading."""
    return spark.createDataFrame([(f,) for f in files], "source_path string").repartition(max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism)))


def block(spark: SparkSession, path: str, offset: int, length: int) -> bytes:
    """length bytes of a file at offset, fewer at its end."""
    if offset < 0 or not 0 <= length <= MAX_BLOCK:
        raise ValueError(f"a block holds at most {MAX_BLOCK} bytes")
    rows = chunks(spark, [path], max(length, 1024), start=offset, stop=offset + length)
    got = {r.chunk_start: bytes(r.content) for r in rows.select("chunk_start", "content").collect()}  # two chunks at most
    first = min(got, default=0)
    return b"".join(got[k] for k in sorted(got))[max(0, offset - first) :][:length]
