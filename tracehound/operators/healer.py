"""What can still be read of a damaged container: a redundant header, or file systems inside it."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehound.operators.profiles import shannon

# Window, what windows share, depth, limit of entropy, boot and superblock marks with what lies before them.
WINDOW, SHARED, DEPTH, CIPHER = 4 << 20, 4096, 1 << 30, 7.9
MARKS = [("ntfs", b"\xebR\x90NTFS ", 0), ("hfs_plus", b"H+\x00\x04", 1024), ("apfs", b"NXSB", 0), ("squashfs", b"hsqs", 0), ("tar", b"ustar", 257)]
HEADERS = (65536, 131072)


def found_in(f: BinaryIO, size: int) -> tuple[str, int]:
    """What is found in a file and where it begins.

    The first window with a mark counts, in it the first mark by the order of MARKS. A window that
    begins like ciphertext is not searched and the next begins SHARED bytes on, else it is
    WINDOW - SHARED on; up to DEPTH. One window is in memory at a time.
    """

    def part(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    if any(size >= k + 4096 and part(k, 4) == b"head" for k in HEADERS):
        return "vhdx_header", 0
    top, at = min(size, DEPTH), 0
    while at < top:
        data = part(at, min(WINDOW, top - at))
        if shannon(np.frombuffer(data[:SHARED], np.uint8)) > CIPHER:
            at += SHARED
            continue
        for kind, mark, before in MARKS:
            hit = data.find(mark)
            if hit >= 0:
                return kind, max(at + hit - before, 0)
        at += WINDOW - SHARED
    return "tail", min(1 << 20, size)


def _healed(rows: DataFrame, opened: Callable) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, sizes = [], []
            for path, what in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with opened(path, what) as f:
                    sizes.append(f.seek(0, io.SEEK_END))
                    got.append(found_in(f, sizes[-1]))
            cols = [b.column(0), pa.array([k for k, _ in got], pa.string()), pa.array([a for _, a in got], pa.int64()), pa.array([n - a for n, (_, a) in zip(sizes, got)], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["source_path", "found", "offset", "size"])

    return rows.mapInArrow(scan, "source_path string, found string, offset long, size long")


def heal(evidence: DataFrame) -> DataFrame:
    """source_path, found, offset, size: one row for each source; null content counts as empty.

    Where nothing is found the row is the tail after the first MiB.
    """
    return _healed(evidence.select("source_path", "content"), lambda path, data: io.BytesIO(data or b""))


def heal_files(files: DataFrame) -> DataFrame:
    """heal() of files (source_path) that executors open themselves."""
    return _healed(files.select("source_path", F.lit(0).alias("_")), lambda path, _: open(path, "rb"))
