"""Signatures: magic bytes with ?? wildcards, profiles, and their matches in evidence."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehound.operators.scoring import Classifier, blended, learned

SCHEMA = "id string, name string, extension string, magic string, offset long, category string, description string, default_size long"

# Fixed values, from the formats' public documentation.
BUILTIN = [
    ("sig-common-0001", "JPEG (JFIF)", "jpg", "ff d8 ff e0", 0, "image", None, None),
    ("sig-common-0002", "JPEG (EXIF)", "jpg", "ff d8 ff e1", 0, "image", None, None),
    ("sig-common-0003", "PNG", "png", "89 50 4e 47 0d 0a 1a 0a", 0, "image", None, None),
    ("sig-common-0009", "PDF", "pdf", "25 50 44 46 2d", 0, "document", None, None),
    ("sig-zip-0001", "ZIP", "zip", "50 4b 03 04", 0, "archive", None, None),
    ("sig-gif-0001", "GIF", "gif", "47 49 46 38 ?? 61", 0, "image", None, None),
    ("sig-elf-0001", "ELF", "elf", "7f 45 4c 46", 0, "executable", None, None),
    ("sig-sqlite-0001", "SQLite", "sqlite", "53 51 4c 69 74 65 20 66 6f 72 6d 61 74 20 33 00", 0, "database", None, None),
    ("sig-vmdk-0001", "VMDK", "vmdk", "4b 44 4d 56", 0, "virtual_disk", None, None),
    ("sig-qcow-0001", "QCOW2", "qcow2", "51 46 49 fb", 0, "virtual_disk", None, None),
    ("sig-tar-0001", "TAR", "tar", "75 73 74 61 72", 257, "archive", None, None),
    ("sig-html-0001", "HTML", "html", "3c 21 44 4f 43 54 59 50 45", 0, "document", None, None),
    ("sig-html-0002", "HTML script", "html", "3c 73 63 72 69 70 74", 0, "document", None, None),
    ("sig-html-0003", "HTML heading", "html", "3c 68 ?? 3e", 0, "document", None, None),
    ("sig-generated-0001", "generated", "bin", "de ad be ef", 0, "unknown", None, None),
    ("sig-any-0001", "generic text", "txt", "74 65 78 74", 0, "Generic", None, None),
]


def builtin(spark: SparkSession, profile: str = "strict") -> DataFrame:
    return with_profile(spark.createDataFrame(BUILTIN, SCHEMA), profile)


def from_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def with_profile(signatures: DataFrame, profile: str) -> DataFrame:
    """strict leaves out generated ids and the generic category; broad keeps all."""
    if profile not in ("strict", "broad"):
        raise ValueError(f"unknown profile {profile}")
    return signatures if profile == "broad" else signatures.where(~F.col("id").startswith("sig-generated-") & (F.lower("category") != "generic"))


def parse_magic(magic: str) -> tuple[bytes, list[bool]]:
    """Bytes and which of them count; ?? is a wildcard."""
    data, mask = bytearray(), []
    for token in magic.split():
        if token != "??" and not re.fullmatch("[0-9a-fA-F]{2}", token):
            raise ValueError(f"not a hex byte: {token}")
        data.append(0 if token == "??" else int(token, 16))
        mask.append(token != "??")
    if not mask:
        raise ValueError("empty magic")
    return bytes(data), mask


def summary(signatures: DataFrame) -> DataFrame:
    return signatures.agg(F.count("*").alias("signatures"), F.max(F.size(F.split("magic", r"\s+"))).cast("long").alias("max_length"))


class Compiled(NamedTuple):
    """core: the longest run without wildcards, which begins at start."""

    id: str
    offset: int
    magic: bytes
    mask: list[bool]
    start: int
    core: bytes


def compiled(signatures: DataFrame) -> list[Compiled]:
    """Signatures are a small dimension table, compiled on the driver; one that begins with a wildcard never matches."""
    table = []
    for s in signatures.select("id", "magic", F.coalesce("offset", F.lit(0)).alias("offset")).collect():
        data, mask = parse_magic(s["magic"])
        if mask[0]:
            fixed = [m.span() for m in re.finditer("1+", "".join("01"[k] for k in mask))]
            a, e = max(fixed, key=lambda x: x[1] - x[0])
            table.append(Compiled(s["id"], s["offset"], data, mask, a, data[a:e]))
    return table


class Finder:
    """Finds the matches of all signatures in one pass over the bytes."""

    def __init__(self, table: list[Compiled]):
        import ahocorasick

        by_core: dict[bytes, list[Compiled]] = {}
        for s in table:
            by_core.setdefault(s.core, []).append(s)
        self.cores = ahocorasick.Automaton()
        for core, own in by_core.items():
            self.cores.add_word(core.decode("latin-1"), (len(core), own))
        if by_core:
            self.cores.make_automaton()

    def matches(self, data: bytes) -> Iterator[tuple[Compiled, int]]:
        """Each signature whose magic lies in data, and where."""
        if not len(self.cores):
            return
        for last, (size, own) in self.cores.iter(data.decode("latin-1")):
            for s in own:
                hit = last + 1 - size - s.start
                if hit >= 0 and hit + len(s.magic) <= len(data) and all(data[hit + k] == x for k, x in enumerate(s.magic) if s.mask[k]):
                    yield s, hit


def carve_chunks(parts: DataFrame, signatures: DataFrame, chunk: int, broad: bool = False, classifier: Classifier = learned) -> DataFrame:
    """Scored matches of (source_path, chunk_start, content): source_path, offset, signature_id, validation_score, confidence.

    content reaches beyond the chunk by the longest magic and what scores look at. A match belongs to
    the chunk in which it begins, so none comes twice. classifier(signature_id, data, hit) gives the
    learned part of the score.
    """
    table = compiled(signatures)
    kinds = {"source_path": pa.string(), "offset": pa.int64(), "signature_id": pa.string(), "validation_score": pa.float64(), "confidence": pa.float64()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(table).matches
        for b in batches:
            rows = []
            for path, start, data in zip(*(c.to_pylist() for c in b.columns)):
                rows += [(path, start + hit - s.offset, s.id, *blended(s.id, data, hit, broad, classifier)) for s, hit in find(data or b"") if hit < chunk and start + hit >= s.offset]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds.values())], list(kinds))

    return parts.select("source_path", "chunk_start", "content").mapInArrow(scan, "source_path string, offset long, signature_id string, validation_score double, confidence double")


def positions(evidence: DataFrame, signatures: DataFrame, carry: str = "source_path") -> DataFrame:
    """Matches: carry, hit (where the magic lies), offset (where the file begins), signature_id.

    Signatures are a small dimension table that is compiled on the driver; one whose first byte is a
    wildcard never matches, nor does one whose file would begin before the source.
    """
    table = compiled(signatures)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(table).matches
        for b in batches:
            rows: list[tuple] = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows += [(path, hit, hit - s.offset, s.id) for s, hit in find(data or b"") if hit >= s.offset]
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))], [carry, "hit", "offset", "signature_id"])

    return evidence.select(carry, "content").mapInArrow(scan, f"{carry} string, hit long, offset long, signature_id string")
