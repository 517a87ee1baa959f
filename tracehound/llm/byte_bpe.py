"""Byte-level BPE by a sentencepiece model that is written straight from a rank file.

Every byte becomes one character, every rank a piece scored by its negative rank, normalisation is
the identity; the model then merges as the rank file says. Pre-tokens are encoded one by one.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows
from .pieces import PieceTable, flat_ids, gathered, take_runs

#: Strings that are pre-tokenized at once.
PRE_TOKENIZED = 1 << 13
#: Bytes of text that are cut into pieces at once; in a pipeline the worker stands beside a full heap.
BLOCK = 4 << 20
#: Characters that stand for the bytes 0-255: one block of letters without white space or marks.
BYTE_BASE = 0x4E00

# Fixed value: the public pattern whose matches take a space only at their start, or white space alone.
SPACED_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def byte_text(data: bytes) -> str:
    return "".join(chr(BYTE_BASE + b) for b in data)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """ModelProto: pieces (1: piece, 2: score, 3: type), trainer_spec (2), normalizer_spec (3).

    Ids are the ranks; an unknown piece, never produced, comes after the last rank.
    """
    by_rank = sorted((r, b) for b, r in ranks.items())
    if [r for r, _ in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    pieces = [_field(1, _field(1, byte_text(b).encode()) + _field(2, -float(r)) + _field(3, 1)) for r, b in by_rank]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(by_rank)) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    plain = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, plain)


class ByteBpe:
    """encode(): ids of pre-tokens; table: pieces of texts; decode(): the inverse mapping."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.ranks))
        self.find = regex.compile(pattern).findall
        self.table, self.usable = PieceTable(self.encode, limit=100_000), pattern == SPACED_PATTERN
        tokens = [b for _, b in sorted((r, b) for b, r in self.ranks.items())]
        self.bytes = self._flat(tokens)
        self.decimal = self._flat([b"%d," % i for i in range(len(tokens))])

    @staticmethod
    def _flat(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.array([len(x) for x in items], np.int64)
        return np.frombuffer(b"".join(items), np.uint8), np.cumsum(n) - n, n

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text, pre-token by pre-token; each distinct one goes to the model once."""
        sizes, flats = [], []
        for a in range(0, len(texts), PRE_TOKENIZED):
            cut = [self.find(t) for t in texts[a : a + PRE_TOKENIZED].to_pylist()]
            slot = {p: i for i, p in enumerate(dict.fromkeys(chain.from_iterable(cut)))}
            raw = [p.encode() for p in slot]
            known = [self.ranks.get(b) for b in raw]  # a pre-token that is itself in the vocabulary is one id
            merged = iter(self.model.encode([byte_text(b) for b, k in zip(raw, known) if k is None], out_type=int, num_threads=1))
            size, flat = flat_ids([next(merged) if k is None else (k,) for k in known])
            counts = np.fromiter(map(len, cut), np.int64, len(cut))
            picks = np.fromiter((slot[p] for c in cut for p in c), np.int64, int(counts.sum()))
            sums = np.concatenate([[0], np.cumsum(size[picks])])
            ends = np.cumsum(counts)
            sizes.append(sums[ends] - sums[ends - counts])
            flats.append(take_runs(flat, np.cumsum(size) - size, size, picks))
        return np.concatenate([*sizes, np.zeros(0, np.int64)]), np.concatenate([*flats, np.zeros(0, np.uint32)])

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; by pieces between spaces where the pattern is known to cut there."""
        if self.usable:
            yield from self.table.ids(texts)
            return
        for a in range(0, len(texts), 256):
            size, flat = self.encode(texts[a : a + 256])
            yield from np.split(flat, np.cumsum(size)[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        return take_runs(*self.bytes, ids).tobytes()

    def digits(self, ids: np.ndarray) -> bytes:
        return take_runs(*self.decimal, ids).tobytes()[:-1]


_OPEN: dict[tuple[str, str], ByteBpe] = {}


def opened(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _OPEN:
        _OPEN[path, pattern] = ByteBpe(path, pattern)
    return _OPEN[path, pattern]


def closed() -> None:
    """Gives a worker's memory back: the next task may be another operator's, beside a full heap."""
    _OPEN.clear()
    pa.default_memory_pool().release_unused()


def _encoded(batches: Iterator[pa.RecordBatch], bpe: ByteBpe) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Column 0 and the ids of column 1, some rows at a time."""
    try:
        for b in gathered(batches, limit=BLOCK):
            ids = bpe.ids(b.column(1))
            for a in range(0, b.num_rows, 256):
                part = b.column(0)[a : a + 256]
                yield part, list(islice(ids, len(part)))
    finally:
        closed()


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids array<int>, decoded binary for every row (null or empty text: no ids).

    Repeated rows give repeated rows, an empty table an empty result; ties don't matter.
    """
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = opened(ranks_path, pattern)
        for doc, ids in _encoded(batches, bpe):
            yield pa.RecordBatch.from_arrays([doc, pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded binary")


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """encode_documents() with digests in place of ids and bytes, made before they leave the worker."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = opened(ranks_path, pattern)
        for doc, ids in _encoded(batches, bpe):
            yield pa.RecordBatch.from_arrays([doc, pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(bpe.digits(x)).hexdigest() for x in ids]), pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
