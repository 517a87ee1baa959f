"""Token ids in binary blocks with direct access to any token (directly addressable codes).

Each id is cut into 8-bit chunks, low chunk first. Level k holds chunk k of every id that has one,
a bitmap that tells which of these ids go on, and a rank directory (ones before every 512 bits).
Token i is read by following rank from level to level; nothing else is decoded.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, partitions, written
from .pieces import PieceTable, flat_ids, gathered

MAGIC = b"THDAC1\0\0"
RANK_BITS = 512
BLOCK_TOKENS = 1 << 18
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint32)


def dac_encode(ids) -> bytes:
    """MAGIC, levels u32, then per level: entries u64, chunks, bitmap, directory u32[]."""
    rest = np.asarray(ids, np.uint64)
    out: list[bytes] = []
    while True:
        more = rest >= 256
        bits = np.packbits(more, bitorder="little")
        ones = np.pad(_ONES[bits], (0, -len(bits) % (RANK_BITS // 8))).reshape(-1, RANK_BITS // 8).sum(1)
        ranks = np.concatenate([[0], np.cumsum(ones)])[:-1].astype("<u4")
        out += [struct.pack("<Q", len(rest)), (rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()]
        rest = rest[more] >> 8
        if not len(rest):
            break
    return MAGIC + struct.pack("<I", len(out) // 4) + b"".join(out)


class DacReader:
    """Opens a block without decoding it; len(), [i] and decode()."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token block")
        at, self.levels = 12, []
        for _ in range(struct.unpack_from("<I", data, 8)[0]):
            n = struct.unpack_from("<Q", data, at)[0]
            at += 8
            bits, dirs = -(-n // 8), -(-n // RANK_BITS)
            chunk = np.frombuffer(data, np.uint8, n, at)
            bitmap = np.frombuffer(data, np.uint8, bits, at + n)
            rank = np.frombuffer(data, "<u4", dirs, at + n + bits)
            self.levels.append((chunk, bitmap, rank))
            at += n + bits + 4 * dirs

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value, shift = 0, 0
        for level, (chunk, bitmap, _) in enumerate(self.levels):
            value |= int(chunk[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self._rank(level, i), shift + 8
        return value

    def _rank(self, level: int, i: int) -> int:
        """Ids of a level before its entry i that go on."""
        _, bitmap, rank = self.levels[level]
        base = i // RANK_BITS * (RANK_BITS // 8)
        return int(rank[i // RANK_BITS]) + int(_ONES[bitmap[base : i >> 3]].sum()) + int(_ONES[bitmap[i >> 3] & ((1 << (i & 7)) - 1)])

    def span(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop - 1, by rank from level to level; nothing before them is decoded."""
        if not 0 <= start <= stop <= len(self):
            raise IndexError((start, stop))
        return self._span(0, start, stop)

    def _span(self, level: int, start: int, stop: int) -> np.ndarray:
        chunk, bitmap, _ = self.levels[level]
        value = chunk[start:stop].astype(np.uint32)
        more = np.unpackbits(bitmap[start >> 3 : (stop + 7) >> 3], bitorder="little")[start & 7 : (start & 7) + stop - start].astype(bool)
        n = int(more.sum())
        if n:
            first = self._rank(level, start)
            value[more] |= self._span(level + 1, first, first + n) << 8
        return value

    def decode(self) -> np.ndarray:
        out = None
        for chunk, bitmap, _ in reversed(self.levels):
            value = chunk.astype(np.uint32)
            if out is not None:
                value[np.unpackbits(bitmap, count=len(chunk), bitorder="little").astype(bool)] |= out << 8
            out = value
        return out


_TABLES: dict[str, tuple[PieceTable, bool]] = {}
#: Pieces that are encoded as one string, and strings handed over at once.
GROUP, STRINGS = 256, 64


def cuts_at_spaces(path: str) -> tuple[bool, bool]:
    """Whether a tokenizer file's ids are those of its pieces between spaces, and whether a piece keeps the space before it.

    Known are byte-level BPE with its own pattern, and patterns that drop white space before byte-level BPE.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    parts = pre.get("pretokenizers", [pre])
    plain = spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and not spec.get("truncation") and not spec.get("padding")
    plain &= not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
    if plain and len(parts) == 1 and spec.get("normalizer") is None:
        return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"], True
    norm = spec.get("normalizer") or {}
    known = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " " for n in norm.get("normalizers", [norm]) if n)
    split = len(parts) == 2 and parts[0]["type"] == "Split" and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and parts[0]["pattern"].get("Regex") == WORD_PATTERN
    return bool(plain and known and split and parts[1]["type"] == "ByteLevel" and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"]), False


# Fixed value: the pattern of a public tokenizer file; none of its alternatives takes white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def library_table(path: str) -> tuple[PieceTable, bool]:
    """A worker's table for a tokenizer file, with the library's default treatment of special strings.

    Also whether it may be used; texts have to be encoded whole (table.encode) otherwise.
    """
    if path not in _TABLES:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker a core
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        usable, joined = cuts_at_spaces(path)
        opens = np.array([(tok.id_to_token(i) or "").startswith("\u0120") for i in range(tok.get_vocab_size() + 1)])

        def encode(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            sizes, flats = [], []
            for a in range(0, len(strings), GROUP * STRINGS // 4):
                size, flat = flat_ids([e.ids for e in tok.encode_batch_fast(strings[a : a + GROUP * STRINGS // 4].to_pylist(), add_special_tokens=False)])
                sizes.append(size)
                flats.append(flat)
            return np.concatenate([*sizes, np.zeros(0, np.int64)]), np.concatenate([*flats, np.zeros(0, np.uint32)])

        def spaced(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            """Strings that each start with their only space, encoded many at once: a token that starts with a space starts a string."""
            whole = len(strings) // GROUP * GROUP
            lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.arange(0, whole + 1, GROUP), pa.int32()), strings[:whole]), "")
            sizes, flats = [], []
            for a in range(0, len(lines), STRINGS):
                size, flat = flat_ids([e.ids for e in tok.encode_batch_fast(lines[a : a + STRINGS].to_pylist(), add_special_tokens=False)])
                first = np.flatnonzero(opens[flat])
                if (np.bincount(np.repeat(np.arange(len(size)), size)[first], minlength=len(size)) != GROUP).any():
                    size, flat = encode(strings[a * GROUP : (a + len(size)) * GROUP])
                else:
                    size = np.diff(np.append(first, len(flat)))
                sizes.append(size)
                flats.append(flat)
            size, flat = encode(strings[whole:])
            return np.concatenate([*sizes, size]), np.concatenate([*flats, flat])

        _TABLES[path] = PieceTable(encode, joined, spaced if joined else None), usable
    return _TABLES[path]


def ids_of(path: str, texts: pa.Array) -> Iterator[np.ndarray]:
    """The library's ids of each text."""
    table, usable = library_table(path)
    if usable:
        yield from table.ids(texts)
        return
    for a in range(0, len(texts), 256):
        size, flat = table.encode(texts[a : a + 256])
        yield from np.split(flat, np.cumsum(size)[:-1])


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of whole documents in ascending doc_id order (null ids first, equal ids by text).

    docs: doc_id, text (null: empty), any further columns. The blocks are a table in the shared
    folder: part and seq give their order, first the tokens before a block in its part, doc_ids and
    ends its documents, payload the file format above. An empty table gives no block.
    """
    arrow_rows(docs.sparkSession)
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    source = source.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        ids, ends, arrays, n = [], [], [], 0

        def block():
            nonlocal seq, first, ids, ends, arrays, n
            row = [[part], [seq], [first], [n], [ids], [ends], [dac_encode(np.concatenate(arrays))]]
            seq, first, ids, ends, arrays, n = seq + 1, first + n, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))], ["part", "seq", "first", "n_tokens", "doc_ids", "ends", "payload"])

        for b in gathered(batches):
            for doc, own in zip(b.column(0).to_pylist(), ids_of(tokenizer, b.column(1))):
                arrays += [own, np.array([end_id], np.uint32)]
                n += len(own) + 1
                ids.append(doc)
                ends.append(n)
                if n >= block_tokens:
                    yield block()
        if ids:
            yield block()

    schema = "part int, seq long, first long, n_tokens long, doc_ids array<long>, ends array<long>, payload binary"
    return written(source.mapInArrow(encode, schema), "tokens")


def _bases(blocks: DataFrame) -> dict[int, int]:
    """Tokens before each part; a row a partition."""
    base, total = {}, 0
    for r in sorted(blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        base[r["part"]], total = total, total + r["n"]
    return base


def tokens_at(blocks: DataFrame, places: DataFrame) -> DataFrame:
    """place, token for corpus-wide token numbers (place); each block that holds any is opened once and not decoded.

    Numbers that no token has give null, null gives null, equal ones a row each.
    """
    arrow_rows(blocks.sparkSession)
    base = blocks.sparkSession.createDataFrame(list(_bases(blocks).items()), "part int, base long")  # a row a partition
    found = blocks.select("part", "seq", "first", "n_tokens").join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("first"))
    where = places.select(F.col("place").cast("long").alias("place"))
    # Numbers and blocks meet in stretches of equal length.
    stretch = lambda c: F.floor(c / BLOCK_TOKENS)
    found = found.withColumn("stretch", F.explode(F.sequence(stretch(F.col("start")), stretch(F.col("start") + F.col("n_tokens") - 1))))
    held = where.distinct().withColumn("stretch", stretch(F.col("place"))).join(found, "stretch").where("place >= start and place < start + n_tokens")
    asked = held.groupBy("part", "seq", "start").agg(F.collect_list("place").alias("asked"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, asked, payload in zip(*(b.column(k).to_pylist() for k in range(3))):
                block = DacReader(payload)
                yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array([block[i - start] for i in asked], pa.int64())], ["place", "token"])

    got = asked.join(blocks.select("part", "seq", "payload"), ["part", "seq"]).select("start", "asked", "payload").mapInArrow(read, "place long, token long")
    return where.join(got, "place", "left")


def read_tokens(blocks: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32; each document is read by its place in its block."""
    arrow_rows(blocks.sparkSession)
    base = _bases(blocks)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, first, ids, ends, payload in zip(*(b.column(k).to_pylist() for k in range(5))):
                block, cuts = DacReader(payload), [0, *ends]
                out = [ids, [base[part] + first + a for a in cuts[:-1]], [e - a for a, e in zip(cuts, ends)], [zlib.crc32(block.span(a, e).astype("<u4").tobytes()) for a, e in zip(cuts, ends)]]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("part", "first", "doc_ids", "ends", "payload").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
