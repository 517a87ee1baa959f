"""Container listing, file-table records and array members: structures that need a walk over bytes."""

from __future__ import annotations

import io
import ntpath
import struct
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehound.functions.binary import int_be, int_le
from tracehound.operators import markers, profiles
from tracehound.sources import ranged

Entry = tuple[str, int, int, bool]
#: Bytes of a disk descriptor that are read at most, and of a file's two ends that tell its kind.
DESCRIPTOR, HEAD, TAIL = 1 << 20, 4096, 512


def _at(f: BinaryIO, offset: int, size: int) -> bytes:
    f.seek(offset)
    return f.read(size)


def _zip(f: BinaryIO) -> list[Entry]:
    try:
        with zipfile.ZipFile(f) as z:
            out = []
            for i in z.infolist():
                name, extra = struct.unpack("<HH", _at(f, i.header_offset + 26, 4))
                out.append((i.filename, i.header_offset + 30 + name + extra, i.file_size, bool(i.flag_bits & 1)))
            return out
    except (zipfile.BadZipFile, struct.error) as e:
        raise ValueError(f"ZIP open failed: {e}") from e


def _tar(f: BinaryIO) -> list[Entry]:
    f.seek(0)
    with tarfile.open(fileobj=f, mode="r:") as t:
        return [(m.name, 0, m.size, False) for m in t if m.isfile()]


def _vpk(f: BinaryIO) -> list[Entry]:
    """Directory tree: extension, folder, name, each NUL-terminated and ended by an empty one."""
    version, tree = struct.unpack("<II", _at(f, 4, 8))
    if version not in (1, 2):
        raise ValueError(f"VPK version {version}")
    begin = 12 if version == 1 else 28
    end = begin + tree
    data, at = _at(f, begin, tree), 0
    out: list[Entry] = []

    def word() -> str:
        nonlocal at
        stop = data.index(0, at)
        text = data[at:stop].decode()
        at = stop + 1
        return text

    while ext := word():
        while folder := word():
            while name := word():
                _, preload, archive, offset, size, mark = struct.unpack_from("<IHHIIH", data, at)
                if mark != 0xFFFF:
                    raise ValueError("VPK entry without end mark")
                at += 18 + preload
                path = f"{name}.{ext}" if folder == " " else f"{folder}/{name}.{ext}"
                out.append((path, offset + end if archive == 0x7FFF else offset, size, False))
    return out


def _vmdk(f: BinaryIO, size: int, path: str) -> list[Entry]:
    data = _at(f, 0, DESCRIPTOR)
    if data[:4] == b"KDMV":
        return [(ntpath.basename(path), 0, size, False)]
    text = data.decode("utf-8", "replace")
    if "Disk DescriptorFile" not in text and "createType" not in text:
        raise ValueError("VMDK descriptor not found")
    rows = [x.split(maxsplit=3) for x in map(str.strip, text.splitlines()) if x.startswith("RW ")]
    out = []
    for r in rows:
        if len(r) == 4 and r[1].isdigit():
            name = r[3].split()[0].replace("\\", "").strip('"')
            out.append((name, 0, int(r[1]) * 512, False))
    return out or [(ntpath.basename(path), 0, size, False)]


def list_entries(kind: str, f: BinaryIO, size: int, path: str) -> list[Entry]:
    """(name, offset, size, encrypted) of a container; raises ValueError if it can't be read.

    Only directories and headers are read, so a container may be of any size.
    """
    whole = ntpath.basename(path.replace("/", "\\"))
    try:
        if kind == "archive" and path.lower().endswith(".zip"):
            return _zip(f)
        if kind == "ova" or kind == "archive" and path.lower().endswith(".tar"):
            return _tar(f)
        if kind == "vpk":
            return _vpk(f)
        if kind == "vmdk":
            return _vmdk(f, size, path)
        if kind == "qcow2":
            head = _at(f, 0, 72)
            if len(head) < 72 or head[:4] != b"QFI\xfb":
                raise ValueError("QCOW2 header not found")
            return [(whole, 0, max(struct.unpack_from(">Q", head, 24)[0], size), False)]
        if kind == "vhdx" and (size < 4096 or _at(f, 0, 8) != b"vhdxfile"):
            raise ValueError("VHDX header not found")
        if kind == "vdi" and (size < 512 or markers.VDI not in _at(f, 0, 512)):
            raise ValueError("VDI marker not found")
        if kind == "vhd" and (size < 512 or _at(f, size - 512, 8) != b"conectix"):
            raise ValueError("VHD footer not found")
    except (struct.error, tarfile.TarError, IndexError, UnicodeDecodeError) as e:
        raise ValueError(f"{kind}: {e}") from e
    return [(whole, 0, size, False)]


_LISTED = "source_path string, kind string, name string, offset long, size long, encrypted boolean, error string"


def _listed(rows: DataFrame, strict: bool, opened: Callable) -> DataFrame:
    """Entries of rows (source_path, a second column that opened() turns into a file, kind)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for path, what, kind in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    with opened(path, what) as f:
                        out += [(path, kind, *e, None) for e in list_entries(kind, f, f.seek(0, io.SEEK_END), path)]
                except (ValueError, OSError) as e:
                    if strict:
                        raise
                    out.append((path, kind, None, None, None, None, f"Container parse skipped: {e}"))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)], ["source_path", "kind", "name", "offset", "size", "encrypted", "error"])

    return rows.mapInArrow(scan, _LISTED)


def mount(evidence: DataFrame, strict: bool = False) -> DataFrame:
    """source_path, kind, name, offset, size, encrypted, error: entries of each container, from rows with whole contents.

    Sources of unknown kind have no rows. What can't be read is one row with error set, or ends the
    job if strict.
    """
    rows = evidence.select("source_path", "content", markers.container(F.col("content"), F.col("source_path")).alias("kind")).where("kind != 'unknown'")
    return _listed(rows, strict, lambda path, data: io.BytesIO(data))


def mount_files(files: DataFrame, strict: bool = False) -> DataFrame:
    """mount() of files (source_path) that executors open themselves; no file is read whole."""
    ends = ranged.edges(files, HEAD, TAIL)
    rows = ends.select("source_path", "length", markers.container(F.col("content"), F.col("source_path")).alias("kind")).where("kind != 'unknown'")
    return _listed(rows, strict, lambda path, _: open(path, "rb"))


def headers(ends: DataFrame) -> DataFrame:
    """What disk images say of themselves, from rows (source_path, content) with their ends (see ranged.edges).

    source_path, kind, creator and header_entropy (vhdx), virtual_size (vhd, qcow2), version, backing_offset
    and backing_size (qcow2), header_size and image_type (vdi); other sources have no rows.
    """
    c = F.col("content")
    rows = ends.select("source_path", "content", markers.container(c, F.col("source_path")).alias("kind")).where(F.col("kind").isin("vhdx", "vhd", "qcow2", "vdi"))
    footer = F.substring(c, F.octet_length(c) - 511, F.lit(TAIL))
    only = lambda kind, value: F.when(F.col("kind") == kind, value)
    creator = F.get(F.split(F.decode(F.substring(c, 9, 512), "UTF-16LE"), "\\x00"), F.lit(0))
    known = rows.select(
        "source_path", "kind", only("vhdx", creator).alias("creator"),
        only("vhd", int_be(footer, 48, 8)).alias("vhd_size"), only("qcow2", int_be(c, 24, 8)).alias("qcow2_size"),
        only("qcow2", int_be(c, 4, 4)).cast("long").alias("version"), only("qcow2", int_be(c, 8, 8)).alias("backing_offset"), only("qcow2", int_be(c, 16, 4)).cast("long").alias("backing_size"),
        only("vdi", int_le(c, 0x40, 4)).cast("long").alias("header_size"), only("vdi", int_le(c, 0x4C, 4)).cast("long").alias("image_type"),
    )
    entropy = profiles.entropy(rows.where("kind = 'vhdx'").select("source_path", F.substring(c, 1, HEAD).alias("content"))).withColumnRenamed("entropy", "header_entropy")
    known = known.join(entropy, "source_path", "left")
    return known.select("source_path", "kind", "creator", "header_entropy", F.coalesce("vhd_size", "qcow2_size").alias("virtual_size"), "version", "backing_offset", "backing_size", "header_size", "image_type")


def samples(spark: SparkSession) -> DataFrame:
    """One small container of three kinds."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("inside.txt", "hello")
    text = b'# Disk DescriptorFile\ncreateType="monolithicFlat"\nRW 2048 FLAT \\"disk-flat.vmdk\\" 0\n'
    qcow = b"QFI\xfb" + struct.pack(">I", 3) + bytes(16) + struct.pack(">Q", 33554432) + bytes(40)
    return spark.createDataFrame([("a.zip", held.getvalue()), ("b.vmdk", text), ("c.qcow2", qcow)], "source_path string, content binary")


def file_records(evidence: DataFrame) -> DataFrame:
    """NTFS file records: source_path, offset, record, in_use, is_dir, name, extension."""

    def parse(data: bytes, at: int) -> tuple | None:
        rec = data[at : at + 1024]
        if len(rec) < 0x30:
            return None
        usa, (first, flags), used, number = struct.unpack_from("<H", rec, 4)[0], struct.unpack_from("<HH", rec, 0x14), struct.unpack_from("<I", rec, 0x18)[0], struct.unpack_from("<I", rec, 0x2C)[0]
        if usa < 0x28 or usa >= len(rec) or first < 0x20:
            return None
        rec = rec[: max(0x30, min(used, len(rec)))]
        name = None
        while first + 24 <= len(rec) and name is None:
            kind, size = struct.unpack_from("<II", rec, first)
            if kind == 0xFFFFFFFF or size < 24 or first + size > len(rec):
                break
            if kind == 0x30 and not rec[first + 8]:
                value = first + struct.unpack_from("<H", rec, first + 20)[0]
                if value + 66 <= len(rec):
                    text = rec[value + 66 : value + 66 + 2 * rec[value + 64]].decode("utf-16-le", "replace").strip("\0")
                    name = text or None
            first += size
        folder = bool(flags & 2)
        ext = "dir" if folder else name.rsplit(".", 1)[1].lower() if name and "." in name else "mft"
        return at, number, bool(flags & 1), folder, name or f"ntfs_mft_record_{number}", ext

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = (data or b"").find(b"FILE")
                while at >= 0:
                    if got := parse(data, at):
                        out.append((path, *got))
                    at = data.find(b"FILE", at + 4)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)], ["source_path", "offset", "record", "in_use", "is_dir", "name", "extension"])

    return evidence.select("source_path", "content").mapInArrow(scan, "source_path string, offset long, record long, in_use boolean, is_dir boolean, name string, extension string")
