"""Evidence operators on hand-built bytes."""

import io
import struct
import tarfile
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from tracehound.functions import binary
from tracehound.operators import containers, markers, profiles, raid, reports, scoring, signatures
from tracehound.plans import catalog


def rows(spark, *pairs):
    return spark.createDataFrame([(p, bytearray(d)) for p, d in pairs], "source_path string, content binary")


def test_magic_and_profiles(spark):
    assert signatures.parse_magic("ff d8 ?? e0") == (b"\xff\xd8\x00\xe0", [True, True, False, True])
    for bad in ("", "f", "gg"):
        with pytest.raises(ValueError):
            signatures.parse_magic(bad)
    ids = {r.id for r in signatures.builtin(spark, "strict").collect()}
    assert "sig-generated-0001" not in ids and "sig-any-0001" not in ids and len(ids) == signatures.builtin(spark, "broad").count() - 2


def test_positions(spark):
    data = bytes(4096) + bytes.fromhex("ffd8ffe000104a464946") + bytes(4096)
    tar = bytes(300) + b"ustar" + b"\x00\xff" + b"ustar"
    got = {tuple(r) for r in signatures.positions(rows(spark, ("a", data), ("b", tar), ("c", b""), ("d", b"GIF8\n7a GIF8xa")), signatures.builtin(spark)).collect()}
    assert got == {("a", 4096, 4096, "sig-common-0001"), ("b", 300, 43, "sig-tar-0001"), ("b", 307, 50, "sig-tar-0001"), ("d", 8, 8, "sig-gif-0001")}


def test_entropy_windows(spark):
    data = bytearray(4096)
    for k in (0, 1024, 3072):
        data[k : k + 4] = b"FILE"
    data[2048:3072] = bytes((i * 17 ^ (i >> 2)) & 255 for i in range(1024))
    e = [r.entropy for r in profiles.rolling_entropy(rows(spark, ("x", data)), 1024, 1024).orderBy("window_start").collect()]
    assert e[0] < 1 and e[1] < 1 and e[2] == 8.0 and e[3] < 1
    assert profiles.entropy(rows(spark, ("x", b""))).first().entropy == 0


def test_file_records(spark):
    def record(number, flags, name=None):
        r = bytearray(1024)
        r[:4] = b"FILE"
        struct.pack_into("<H", r, 4, 0x30)
        struct.pack_into("<HH", r, 0x14, 0x38, flags)
        struct.pack_into("<I", r, 0x18, 0x200)
        struct.pack_into("<I", r, 0x2C, number)
        if name:
            text = name.encode("utf-16-le")
            struct.pack_into("<II", r, 0x38, 0x30, 24 + 66 + len(text))
            struct.pack_into("<IH", r, 0x48, 66 + len(text), 24)
            r[0x38 + 24 + 64] = len(name)
            r[0x38 + 24 + 66 : 0x38 + 24 + 66 + len(text)] = text
        else:
            struct.pack_into("<I", r, 0x38, 0xFFFFFFFF)
        return bytes(r)

    got = containers.file_records(rows(spark, ("d", record(42, 0, "secret.docx")), ("a", bytes(4096) + record(7, 1)))).collect()
    assert {tuple(r) for r in got} == {("d", 0, 42, False, False, "secret.docx", "docx"), ("a", 4096, 7, True, False, "ntfs_mft_record_7", "mft")}


def test_containers(spark):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("inside.txt", "hello")
    tree = b"txt\0 \0file\0" + struct.pack("<IHHIIH", 0, 0, 0x7FFF, 0, 5, 0xFFFF) + b"\0\0\0"
    vpk = struct.pack("<7I", 0x55AA1234, 2, len(tree), 5, 0, 0, 0) + tree + b"hello"
    data = rows(spark, ("z.zip", held.getvalue()), ("bad.zip", b"not-a-valid-zip"), ("p.vpk", vpk), ("disk.vhd", bytes(3584) + b"conectix" + bytes(504)), ("t.txt", b"x"))
    got = {r.source_path: r for r in containers.mount(data).collect()}
    assert set(got) == {"z.zip", "bad.zip", "p.vpk", "disk.vhd"}
    assert (got["z.zip"].name, got["z.zip"].size, held.getvalue()[got["z.zip"].offset :][:5]) == ("inside.txt", 5, b"hello")
    assert "Container parse skipped" in got["bad.zip"].error and (got["p.vpk"].name, got["p.vpk"].offset) == ("file.txt", 28 + len(tree))
    with pytest.raises(Exception, match="ZIP open failed"):
        containers.mount(data, strict=True).collect()


def test_tar_members(spark, tmp_path):
    held = io.BytesIO()
    with tarfile.open(fileobj=held, mode="w") as t:
        for name, data in (("a.txt", b"hello"), ("d/b.bin", bytes(3000))):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    (tmp_path / "x.ova").write_bytes(held.getvalue())
    want = {("a.txt", 0, 5), ("d/b.bin", 0, 3000)}
    assert {(r.name, r.offset, r.size) for r in containers.mount(rows(spark, ("x.tar", held.getvalue()))).collect()} == want
    files = spark.createDataFrame([(str(tmp_path / "x.ova"),)], "source_path string")
    assert {(r.name, r.offset, r.size) for r in containers.mount_files(files).collect()} == want


def test_disk_headers(spark):
    vhdx = b"vhdxfile" + "QEMU v1".encode("utf-16-le") + bytes(4096 - 22) + b"\xff" * 100
    got = {r.source_path: r for r in containers.headers(rows(spark, ("a", vhdx), ("b.vhdx", b""), ("c", bytes(600)), ("d.vdi", b"x"), ("e", b"QFI\xfb"))).collect()}
    assert set(got) == {"a", "b.vhdx", "d.vdi", "e"} and got["a"].creator == "QEMU v1" and 0 < got["a"].header_entropy < 0.2
    assert got["e"].version is None and got["d.vdi"].image_type is None and got["b.vhdx"].header_entropy == 0
    bad = containers.mount(rows(spark, ("d.vdi", bytes(600)), ("e.vdi", markers.VDI + bytes(600)))).collect()
    assert {r.source_path: r.error is None for r in bad} == {"d.vdi": False, "e.vdi": True}


def test_markers_and_numbers(spark):
    data = rows(spark, ("a", b"\x00\xff-FVE-FS-"), ("b", b"LUKS"), ("c", b"xxFileVault"), ("key.RKEY", b""))
    assert [r[0] for r in data.orderBy("source_path").select(markers.encryption(F.col("content"), F.col("source_path"))).collect()] == ["bitlocker", "none", "filevault", "keyfile"]
    r = rows(spark, ("n", bytes([1, 2, 255, 255, 255, 255, 255, 255, 255, 255]))).select(binary.int_le(F.col("content"), 0, 2), binary.int_be(F.col("content"), 0, 2), binary.int_le(F.col("content"), 2, 8), binary.int_le(F.col("content"), 9, 2)).first()
    assert tuple(r) == (513, 258, 2**64 - 1, None)
    line = rows(spark, ("n", bytes.fromhex("4142434400ff"))).select(binary.hex_line(F.col("content"), F.lit(0x20))).first()[0]
    assert line.startswith("00000020  41 42 43 44 00 ff") and line.endswith("ABCD..")


def test_identity(spark):
    name = "fp||4096|sig-common-0001|Deep"
    got = spark.range(1).select(reports.finding_id(F.lit("fp"), F.lit(None).cast("string"), F.lit(4096), F.lit("sig-common-0001"), "Deep")).first()[0]
    assert got == str(uuid.uuid5(uuid.UUID(reports.NAMESPACE), name))


def test_parity_slots(spark):
    got = spark.range(6).select(raid.parity_slot(F.col("id"), 3, "left_symmetric"), raid.parity_slot(F.col("id"), 3, "right_symmetric")).collect()
    assert [tuple(r) for r in got] == [(2, 0), (1, 1), (0, 2)] * 2


def test_catalog_is_whole():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL) and len(catalog.QUERIES) >= 25


def test_classifier_score_of_256_bytes(spark, tmp_path):
    texts = ["a" * 64 + "".join(map(chr, range(33, 127))) * 3, "é" * 127 + "xyz tail", "", None, "short"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.source_path: r.score for r in catalog.QUERIES["classifier_score"](spark, str(tmp_path)).collect()}
    assert got == {f"documents/{i}": round(scoring.learned("pdf", (t or "").encode(), 0), 5) for i, t in enumerate(texts)}
    assert got["documents/2"] == got["documents/3"] == 0 and scoring.learned("pdf", texts[0].encode(), 0) != scoring.learned("pdf", texts[0].encode()[:64], 0)
