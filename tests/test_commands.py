"""Ranged reading, streams, arrays, damaged containers and recovery on files."""

import hashlib
import json
import os
import struct
import time

import pytest
from pyspark.sql import functions as F

from tracehound import commands
from tracehound.operators import audit, healer, raid, recovery, report_files, scoring, signatures
from tracehound.sources import ranged
from tracehound.streaming import carry, progress


def put(folder, name, data):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    return str(path)


def test_ranges_and_block(spark, tmp_path):
    data = bytes(range(256)) * 40
    a = put(tmp_path, "d/a.img", data)
    put(tmp_path, "d/empty.img", b"")
    os.symlink(a, tmp_path / "d/link.img")
    got = {r.chunk_start: bytes(r.content) for r in ranged.chunks(spark, [str(tmp_path / "d"), a], 1024, 16).collect()}
    assert got == {k: data[k : k + 1040] for k in range(0, len(data), 1024)}
    assert ranged.block(spark, a, 5000, 3000) == data[5000:8000] and ranged.block(spark, a, 10000, 3000) == data[10000:]
    for bad in ([str(tmp_path / "none")], []):
        with pytest.raises(Exception):
            ranged.chunks(spark, bad, 1024).collect()
    with pytest.raises(ValueError):
        ranged.block(spark, a, 0, (64 << 20) + 1)


def test_chunked_carving_equals_whole(spark, tmp_path):
    data = bytearray(40_000)
    for at in (0, 1020, 2046, 3071, 20_479):
        data[at : at + 4] = bytes.fromhex("ffd8ffe0")
    path = put(tmp_path, "x.img", bytes(data))
    table = signatures.builtin(spark)
    whole = spark.createDataFrame([(path, data)], "source_path string, content binary")
    want = {(r.offset, r.signature_id) for r in signatures.positions(whole, table).collect()}
    got = [(r.offset, r.signature_id) for r in signatures.carve_chunks(ranged.chunks(spark, [path], 1024, scoring.REACH), table, 1024).collect()]
    assert len(got) == 5 and set(got) == want


def test_scores():
    pdf = b"%PDF-1.7\n1 0 obj\n<<>>\nendobj\nxref\n0 1\n%%EOF"
    assert scoring.structure("sig-common-0009", pdf, 0) == 0.96
    assert scoring.structure("sig-common-0001", b"\xff\xd8\xff\xe0" + bytes(16) + b"\xff\xd9", 0) == 0.92
    assert scoring.structure("x", b"", 0) == 0.45 and scoring.structure("x", b"", 0, True) == pytest.approx(0.3825)
    assert 0.2 < scoring.learned("sig-common-0009", pdf, 0) <= 1 and scoring.learned("x", b"", 0) == 0


def test_stream_equals_batch(spark, tmp_path):
    data = bytearray(5000)
    for at in (0, 98, 199, 1023, 4990):
        data[at : at + 4] = bytes.fromhex("ffd8ffe0")
    cuts = [0, 100, 101, 200, 1024, 1025, 4992, 5000]
    feed = tmp_path / "feed"
    kind = "source_path string, chunk_start long, content binary"
    for a, e in zip(cuts, cuts[1:]):
        spark.createDataFrame([("s", a, data[a:e]), ("s", a, data[a:e])], kind).coalesce(1).write.mode("append").parquet(str(feed))
    rows = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(feed))
    hits = carry.carve_stream(rows, signatures.builtin(spark))
    query = hits.writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(r.offset for r in spark.table("hits").collect())
    assert got == [0, 98, 199, 1023, 4990]


def test_latest_by_key(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 1, "c")], "k int, seq int, v string")
    later = spark.createDataFrame([(1, 6, "x"), (2, 2, "y")], "k int, seq int, v string")
    assert {tuple(r) for r in carry.latest_by_key(later, rows, "k", ["seq"]).collect()} == {(1, 7, "b"), (2, 2, "y")}


def member(index, level=5, expected=3):
    data = bytearray(8192)
    data[4096:4100] = b"\xfc\x4e\x2b\xa9"
    data[4096 + 0x20 : 4096 + 0x29] = b"md-test-0"
    for at, x in ((0x48, level), (0x58, 64), (0x5C, expected), (0x90, index)):
        struct.pack_into("<I", data, 4096 + at, x)
    return bytes(data)


def test_array_detection(spark, tmp_path):
    paths = [put(tmp_path, f"m{k}.img", member(k)) for k in (0, 2)]
    r = commands.detect(spark, paths).first()
    assert (r.detected, r.controller, r.mode, r.stripe_size, r.expected_members, r.detected_members, r.degraded) == (True, "mdadm", "raid5", 65536, 3, 2, True)
    assert r.missing == ["Missing member slot #1"]
    for data, family in ((b"....PRIVHEAD....", "windows_dynamic"), (b"MSFT Storage Spaces metadata", "windows_storage_spaces"), (b"", "unknown"), (b"nothing", "unknown")):
        probes = raid.probe(spark.createDataFrame([("x", bytearray(data))], "source_path string, content binary"))
        assert probes.first().family == family
        assert raid.detect(probes).first().detected == (family != "unknown")


def split5(logical, stripe, n):
    disks, at = [bytearray() for _ in range(n)], 0
    for k in range(len(logical) // (stripe * (n - 1))):
        parity_at, chunks = n - 1 - k % n, {}
        for d in range(1, n):
            chunks[(parity_at + d) % n] = logical[at : at + stripe]
            at += stripe
        x = bytearray(stripe)
        for c in chunks.values():
            x = bytearray(p ^ q for p, q in zip(x, c))
        chunks[parity_at] = x
        for d in range(n):
            disks[d] += chunks[d]
    return disks


@pytest.mark.parametrize("stripe, size", [(4, 24), (512, 6 << 20)])
def test_reconstruct_raid5(spark, tmp_path, stripe, size):
    logical = b"ABCDWXYZ1234QRSTuvwxLMNO" if size == 24 else os.urandom(size)
    disks = split5(logical, stripe, 3)
    a, c = put(tmp_path, "0.img", bytes(disks[0])), put(tmp_path, "2.img", bytes(disks[2]) + b"tail"[: stripe - 1])
    out = str(tmp_path / "out.img")
    got = commands.reconstruct(spark, [a, "missing", c], "raid5", stripe, out)
    assert got["reconstructed_missing_members"] == 1 and open(out, "rb").read() == logical


def test_reconstruct_others(spark, tmp_path):
    a, b = put(tmp_path, "a", b"AAAACCCCEEEEGGGG"), put(tmp_path, "b", b"BBBBDDDDFFFFHHHH")
    out = str(tmp_path / "out")
    commands.reconstruct(spark, [a, b], "raid0", 4, out)
    assert open(out, "rb").read() == b"AAAABBBBCCCCDDDDEEEEFFFFGGGGHHHH"
    commands.reconstruct(spark, ["-", b], "raid1", 4, out)
    assert open(out, "rb").read() == b"BBBBDDDDFFFFHHHH"
    for args in (([], "raid0", 4), ([a], "raid6", 4), ([a, "-", "-"], "raid5", 4), ([a], "raid0", 0)):
        with pytest.raises(ValueError):
            commands.reconstruct(spark, *args, out)


def test_healer(spark):
    noise = bytes((i * 17 ^ (i >> 8) * 31) & 255 for i in range(8192))
    cases = {
        "ntfs": (bytes(5000) + b"\xebR\x90NTFS ", 5000), "hfs_plus": (bytes(2000) + b"H+\x00\x04", 976), "apfs": (bytes(70) + b"NXSB", 70), "squashfs": (b"hsqs", 0),
        "tar": (bytes(300) + b"ustar", 43), "vhdx_header": (bytes(131072) + b"head" + bytes(5000), 0), "tail": (b"", 0),
    }
    cases["cipher"] = (noise + b"hsqs", 8192)
    got = {r.source_path: (r.found, r.offset) for r in healer.heal(spark.createDataFrame([(k, bytearray(d)) for k, (d, _) in cases.items()], "source_path string, content binary")).collect()}
    assert got == {k: ("squashfs" if k == "cipher" else k, at) for k, (_, at) in cases.items()}


ITEMS = "id string, source_path string, fp string, container string, hint string, offset long, size long, length long, sig string, name string, extension string"


def test_recover_resume_preserve_collision(spark, tmp_path):
    src = put(tmp_path, "s/src.img", bytes(range(65, 91)))
    dest, log = tmp_path / "out", str(tmp_path / "log")
    items = spark.createDataFrame([("a1", src, "fp-a", None, None, 0, 100, 26, "x", "one", "bin"), ("b1", src, "fp-b", None, None, 2, 4, 26, "x", "one", "bin"), ("c1", src, "", None, None, 99, 4, 26, "x", "far", "bin"), ("d1", src, "fp-d", None, None, 5, 3, 26, "x", "two.txt", ".TXT")], ITEMS)
    run = lambda **k: {r.manifest_key: r for r in recovery.recover(items, str(dest), log, [src], **k).collect()}
    first = run()
    assert {k: r.state for k, r in first.items()} == {"fp-a||0|x|a1": "copied", "fp-b||2|x|b1": "dropped", "fp-d||5|x|d1": "copied"}
    whole = (dest / "one.bin").read_bytes()
    assert whole == bytes(range(65, 91)) and first["fp-a||0|x|a1"].sha256 == hashlib.sha256(whole).hexdigest() and (dest / "two_txt.txt").read_bytes() == b"FGH"
    assert {r.state for r in run().values()} == {"reused", "dropped"}
    # an entry that isn't complete, keyed by id alone, goes on from what is there
    old = str(tmp_path / "old")
    spark.createDataFrame([("a1", src, 0, 26, 10, str(dest / "one.bin"), False, None, "failed", None)], recovery.MANIFEST).withColumn("updated_at", F.current_timestamp()).write.parquet(f"{old}/runs/0")
    (dest / "one.bin").write_bytes(bytes(range(65, 75)))
    again = {r.state: r for r in recovery.recover(items.where("id = 'a1'"), str(dest), old, [src]).collect()}
    assert again["resumed"].completed and again["resumed"].bytes_written == 26 and (dest / "one.bin").read_bytes() == whole
    # no entry, but a file: left alone unless overwritten
    (dest / "one.bin").write_bytes(b"mine")
    assert {r.state for r in recovery.recover(items.where("id = 'a1'"), str(dest), str(tmp_path / "l2"), [src]).collect()} == {"skipped"} and (dest / "one.bin").read_bytes() == b"mine"
    kept = items.where("id = 'a1'").withColumn("hint", F.lit("../folderA/folderB/recovered.txt"))
    recovery.recover(kept, str(dest), str(tmp_path / "l3"), [src], preserve=True)
    assert (dest / "fp-a/folderA/folderB/recovered.txt").read_bytes() == whole
    with pytest.raises(ValueError):
        recovery.safe_destination(str(tmp_path / "s/in"), [str(tmp_path / "s")])


def test_scan_and_hex(spark, tmp_path):
    img = bytes(128) + bytes.fromhex("ffd8ffe0") + bytes(128)
    put(tmp_path, "in/a.img", img)
    put(tmp_path, "in/b.img", b"-FVE-FS-" + img)
    got = commands.scan(spark, [str(tmp_path / "in"), f" {tmp_path}/in "]).collect()
    assert [(os.path.basename(r.source_path), r.offset, r.sig, r.encryption_state) for r in got] == [("a.img", 128, "sig-common-0001", "unencrypted"), ("b.img", 136, "sig-common-0001", "encrypted_detected")]
    assert len({r.id for r in got}) == 2
    for bad in (commands.Options(chunk=10), commands.Options(bypass=True), commands.Options(mode="x")):
        with pytest.raises(ValueError):
            commands.scan(spark, [str(tmp_path)], bad)
    text = "\n".join(r.line for r in commands.hex_dump(spark, put(tmp_path, "h", bytes(32) + b"ABCD\x00\xff"), 32, 64).collect())
    assert text.startswith("00000020") and "41 42 43 44 00 ff" in text
    assert commands.sources_of(["a.img", " ", "b.img"], "a.img") == ["a.img", "b.img"]
    assert len(commands.warnings_of(commands.Options(synology=True, read_only=False))) == 2
    healed = commands.mount(spark, put(tmp_path, "v/bad.vhdx", bytes(300) + b"hsqs"), heal=True).collect()
    assert [(r.kind, r.name, r.offset) for r in healed] == [("healed", "squashfs", 300)]


def test_only_asked_ranges_are_read(spark, tmp_path):
    big = put(tmp_path, "big.img", bytes(10 << 20))
    small = [put(tmp_path, f"s/{k:03d}", b"x" * 10) for k in range(40)]
    reader = lambda **o: ranged._Reader({"path": "\n".join([big, *small]), **{k: str(v) for k, v in o.items()}})
    pieces = lambda r: [p for x in r.partitions() for p in x.pieces]
    assert sum(e - a for _, a, e, _ in pieces(reader(chunk=1 << 20))) == (10 << 20) + 400 and len(reader(chunk=1 << 20).partitions()) <= 5
    head = pieces(reader(chunk=1 << 20, stop=1 << 20))
    assert [p for p in head if p[0] == big] == [(big, 0, 1 << 20, 10 << 20)] and len(head) == 41
    assert [p[1:3] for p in pieces(reader(chunk=1024, start=5000, stop=5100)) if p[0] == big] == [(4096, 5100)]
    ends = ranged._Reader({"path": big, "chunk": "4096", "stop": "4096", "tail": "5000"})
    assert pieces(ends) == [(big, 0, 4096, 10 << 20), (big, ((10 << 20) - 5000) // 4096 * 4096, 10 << 20, 10 << 20)]
    assert [len(c) for x in ends.partitions() for *_, c in ends.read(x)] == [4096, 4096, 4096]
    assert ranged._Reader({"path": big, "chunk": "1024", "stop": "2000", "tail": str(10 << 20)}).spans(10 << 20) == [(0, 10 << 20)]


def test_one_pass_finder():
    table = [signatures.Compiled(k, 0, *signatures.parse_magic(m), 0, c) for k, m, c in (("a", "41 42", b"AB"), ("b", "41 42 43", b"ABC"), ("c", "42 ?? 44", b"B"), ("d", "41 42", b"AB"))]
    found = {(s.id, hit) for s, hit in signatures.Finder(table).matches(b"xABCDABx\xff\x00")}
    assert found == {("a", 1), ("a", 5), ("b", 1), ("c", 2), ("d", 1), ("d", 5)} and not list(signatures.Finder([]).matches(b"AB"))


def test_user_signatures_and_classifier(spark, tmp_path):
    (tmp_path / "sig.json").write_text('[{"id": "own-1", "name": "Own", "extension": "own", "magic": "de c0 ?? de", "offset": 0, "category": "mine"}, {"id": "own-2", "name": "Two", "extension": "x", "magic": "01", "offset": 4, "category": "mine", "default_size": 9}]')
    assert tuple(commands.signature_summary(spark, str(tmp_path / "sig.json")).first()) == (2, 4) and commands.signature_summary(spark).first().signatures == 14
    src = put(tmp_path, "in/a.img", bytes(50) + b"\xde\xc0\x07\xde" + bytes(50))
    got = commands.scan(spark, [src], commands.Options(mode="deep"), signatures.from_json(spark, str(tmp_path / "sig.json")), classifier=lambda sig, data, hit: 1.0).collect()
    assert [(r.sig, r.offset, r.extension) for r in got] == [("own-1", 50, "own")] and got[0].validation_score == pytest.approx(0.7 * 0.45 + 0.3)
    (tmp_path / "bad.json").write_text('[{"id": "x", "name": "n", "extension": "e", "magic": "zz", "offset": 0, "category": "c"}]')
    with pytest.raises(ValueError):
        commands.signature_summary(spark, str(tmp_path / "bad.json"))


def test_disk_extents_are_carved(spark, tmp_path):
    put(tmp_path, "vm/disk-flat.img", bytes(2000) + bytes.fromhex("89504e470d0a1a0a") + bytes(100))
    disk = put(tmp_path, "vm/disk.vmdk", b'# Disk DescriptorFile\ncreateType="monolithicFlat"\nRW 5 FLAT "disk-flat.img" 0\nRW 5 FLAT "gone.img" 0\n')
    got = commands.scan(spark, [disk]).collect()
    assert [(os.path.basename(r.source_path), r.container, r.offset, r.sig, r.length) for r in got] == [("disk-flat.img", "disk-flat.img", 2000, "sig-common-0003", 2108)]
    assert got[0].evidence_path == disk


def test_report_files(spark, tmp_path):
    img = bytes(64) + bytes.fromhex("ffd8ffe0") + bytes(64)
    put(tmp_path, "in/a.img", img)
    put(tmp_path, "in/b.img", b"-FVE-FS-" + img)
    put(tmp_path, "in/bad.zip", b"no zip")
    report = commands.scan_report(spark, [str(tmp_path / "in")], str(tmp_path / "report"), commands.Options(synology=True, adapters="hybrid"))
    head = report.head.first()
    m = head.metadata
    assert (m.quick_hits, m.deep_hits, m.container_hits, m.bytes_scanned, m.container_type) == (0, 2, 0, 2 * len(img) + 14, "archive")
    assert m.volume_layers == ["physical", "raid_virtual", "encrypted_volume", "filesystem"] and m.adapter_capabilities[0] == "native-core:available:n/a" and len(m.adapter_capabilities) == 5
    said = [r.warning for r in report.warnings.collect()]
    assert sum("unavailable" in w for w in said) == 4 and any("3 file(s)" in w for w in said) and any("bitlocker" in w for w in said) and any("ZIP open failed" in w for w in said) and commands.SYNOLOGY in said
    again = report_files.read(spark, str(tmp_path / "report"))
    assert sorted(map(tuple, again.findings.collect())) == sorted(map(tuple, report.findings.collect())) and head.scan_id.startswith("scan-") and head.finished_at >= head.started_at
    rows = report_files.top(again.findings, 1).collect()
    assert [(os.path.basename(r.source_path), r.offset) for r in rows] == [("a.img", 64)] and report_files.find(again.findings, rows[0].id).count() == 1
    with pytest.raises(ValueError):
        commands.recover_report(spark, str(tmp_path / "report"), str(tmp_path / "out"), str(tmp_path / "log"))  # same device
    done = commands.recover_report(spark, str(tmp_path / "report"), str(tmp_path / "out"), str(tmp_path / "log"), other_device=False).collect()
    assert {r.state for r in done} == {"copied"} and len(done) == 2


def test_merged_reports(spark, tmp_path):
    def doc(k, findings, **more):
        head = {"scan_id": f"s{k}", "started_at": f"2024-01-0{k}T00:00:00Z", "finished_at": f"2024-01-0{9 - k}T00:00:00Z", "source": f"/{k}", "sources": [f"/{k}", "/x"], "mode": "deep", "warnings": [f"w{k}"], "metadata": {"bytes_scanned": 10, "elapsed_ms": 5, "quick_hits": 1, "deep_hits": 2, "container_hits": 3, **more}}
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps({**head, "findings": findings}, indent=2))
        return report_files.read(spark, str(path))

    f = lambda id_, offset, container=None: {"id": id_, "display_name": "n", "extension": "e", "signature_id": "s", "source_path": "/a", "container_path": container, "offset": offset, "size": 1, "confidence": 0.5, "category": "c"}
    a, b = doc(1, [f("1", 9), f("2", 3)]), doc(2, [f("3", 9, "in"), f("4", 1)], container_type="vmdk", volume_layers=["physical"])
    merged = report_files.merge([a, b])
    head = merged.head.first()
    assert (head.scan_id, head.source, head.sources, head.metadata.bytes_scanned, head.metadata.container_hits, head.metadata.container_type, head.metadata.volume_layers) == ("s1-merged", "/1", ["/1", "/x", "/2"], 20, 6, "vmdk", ["physical"])
    assert head.finished_at.day == 8 and head.started_at.day == 1 and {r.warning for r in merged.warnings.collect()} == {"w1", "w2"}
    assert [r.id for r in merged.findings.collect()] == ["4", "2", "1"] and [r.id for r in report_files.merge([a, b], keep_containers=True).findings.collect()] == ["4", "2", "1", "3"]
    one = a.findings.first()
    assert (one.source_fingerprint, one.validation_score, one.encryption_state) == ("", 0.0, "unknown")
    with pytest.raises(ValueError):
        report_files.merge([])


def test_audit_log(spark, tmp_path):
    path = str(tmp_path / "audit.log")
    for k in range(3):
        audit.append(path, "unlock_request", {"targets": [f"/dev/é{k}"], "accepted": bool(k)}, key="k1" if k == 2 else None)
    got = audit.check(spark, path).orderBy("seq").collect()
    assert [(r.linked, r.hash_valid, r.signature_valid) for r in got] == [(True, True, True), (True, True, True), (True, True, False)]
    assert audit.check(spark, path, "k1").orderBy("seq").collect()[2].signature_valid
    lines = open(path, encoding="utf-8").read().split("\n")
    lines[1] = lines[1].replace("é1", "é9")
    open(path, "w", encoding="utf-8").write("\n".join([lines[0], "", *lines[1:]]))
    got = audit.check(spark, path).orderBy("seq").collect()
    assert [r.hash_valid for r in got] == [True, False, True] and all(r.linked for r in got)


def test_progress_tracker():
    told, now = [], [0.0]
    t = progress.Tracker("carve", 200, told.append, lambda: now[0])
    for size in (1, 1, 50, 100, 100):
        now[0] += 1
        t.add(size)
    t.finish("done")
    assert [(u.percent, u.processed_bytes, u.eta_seconds) for u in told] == [(1, 2, 198), (26, 52, 9), (76, 152, 1), (100, 200, 0), (100, 200, 0)]


def test_progress_of_a_stream(spark, tmp_path):
    feed = tmp_path / "feed"
    for k in range(3):
        spark.createDataFrame([("s", k * 100, bytearray(100))], "source_path string, chunk_start long, content binary").coalesce(1).write.mode("append").parquet(str(feed))
    told = []
    listener = progress.Listener(progress.Tracker("stream", 300, told.append))
    spark.streams.addListener(listener)
    try:
        rows = progress.observed(spark.readStream.schema("source_path string, chunk_start long, content binary").option("maxFilesPerTrigger", 1).parquet(str(feed)))
        query = rows.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        end = time.time() + 20
        while (not told or told[-1].percent < 100) and time.time() < end:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert told[-1].percent == 100 and told[-1].processed_bytes == 300


def test_syndrome_and_small_helpers(spark):
    rows = spark.createDataFrame([(1, bytearray(b"\x01\x02\x03\x04")), (1, bytearray(b"\x10\x20\x30\x40")), (2, bytearray(b"\xff" * 4)), (3, None)], "stripe long, content binary").repartition(3)
    got = {r.stripe: bytes(r.syndrome) for r in raid.syndrome(rows, "stripe", 4).collect()}
    assert got == {1: b"\x11\x22\x33\x44", 2: b"\xff" * 4, 3: bytes(4)}
    with pytest.raises(ValueError):
        raid.syndrome(rows, "stripe", 6)
    assert raid.default_shr(4) == {"mode": "shr", "chunk_size": 65536, "disk_count": 4}
    assert commands.source_key("A/b", True) == "a\\b" and commands.sources_of(["C:/x", "c:\\X"], windows=True) == ["C:/x"] and commands.raw_device("\\\\.\\PhysicalDrive0") and not commands.raw_device("/dev/sda")
    assert commands.capabilities(spark).count() == 1 and commands.capabilities(spark, "external_preferred").count() == 6 and commands.file_systems(spark).where("parsed").count() == 1
    with pytest.raises(ValueError):
        commands.Options(unlock_with="x", detect_only=True).check()


def test_large_containers_are_not_read_whole(spark, tmp_path):
    """A sparse disk image of 3 GiB: more than a row can hold."""
    big = put(tmp_path, "in/big.qcow2", b"QFI\xfb" + struct.pack(">I", 3) + bytes(16) + struct.pack(">Q", 1 << 40) + bytes(40))
    os.truncate(big, 3 << 30)
    foot = put(tmp_path, "in/disk.vhd", b"")
    os.truncate(foot, (3 << 30) - 512)
    with open(foot, "ab") as f:
        f.write(b"conectix" + bytes(504))
    got = {os.path.basename(r.source_path): (r.kind, r.name, r.size, r.error) for r in commands.mount(spark, str(tmp_path / "in")).collect()}
    assert got == {"big.qcow2": ("qcow2", "big.qcow2", 1 << 40, None), "disk.vhd": ("vhd", "disk.vhd", 3 << 30, None)}
    hidden = put(tmp_path, "heal/x.vhdx", b"")
    os.truncate(hidden, 5 << 20)
    with open(hidden, "r+b") as f:
        f.seek((4 << 20) + 100)
        f.write(b"NXSB")
    os.truncate(hidden, 3 << 30)
    healed = commands.mount(spark, hidden, heal=True).collect()
    assert [(r.kind, r.name, r.offset) for r in healed] == [("healed", "apfs", (4 << 20) + 100)]
