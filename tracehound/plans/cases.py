"""Queries over evidence that is built from whole tables: one case a row, so that SQL can say what must come out."""

from __future__ import annotations

import io
import struct
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehound import commands
from tracehound.functions import binary
from tracehound.operators import audit, containers, healer, markers, raid, recovery, report_files, reports, scoring, signatures
from tracehound.plans.catalog import _documents, _pages, _query, _table
from tracehound.sources import evidence


def _built(df: DataFrame, fn: Callable[[int, bytes], tuple[str, bytes]]) -> DataFrame:
    """Evidence rows made by fn from (doc_id, text as bytes)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [fn(k, (t or "").encode()) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["source_path", "content"])

    return df.select("doc_id", "text").mapInArrow(build, "source_path string, content binary")


def _chunked(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """source_path, chunk_start, content: evidence rows cut as ranged sources are."""
    ranges = evidence.chunk_ranges(rows.withColumn("length", F.octet_length("content").cast("long")), "length", chunk, overlap)
    return ranges.select("source_path", "chunk_start", F.substring(F.col("content"), (F.col("chunk_start") + 1).cast("int"), (F.col("chunk_end") - F.col("chunk_start")).cast("int")).alias("content"))


@_query(
    """WITH p AS (SELECT 'pages/' || page_id AS source_path, hex(encode(html)) AS h, octet_length(encode(html)) AS n FROM pages),
    q AS (SELECT *, unnest(range(n)) AS hit FROM p),
    r AS (SELECT source_path, hit, h, substr(h, 2 * hit + 1, 18) AS w FROM q WHERE substr(h, 2 * hit + 1, 2) = '3C'),
    m AS (SELECT source_path, hit, h, CASE WHEN w = '3C21444F4354595045' THEN 'sig-html-0001' WHEN substr(w, 1, 14) = '3C736372697074' THEN 'sig-html-0002' WHEN substr(w, 1, 4) = '3C68' AND substr(w, 7, 2) = '3E' THEN 'sig-html-0003' END AS signature_id FROM r),
    y AS (SELECT source_path, hit, unnest(regexp_extract_all(substr(h, 2 * hit + 1, 512), '..')) AS v FROM m WHERE signature_id IS NOT NULL),
    c AS (SELECT source_path, hit, v, count(*) AS k FROM y GROUP BY ALL), n AS (SELECT source_path, hit, sum(k) AS n FROM c GROUP BY ALL),
    e AS (SELECT source_path, hit, -sum((k / n) * log2(k / n)) AS e, sum(CASE WHEN v BETWEEN '20' AND '7E' OR v IN ('0A', '0D') THEN k ELSE 0 END) / any_value(n) AS a FROM c JOIN n USING (source_path, hit) GROUP BY ALL),
    s AS (SELECT source_path, hit, least(greatest(0.55 * least(e / 8, 1) + 0.35 * least(greatest(0.6 * a + 0.4 * (1 - abs(a - 0.45)), 0), 1) + 0.05, 0), 1) AS learned FROM e)
    SELECT source_path, hit AS "offset", signature_id, round(0.7 * 0.45 + 0.3 * learned, 6) AS validation_score, round(least(0.62 + 0.38 * (0.7 * 0.45 + 0.3 * learned), 0.99) + 1e-9, 2) AS confidence FROM m JOIN s USING (source_path, hit) WHERE signature_id IS NOT NULL"""
)
def carve_scored_pages(spark, sf_dir):
    """What a deep scan does with each chunk: matches in chunks of 1,024 bytes, scored, each once."""
    parts = _chunked(_pages(spark, sf_dir), 1024, scoring.REACH)
    found = signatures.carve_chunks(parts, signatures.builtin(spark), 1024)
    return found.select("source_path", "offset", "signature_id", F.round("validation_score", 6).alias("validation_score"), "confidence")


_FORMATS = [("ffd8ffe0", "ffd9"), ("ffd8ffe1", ""), ("89504e470d0a1a0a", "49454e44ae426082"), ("255044462d", "0a31206f626a206f626a0a78726566"), ("255044462d", "20"), ("504b0304", "504b0506"), ("504b0304", ""), ("4b444d56" + "00" * 40, "")]


@_query(
    """WITH d AS (SELECT doc_id, doc_id % 8 AS k, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    s AS (SELECT doc_id, k, n, CASE k WHEN 0 THEN CASE WHEN n + 6 <= 512 THEN 0.92 ELSE 0.68 END WHEN 1 THEN CASE WHEN n = 0 THEN 0.5 ELSE 0.68 END
    WHEN 2 THEN CASE WHEN n + 16 <= 4096 THEN 0.95 ELSE 0.74 END WHEN 3 THEN CASE WHEN n + 20 <= 8192 THEN 0.96 WHEN n + 16 <= 8192 THEN 0.78 ELSE 0.58 END WHEN 4 THEN 0.58 WHEN 5 THEN CASE WHEN n + 8 <= 16384 THEN 0.93 ELSE 0.72 END WHEN 6 THEN CASE WHEN n = 0 THEN 0.5 ELSE 0.72 END
    ELSE CASE WHEN 40 / least(n + 44, 128) > 0.15 THEN 0.88 ELSE 0.69 END END AS s FROM d)
    SELECT 'f/' || doc_id AS source_path, ['sig-common-0001', 'sig-common-0002', 'sig-common-0003', 'sig-common-0009', 'sig-common-0009', 'sig-zip-0001', 'sig-zip-0001', 'sig-vmdk-0001'][k + 1] AS signature_id,
    round(0.7 * s, 6) AS validation_score FROM s"""
)
def structural_scores_documents(spark, sf_dir):
    """Scores of whole texts dressed as files of eight kinds, the learned part left out by a classifier of its own."""
    made = _built(_table(spark, sf_dir, "documents"), lambda k, t: (f"f/{k}", bytes.fromhex(_FORMATS[k % 8][0]) + t + bytes.fromhex(_FORMATS[k % 8][1])))
    found = signatures.carve_chunks(made.withColumn("chunk_start", F.lit(0).cast("long")), signatures.builtin(spark).where("extension != 'html'"), 1 << 30, classifier=lambda sig, data, hit: 0.0)
    return found.where("offset = 0").select("source_path", "signature_id", F.round("validation_score", 6).alias("validation_score"))


def _container(k: int, text: bytes) -> tuple[str, bytes]:
    kind, name = k % 5, f"doc-{k}.txt"
    held = io.BytesIO()
    if kind == 0:
        with zipfile.ZipFile(held, "w") as z:
            z.writestr(zipfile.ZipInfo(name), text)
        return f"c/{k}.zip", held.getvalue()
    if kind == 1:
        with tarfile.open(fileobj=held, mode="w", format=tarfile.USTAR_FORMAT) as t:
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text))
        return f"c/{k}.tar", held.getvalue()
    if kind == 2:
        tree = b"txt\0docs\0" + f"doc-{k}".encode() + b"\0" + struct.pack("<IHHIIH", 0, 0, 0x7FFF, 3, len(text), 0xFFFF) + b"\0\0\0"
        return f"c/{k}.vpk", struct.pack("<7I", 0x55AA1234, 2, len(tree), len(text), 0, 0, 0) + tree + text
    if kind == 3:
        return f"c/{k}.vmdk", f'# Disk DescriptorFile\nRW {k + 1} FLAT "doc-{k}.img" 0\n'.encode()
    return f"c/{k}.qcow2", b"QFI\xfb" + struct.pack(">I", 3) + bytes(16) + struct.pack(">Q", k) + bytes(40) + text


@_query(
    """SELECT 'c/' || doc_id || ['.zip', '.tar', '.vpk', '.vmdk', '.qcow2'][k + 1] AS source_path, ['archive', 'ova', 'vpk', 'vmdk', 'qcow2'][k + 1] AS kind,
    CASE k WHEN 2 THEN 'docs/doc-' || doc_id || '.txt' WHEN 3 THEN 'doc-' || doc_id || '.img' WHEN 4 THEN doc_id || '.qcow2' ELSE 'doc-' || doc_id || '.txt' END AS name,
    CASE k WHEN 0 THEN 38 + len(doc_id::VARCHAR) WHEN 2 THEN 28 + 9 + 5 + len(doc_id::VARCHAR) + 18 + 3 + 3 ELSE 0 END::BIGINT AS "offset",
    CASE k WHEN 3 THEN 512 * (doc_id + 1) WHEN 4 THEN greatest(doc_id, 72 + n) ELSE n END::BIGINT AS size FROM (SELECT doc_id, doc_id % 5 AS k, octet_length(encode(coalesce(text, ''))) AS n FROM documents)"""
)
def container_documents(spark, sf_dir):
    """Each text in a container of one of five kinds: what mounting lists."""
    return containers.mount(_built(_table(spark, sf_dir, "documents"), _container)).select("source_path", "kind", "name", "offset", "size")


def _disk(k: int, text: bytes) -> tuple[str, bytes]:
    if k % 4 == 0:
        return f"i/{k}.img", b"vhdxfile" + f"maker {k}".encode("utf-16-le").ljust(4096, b"\0") + text
    if k % 4 == 1:
        return f"i/{k}.img", text + (b"conectix" + bytes(40) + struct.pack(">Q", k << 33)).ljust(512, b"\0")
    if k % 4 == 2:
        return f"i/{k}.img", b"QFI\xfb" + struct.pack(">IQIIQ", k % 7, 3 * k, k % 100, 0, k << 40) + bytes(40) + text
    return f"i/{k}.img", (markers.VDI.ljust(0x40, b"\0") + struct.pack("<I", 400 + k) + bytes(8) + struct.pack("<I", k % 5)).ljust(512, b"\0") + text


@_query(
    """SELECT 'i/' || doc_id || '.img' AS source_path, ['vhdx', 'vhd', 'qcow2', 'vdi'][k + 1] AS kind, CASE WHEN k = 0 THEN 'maker ' || doc_id END AS creator,
    CASE k WHEN 1 THEN doc_id * 8589934592 WHEN 2 THEN doc_id * 1099511627776 END::DECIMAL(20, 0) AS virtual_size, CASE WHEN k = 2 THEN doc_id % 7 END::BIGINT AS version, CASE WHEN k = 2 THEN 3 * doc_id END::DECIMAL(20, 0) AS backing_offset, CASE WHEN k = 2 THEN doc_id % 100 END::BIGINT AS backing_size,
    CASE WHEN k = 3 THEN 400 + doc_id END::BIGINT AS header_size, CASE WHEN k = 3 THEN doc_id % 5 END::BIGINT AS image_type FROM (SELECT doc_id, doc_id % 4 AS k FROM documents)"""
)
def disk_headers_documents(spark, sf_dir):
    """Each text inside a disk image of one of four kinds: what the image's header says."""
    return containers.headers(_built(_table(spark, sf_dir, "documents"), _disk)).drop("header_entropy")


def _record(k: int, text: bytes) -> tuple[str, bytes]:
    r = bytearray(1024)
    r[:4] = b"FILE"
    struct.pack_into("<H", r, 4, 0x30)
    struct.pack_into("<HH", r, 0x14, 0x38, k % 4)
    struct.pack_into("<I", r, 0x18, 0x200)
    struct.pack_into("<I", r, 0x2C, k)
    name = f"Größe {k}.TXT".encode("utf-16-le") if k % 3 else b""
    struct.pack_into("<II", r, 0x38, 0x30 if name else 0xFFFFFFFF, 24 + 66 + len(name))
    struct.pack_into("<IH", r, 0x48, 66 + len(name), 24)
    r[0x38 + 24 + 64] = len(name) // 2
    r[0x38 + 24 + 66 : 0x38 + 24 + 66 + len(name)] = name
    return f"m/{k}", text.replace(b"FILE", b"") + bytes(r)


@_query(
    """SELECT 'm/' || doc_id AS source_path, octet_length(encode(replace(coalesce(text, ''), 'FILE', '')))::BIGINT AS "offset", doc_id AS record, doc_id % 2 = 1 AS in_use, doc_id % 4 >= 2 AS is_dir,
    CASE WHEN doc_id % 3 > 0 THEN 'Größe ' || doc_id || '.TXT' ELSE 'ntfs_mft_record_' || doc_id END AS name,
    CASE WHEN doc_id % 4 >= 2 THEN 'dir' WHEN doc_id % 3 > 0 THEN 'txt' ELSE 'mft' END AS extension FROM documents"""
)
def file_records_documents(spark, sf_dir):
    """A file record behind each text."""
    return containers.file_records(_built(_table(spark, sf_dir, "documents"), _record))


_HEALED = [(b"\xebR\x90NTFS ", "ntfs", 0), (b"H+\x00\x04", "hfs_plus", 1024), (b"NXSB", "apfs", 0), (b"hsqs", "squashfs", 0), (b"ustar", "tar", 257), (b"", "tail", 0)]


@_query(
    """SELECT 'h/' || doc_id AS source_path, ['ntfs', 'hfs_plus', 'apfs', 'squashfs', 'tar', 'tail'][k + 1] AS found, CASE k WHEN 1 THEN greatest(n - 1024, 0) WHEN 4 THEN greatest(n - 257, 0) WHEN 5 THEN least(n, 1048576) ELSE n END::BIGINT AS "offset"
    FROM (SELECT doc_id, doc_id % 6 AS k, octet_length(encode(coalesce(text, ''))) AS n FROM documents)"""
)
def healed_documents(spark, sf_dir):
    """A file system's mark behind each text."""
    made = _built(_table(spark, sf_dir, "documents"), lambda k, t: (f"h/{k}", t + _HEALED[k % 6][0]))
    return healer.heal(made).select("source_path", "found", "offset")


def _member(k: int, text: bytes) -> tuple[str, bytes]:
    block = bytearray(512)
    block[:4] = b"\xfc\x4e\x2b\xa9"
    block[0x10:0x20] = struct.pack("<QQ", k, 7)
    block[0x20:0x24] = b"syno" if k % 7 == 0 else b"md-0"
    for at, x in ((0x48, [0, 1, 5, 6, 10, 0xFFFFFFFF][k % 6]), (0x4C, k % 5), (0x58, 64 << k % 3), (0x5C, k % 4), (0x90, k % 3)):
        block[at : at + 4] = struct.pack("<I", x)
    return f"r/{k}", bytes(4096) + bytes(block) + text


@_query(
    """SELECT 'r/' || doc_id AS source_path, CASE WHEN doc_id % 7 = 0 THEN 'synology_shr' ELSE 'mdadm' END AS family, nullif(doc_id % 4, 0)::BIGINT AS expected_members, (doc_id % 3)::BIGINT AS member_index,
    (65536 << (doc_id % 3)::INT)::BIGINT AS stripe_size, ['raid0', 'raid1', 'raid5', 'raid6', 'raid10', 'jbod'][doc_id % 6 + 1] AS mode, ['left_asymmetric', 'right_asymmetric', 'left_symmetric', 'right_symmetric', 'unknown'][doc_id % 5 + 1] AS layout FROM documents"""
)
def array_members_documents(spark, sf_dir):
    """An array member's superblock before each text: the fields that are read from it."""
    return raid.probe(_built(_table(spark, sf_dir, "documents"), _member)).drop("array_id")


@_query(
    """WITH e AS (SELECT user_id, event_id, ['mdadm', 'synology_shr', 'windows_dynamic', 'unknown'][event_id % 4 + 1] AS family, ['raid0', 'raid5', 'raid1'][event_id % 3 + 1] AS mode, ['left_symmetric', 'unknown'][event_id % 2 + 1] AS layout, event_id % 9 AS member_index, 65536 * (1 + event_id % 3) AS stripe_size, 60 + event_id % 5 AS expected FROM events),
    s AS (SELECT user_id, max(stripe_size) AS stripe_size, greatest(max(expected), count(*)) AS expected_members, count(*) AS detected_members FROM e GROUP BY 1),
    f AS (SELECT user_id, family FROM (SELECT user_id, family, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, list_position(['mdadm', 'synology_shr', 'windows_dynamic'], family)) AS k FROM e WHERE family != 'unknown' GROUP BY 1, 2) WHERE k = 1),
    m AS (SELECT user_id, mode FROM (SELECT user_id, mode, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, list_position(['raid0', 'raid1', 'raid5'], mode)) AS k FROM e GROUP BY 1, 2) WHERE k = 1),
    l AS (SELECT user_id, layout FROM (SELECT user_id, layout, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, list_position(['unknown', 'left_symmetric'], layout)) AS k FROM e GROUP BY 1, 2) WHERE k = 1),
    g AS (SELECT user_id, count(*) AS n FROM (SELECT user_id, unnest(range(expected_members)) AS i FROM s WHERE expected_members > detected_members) x WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = x.user_id AND e.member_index = x.i) GROUP BY 1)
    SELECT s.user_id, family IS NOT NULL AS detected, coalesce(family, 'unknown') AS controller, CASE WHEN family = 'synology_shr' THEN 'shr' ELSE mode END AS mode, layout, stripe_size::BIGINT AS stripe_size, expected_members::BIGINT AS expected_members, detected_members, coalesce(n, 0)::BIGINT AS missing, n IS NOT NULL AS degraded
    FROM s LEFT JOIN f USING (user_id) LEFT JOIN m USING (user_id) LEFT JOIN l USING (user_id) LEFT JOIN g USING (user_id)"""
)
def array_reports_events(spark, sf_dir):
    """A report for each user's events taken as probed members: votes with their ties, missing slots."""
    k = F.col("event_id")
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), (k % n).cast("int"))
    probes = _table(spark, sf_dir, "events").select("user_id", pick(["mdadm", "synology_shr", "windows_dynamic", "unknown"], 4).alias("family"), pick(["raid0", "raid5", "raid1"], 3).alias("mode"), pick(["left_symmetric", "unknown"], 2).alias("layout"), (k % 9).alias("member_index"), (65536 * (1 + k % 3)).alias("stripe_size"), (60 + k % 5).alias("expected_members"))
    return raid.detect(probes, "user_id").withColumn("missing", F.size("missing").cast("long"))


def _members(spark, sf_dir, parity: bool) -> DataFrame:
    """Two blocks of 64 bytes of each document as an array's members, the second one lost and its parity there instead."""
    d = _documents(spark, sf_dir).select(F.regexp_extract("source_path", r"(\d+)$", 1).cast("long").alias("doc_id"), F.col("content"))
    part = lambda k: F.rpad(F.substring("content", 64 * k + 1, 64), 64, F.lit(b"\0"))
    rows = d.select("doc_id", F.lit(0).cast("long").alias("chunk_start"), part(0).alias("a"), part(1).alias("b"))
    if not parity:
        return rows.select("doc_id", "chunk_start", F.explode(F.array(F.struct(F.lit(0).alias("slot"), F.col("a").alias("content")), F.struct(F.lit(1).alias("slot"), F.col("b").alias("content")))).alias("x")).select("doc_id", "chunk_start", "x.*")
    both = rows.select("doc_id", F.explode(F.array("a", "b")).alias("content"))
    xor = raid.syndrome(both, "doc_id", 64).select("doc_id", F.lit(0).cast("long").alias("chunk_start"), F.lit(2).alias("slot"), F.col("syndrome").alias("content"))
    return rows.select("doc_id", "chunk_start", F.lit(0).alias("slot"), F.col("a").alias("content")).unionByName(xor)


_PADDED = "WITH d AS (SELECT doc_id, rpad(substr(hex(encode(coalesce(text, ''))), 1, 256), 256, '0') AS h FROM documents)"


@_query(f"{_PADDED} SELECT doc_id, 0::BIGINT AS position, lower(substr(h, 1, 32) || substr(h, 129, 32) || substr(h, 33, 32) || substr(h, 161, 32) || substr(h, 65, 32) || substr(h, 193, 32) || substr(h, 97, 32) || substr(h, 225, 32)) AS bytes FROM d")
def striped_image_documents(spark, sf_dir):
    """Images of striped arrays of two members with stripes of 16 bytes, one array a document."""
    made = raid.assembled(_members(spark, sf_dir, False), 2, "raid0", 16, group="doc_id")
    return made.select("doc_id", "position", F.lower(F.hex("content")).alias("bytes"))


@_query(f"{_PADDED} SELECT doc_id, 0::BIGINT AS position, lower(substr(h, 1, 128) || substr(h, 129, 128)) AS bytes FROM d")
def rebuilt_image_documents(spark, sf_dir):
    """Images of arrays with parity whose second member is lost: its stripe comes back by XOR."""
    made = raid.assembled(_members(spark, sf_dir, True), 3, "raid5", 64, group="doc_id")
    return made.select("doc_id", "position", F.lower(F.hex("content")).alias("bytes"))


@_query(f"{_PADDED}, b AS (SELECT source, unnest(range(64)) AS i, unnest(regexp_extract_all(substr(h, 1, 128), '..')) AS v FROM d JOIN documents USING (doc_id)), x AS (SELECT source, i, bit_xor(('0x' || v)::INT) AS x FROM b GROUP BY ALL) SELECT source, string_agg(lower(lpad(to_hex(x), 2, '0')), '' ORDER BY i) AS bytes FROM x GROUP BY 1")
def syndrome_documents(spark, sf_dir):
    """XOR of the first 64 bytes of all documents of a source."""
    docs = _table(spark, sf_dir, "documents").select("source", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return raid.syndrome(docs, "source", 64).select("source", F.lower(F.hex("syndrome")).alias("bytes"))


def _findings(spark, sf_dir) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    return d.select(F.concat_ws("-", F.lit("f"), "doc_id").alias("id"), none.alias("display_name"), "lang", F.col("lang").alias("signature_id"), F.col("source").alias("source_path"), F.when(F.col("doc_id") % 3 == 0, "inside").alias("container_path"), (F.col("n_chars") % 400).cast("long").alias("offset"), F.col("n_chars").cast("long").alias("size"), (F.col("doc_id") % 3).alias("report"))


_FINDINGS = "f AS (SELECT 'f-' || doc_id AS id, source AS source_path, lang AS signature_id, CASE WHEN doc_id % 3 = 0 THEN 'inside' END AS container_path, n_chars % 400 AS \"offset\", n_chars AS size, doc_id % 3 AS report FROM documents)"


@_query(f"WITH {_FINDINGS} SELECT id, source_path, \"offset\"::BIGINT AS \"offset\", signature_id, container_path FROM (SELECT *, row_number() OVER (PARTITION BY source_path, \"offset\", signature_id ORDER BY report, coalesce(container_path, ''), id) AS k FROM f) WHERE k = 1")
def merged_findings_documents(spark, sf_dir):
    """Findings of three reports merged: one for each source, offset and signature, that of the first report."""
    rows = _findings(spark, sf_dir)
    return report_files.merged_findings([rows.where(F.col("report") == k) for k in range(3)]).select("id", "source_path", "offset", "signature_id", "container_path")


@_query(f"WITH {_FINDINGS} SELECT id, source_path, \"offset\"::BIGINT AS \"offset\", signature_id, container_path FROM (SELECT *, row_number() OVER (PARTITION BY source_path, \"offset\", signature_id, coalesce(container_path, '') ORDER BY report, id) AS k FROM f) WHERE k = 1")
def merged_findings_with_containers(spark, sf_dir):
    rows = _findings(spark, sf_dir)
    return report_files.merged_findings([rows.where(F.col("report") == k) for k in range(3)], keep_containers=True).select("id", "source_path", "offset", "signature_id", "container_path")


@_query(f"WITH {_FINDINGS} SELECT id, source_path, \"offset\"::BIGINT AS \"offset\", signature_id FROM f ORDER BY source_path, \"offset\", signature_id, coalesce(container_path, ''), id LIMIT 500")
def top_findings_documents(spark, sf_dir):
    """The rows that a table of findings shows; ids break ties here."""
    rows = _findings(spark, sf_dir).orderBy("source_path", "offset", "signature_id", F.coalesce("container_path", F.lit("")), "id").limit(500)
    return rows.select("id", "source_path", "offset", "signature_id")


@_query("SELECT 'all' AS scope, sum((event_id % 3 = 0)::INT)::BIGINT AS quick_hits, sum((event_id % 3 = 1)::INT)::BIGINT AS deep_hits, sum((event_id % 3 = 2)::INT)::BIGINT AS container_hits, 'physical,encrypted_volume,filesystem' AS layers FROM events")
def report_counters_events(spark, sf_dir):
    """Counters of hits by the branch that found them, and the layers of a scan that met them."""
    branch = F.get(F.array(*map(F.lit, ["quick", "deep", "container"])), (F.col("event_id") % 3).cast("int"))
    made = report_files.counters(_table(spark, sf_dir, "events").select(branch.alias("branch")))
    return made.select(F.lit("all").alias("scope"), "*", F.array_join(report_files.layers(F.lit(False), F.lit(True), F.col("deep_hits") > 0), ",").alias("layers"))


@_query("SELECT event_id, sha256('hash-chain-sha256-v1|' || entry || '|' || event_type) AS plain, sha256('keyed-sha256-v1|key|' || entry || '|' || event_type) AS keyed FROM (SELECT event_id, event_type, sha256(event_type) AS entry FROM events)")
def audit_signatures_events(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", "event_type", F.sha2("event_type", 256).alias("entry"))
    return e.select("event_id", audit.signature(F.col("entry"), F.col("event_type")).alias("plain"), audit.signature(F.col("entry"), F.col("event_type"), "key").alias("keyed"))


@_query(
    """WITH c AS (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS p, sum(n_chars) OVER () AS t FROM documents),
    d AS (SELECT doc_id, p, t, least(100, 100 * p // greatest(t, 1)) AS pct FROM c), e AS (SELECT *, lag(pct) OVER (ORDER BY doc_id) AS b FROM d)
    SELECT doc_id, pct::BIGINT AS percent, CASE WHEN p > 0 AND doc_id > 0 THEN floor(greatest(greatest(t, 1) - p, 0) / (p / doc_id) + 0.5)::BIGINT END AS eta_seconds FROM e WHERE b IS NULL OR pct > b"""
)
def progress_eta_documents(spark, sf_dir):
    """Progress events with the time left, a second taken for each id."""
    d = _table(spark, sf_dir, "documents")
    total = d.agg(F.sum("n_chars").alias("total"))
    rows = reports.progress(d, "doc_id", "n_chars").crossJoin(F.broadcast(total))  # a row
    return rows.select("doc_id", "percent", reports.eta(F.col("processed"), F.col("total"), F.col("doc_id")).alias("eta_seconds"))


@_query("SELECT page_id, CASE WHEN len(regexp_extract(coalesce(url, ''), '([^/]+)/*$', 1)) > 0 THEN regexp_extract(coalesce(url, ''), '([^/]+)/*$', 1) ELSE 'scan' END || '.tracehound.scan.json' AS path FROM pages")
def report_paths_pages(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", report_files.default_path(F.coalesce("url", F.lit(""))).alias("path"))


@_query(
    """WITH s AS (SELECT DISTINCT substr(hex(encode(text)), 1, 12) AS m FROM benchmark WHERE octet_length(encode(text)) >= 6),
    d AS (SELECT 'documents/' || doc_id AS source_path, hex(encode(coalesce(text, ''))) AS h, unnest(range(octet_length(encode(coalesce(text, ''))))) AS hit FROM documents)
    SELECT source_path, hit AS "offset", m AS signature_id FROM d JOIN s ON substr(h, 2 * hit + 1, 4) = substr(m, 1, 4) AND substr(h, 2 * hit + 1, 12)[7:12] = m[7:12]"""
)
def carve_benchmark_signatures(spark, sf_dir):
    """Signatures of the user's own, one for each benchmark text's first six bytes, the third a wildcard, in all documents."""
    head = F.hex(F.substring(F.encode("text", "UTF-8"), 1, 6))
    magic = F.concat_ws(" ", *(F.lit("??") if k == 2 else F.substring("m", 2 * k + 1, 2) for k in range(6)))
    none = F.lit(None).cast("string")
    own = _table(spark, sf_dir, "benchmark").select(head.alias("m")).where("length(m) = 12").distinct()
    own = own.select(F.col("m").alias("id"), F.col("m").alias("name"), F.lit("txt").alias("extension"), magic.alias("magic"), F.lit(0).cast("long").alias("offset"), F.lit("own").alias("category"), none.alias("description"), none.cast("long").alias("default_size"))
    return signatures.positions(_documents(spark, sf_dir), signatures.with_profile(own, "strict")).select("source_path", "offset", "signature_id")


@_query(
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'unknown_source' ELSE regexp_replace(source, '[^A-Za-z0-9._-]', '_', 'g') END || CASE doc_id % 3 WHEN 0 THEN '/folder/b_c' ELSE '' END || CASE WHEN doc_id % 3 = 1 THEN '/x/file.bin' ELSE '/' || lang || '.html' END AS path FROM documents"""
)
def recovery_paths_documents(spark, sf_dir):
    """Where items go below the destination when folders are kept."""
    k = F.col("doc_id")
    hint = F.when(k % 3 == 0, "../folder/./b:c").when(k % 3 == 1, "C:\\x\\file.bin").otherwise("")
    fp = F.when(k % 4 == 0, "").otherwise(F.col("source"))
    return _table(spark, sf_dir, "documents").select("doc_id", recovery.output_path(F.col("lang"), F.lit(".HTML"), fp, hint, True).alias("path"))


@_query(
    """WITH p AS (SELECT doc_id, 'k' || doc_id AS manifest_key FROM documents), l AS (SELECT doc_id, quality FROM labels),
    m AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'k' || doc_id ELSE doc_id::VARCHAR END AS manifest_key, (doc_id % 50)::BIGINT AS had, quality = 1 AS done FROM l)
    SELECT p.doc_id, coalesce(a.had, b.had) AS had, coalesce(a.done, b.done) AS done FROM p LEFT JOIN m a USING (manifest_key) LEFT JOIN m b ON b.manifest_key = p.doc_id::VARCHAR"""
)
def manifest_entries_documents(spark, sf_dir):
    """Planned items with their manifest entry, by key or, from older runs, by id."""
    planned = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("k"), "doc_id").alias("manifest_key"))
    key = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("k"), "doc_id")).otherwise(F.col("doc_id").cast("string"))
    known = _table(spark, sf_dir, "labels").select(key.alias("manifest_key"), (F.col("doc_id") % 50).alias("bytes_written"), (F.col("quality") == 1).alias("completed"), F.lit(None).cast("string").alias("sha256"))
    return recovery.with_manifest(planned, known).select(F.col("id").alias("doc_id"), "had", "done")


_MARKED = [b"-FVE-FS-", b"", b"FileVault", b"CORESTORAGE"]


@_query(
    """WITH d AS (SELECT doc_id, doc_id % 6 AS k, octet_length(encode(coalesce(text, ''))) AS n FROM documents)
    SELECT CASE k WHEN 4 THEN 'e/RKEY-' ELSE 'e/' END || doc_id AS source_path, CASE WHEN k = 0 AND n + 8 <= 8192 THEN 'bitlocker' WHEN k = 1 THEN 'luks' WHEN k = 2 AND n + 9 <= 8192 OR k = 3 AND n + 11 <= 8192 THEN 'filevault' WHEN k = 4 THEN 'keyfile' ELSE 'none' END AS state FROM d"""
)
def encryption_states_documents(spark, sf_dir):
    """A mark before or behind each text; marks count within the first 8,192 bytes only."""
    made = _built(_table(spark, sf_dir, "documents"), lambda k, t: (f"e/RKEY-{k}" if k % 6 == 4 else f"e/{k}", b"LUKS\xba\xbe" + t if k % 6 == 1 else t + (_MARKED[k % 6] if k % 6 < 4 else b"")))
    return made.select("source_path", markers.encryption(F.col("content"), F.col("source_path")).alias("state"))


@_query("SELECT doc_id, (CASE WHEN n >= 4 THEN ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT END)::DECIMAL(20, 0) AS little, (CASE WHEN n >= 4 THEN ('0x' || substr(h, 1, 8))::BIGINT END)::DECIMAL(20, 0) AS big FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents)")
def integers_documents(spark, sf_dir):
    """Integers read from the first four bytes, either way round."""
    d = _documents(spark, sf_dir).select(F.regexp_extract("source_path", r"(\d+)$", 1).cast("long").alias("doc_id"), "content")
    return d.select("doc_id", binary.int_le(F.col("content"), 0, 4).alias("little"), binary.int_be(F.col("content"), 0, 4).alias("big"))


@_query("SELECT unnest(['ntfs', 'refs', 'ext4', 'btrfs', 'apfs', 'hfs_plus', 'xfs', 'zfs']) AS name, unnest([true, false, false, false, false, false, false, false]) AS parsed")
def file_systems(spark, sf_dir):
    return commands.file_systems(spark)


@_query(
    """SELECT 'documents/' || doc_id AS source_path, least(100000, n - k)::BIGINT AS expected, sha256(unhex(substr(h, 2 * k + 1, 200000))) AS sha256
    FROM (SELECT doc_id, doc_id % 50 * 7 AS k, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents) WHERE k < n"""
)
def recovered_digests_documents(spark, sf_dir):
    """Digests of what a recovery of whole texts from some offset on would write."""
    d = _documents(spark, sf_dir)
    none = F.lit(None).cast("string")
    k = F.regexp_extract("source_path", r"(\d+)$", 1).cast("long") % 50 * 7
    items = d.select(F.col("source_path").alias("id"), "source_path", none.alias("fp"), none.alias("container"), none.alias("hint"), k.alias("offset"), F.lit(100_000).cast("long").alias("size"), F.octet_length("content").cast("long").alias("length"), F.lit("sig").alias("sig"), F.col("source_path").alias("name"), F.lit("bin").alias("extension"))
    return recovery.digests(recovery.plan(items), d).select("source_path", "expected", "sha256")
