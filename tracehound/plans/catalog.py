"""Registered queries of the evidence operators and the SQL each one equals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehound.functions import binary
from tracehound.operators import containers, healer, markers, profiles, raid, recovery, reports, scoring, signatures
from tracehound.sources import evidence
from tracehound.streaming import carry

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark, sf_dir):
    return evidence.from_text(_table(spark, sf_dir, "pages"), "pages", "page_id", "html")


def _documents(spark, sf_dir):
    return evidence.from_text(_table(spark, sf_dir, "documents"), "documents", "doc_id", "text")


_DOCS = "d AS (SELECT 'documents/' || doc_id AS source_path, encode(coalesce(text, '')) AS b FROM documents)"
_BYTES = f"WITH {_DOCS}, x AS (SELECT source_path, octet_length(b) AS n, hex(b) AS h FROM d), y AS (SELECT source_path, n, unnest(range(n)) AS i, unnest(regexp_extract_all(h, '..')) AS v FROM x)"


@_query(
    """WITH p AS (SELECT 'pages/' || page_id AS source_path, hex(encode(html)) AS h, octet_length(encode(html)) AS n FROM pages),
    q AS (SELECT *, unnest(range(n)) AS hit FROM p),
    r AS (SELECT source_path, hit, substr(h, 2 * hit + 1, 18) AS w FROM q WHERE substr(h, 2 * hit + 1, 2) = '3C')
    SELECT source_path, hit AS "offset", 'sig-html-0001' AS signature_id FROM r WHERE w = '3C21444F4354595045'
    UNION ALL SELECT source_path, hit, 'sig-html-0002' FROM r WHERE substr(w, 1, 14) = '3C736372697074'
    UNION ALL SELECT source_path, hit, 'sig-html-0003' FROM r WHERE substr(w, 1, 4) = '3C68' AND substr(w, 7, 2) = '3E'"""
)
def carve_pages(spark, sf_dir):
    found = signatures.positions(_pages(spark, sf_dir), signatures.builtin(spark))
    return reports.first_of(found, ["source_path", "offset", "signature_id"], ["hit"]).select("source_path", "offset", "signature_id")


@_query("SELECT 14::BIGINT AS signatures, 16::BIGINT AS max_length")
def signature_profile(spark, sf_dir):
    return signatures.summary(signatures.builtin(spark, "strict"))


@_query(_BYTES + ", c AS (SELECT source_path, n, v, count(*) AS k FROM y GROUP BY ALL) SELECT x.source_path, round(coalesce(e, 0), 6) AS entropy FROM x LEFT JOIN (SELECT source_path, -sum((k / n) * log2(k / n)) AS e FROM c GROUP BY 1) USING (source_path)")
def entropy_documents(spark, sf_dir):
    return profiles.entropy(_documents(spark, sf_dir)).select("source_path", F.round("entropy", 6).alias("entropy"))


@_query(
    f"""WITH {_DOCS}, x AS (SELECT source_path, octet_length(b) AS n, hex(b) AS h FROM d),
    w AS (SELECT source_path, substr(h, 2 * s + 1, 2048) AS h, s, least(n - s, 1024) AS m FROM (SELECT *, unnest(CASE WHEN n >= 1024 THEN range(0, n - 1023, 512) ELSE [0] END) AS s FROM x)),
    y AS (SELECT source_path, s, m, unnest(regexp_extract_all(h, '..')) AS v FROM w),
    c AS (SELECT source_path, s, m, v, count(*) AS k FROM y GROUP BY ALL)
    SELECT w.source_path, w.s::BIGINT AS window_start, round(coalesce(e, 0), 6) AS entropy FROM w LEFT JOIN (SELECT source_path, s, -sum((k / m) * log2(k / m)) AS e FROM c GROUP BY 1, 2) z ON z.source_path = w.source_path AND z.s = w.s"""
)
def rolling_entropy_documents(spark, sf_dir):
    return profiles.rolling_entropy(_documents(spark, sf_dir)).withColumn("entropy", F.round("entropy", 6))


@_query(_BYTES + ", c AS (SELECT source_path, sum((v BETWEEN '20' AND '7E' OR v IN ('0A', '0D'))::INT) AS a, sum((v = '00')::INT) AS z FROM y GROUP BY 1) SELECT x.source_path, round(coalesce(a / n, 0), 6) AS ascii_share, round(coalesce(z / n, 0), 6) AS zero_share FROM x LEFT JOIN c USING (source_path)")
def byte_shares_documents(spark, sf_dir):
    b = F.col("content")
    return _documents(spark, sf_dir).select("source_path", F.round(binary.ascii_ratio(b), 6).alias("ascii_share"), F.round(binary.zero_ratio(b), 6).alias("zero_share"))


@_query(_BYTES + ", z AS (SELECT source_path, i // 4096 AS block, v || substr(h2, 1, 2) AS pair FROM (SELECT y.*, lead(v) OVER (PARTITION BY source_path, i // 4096 ORDER BY i) AS h2 FROM y WHERE i < n - n % 4096)) SELECT source_path, block::BIGINT AS block, round(count(DISTINCT pair) FILTER (pair IS NOT NULL) / 65536, 6) AS score FROM z GROUP BY 1, 2")
def markov_documents(spark, sf_dir):
    return profiles.transitions(_documents(spark, sf_dir)).withColumn("score", F.round("score", 6))


@_query(
    _BYTES.replace("coalesce(text, '')", "left(coalesce(text, ''), 64)")
    + """, c AS (SELECT source_path, n, v, count(*) AS k FROM y GROUP BY ALL), e AS (SELECT source_path, n, -sum((k / n) * log2(k / n)) AS h, sum(CASE WHEN v BETWEEN '20' AND '7E' OR v IN ('0A', '0D') THEN k ELSE 0 END) / n AS a FROM c GROUP BY 1, 2)
    SELECT source_path, round(least(greatest(0.55 * least(greatest(h / 8, 0), 1) + 0.35 * least(greatest(0.6 * a + 0.4 * (1 - abs(a - 0.45)), 0), 1) + 0.15, 0), 1), 5) AS score FROM e"""
)
def classifier_score_documents(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").withColumn("text", F.substring("text", 1, 64))
    heads = evidence.from_text(docs, "documents", "doc_id", "text").where(F.octet_length("content") > 0)
    both = profiles.entropy(heads).join(heads.select("source_path", binary.ascii_ratio(F.col("content")).alias("a")), "source_path")
    return both.select("source_path", F.round(profiles.classifier_score(F.col("entropy"), F.col("a"), F.lit(0.15)), 5).alias("score"))


@_query(
    """WITH x AS (SELECT 'documents/' || doc_id AS source_path, substr(hex(encode(coalesce(text, ''))), 1, 512) AS h FROM documents),
    y AS (SELECT source_path, len(h) / 2 AS n, unnest(regexp_extract_all(h, '..')) AS v FROM x),
    c AS (SELECT source_path, n, v, count(*) AS k FROM y GROUP BY ALL), e AS (SELECT source_path, -sum((k / n) * log2(k / n)) AS h, sum(CASE WHEN v BETWEEN '20' AND '7E' OR v IN ('0A', '0D') THEN k ELSE 0 END / n) AS a FROM c GROUP BY 1)
    SELECT x.source_path, coalesce(round(least(greatest(0.55 * least(greatest(e.h / 8, 0), 1) + 0.35 * least(greatest(0.6 * a + 0.4 * (1 - abs(a - 0.45)), 0), 1) + 0.15, 0), 1), 5), 0) AS score FROM x LEFT JOIN e USING (source_path)"""
)
def classifier_score(spark, sf_dir):
    """The reference's score: first 256 bytes, 0 for empty documents. classifier_score_documents, whose SQL is given, sees 64 characters."""
    return scoring.samples(_documents(spark, sf_dir), 0.15).select("source_path", F.round("score", 5).alias("score"))


@_query("SELECT doc_id, s::BIGINT AS chunk_start, least(s + 1024 + 64, n_chars)::BIGINT AS chunk_end FROM (SELECT doc_id, n_chars, unnest(range(0, n_chars, 1024)) AS s FROM documents)")
def chunk_ranges(spark, sf_dir):
    return evidence.chunk_ranges(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", 1024, 64).select("doc_id", "chunk_start", "chunk_end")


_BLOBS = [("a.img", "00002d4656452d46532d"), ("b.img", "4c554b53babe00"), ("c.img", "436f726553746f7261676500"), ("my_rkey.bin", "00"), ("d.vmdk", "00"), ("e.bin", "4b444d5600"), ("f", "7668647866696c6500"), ("g", "514649fb00"), ("h", "3412aa5500"), ("i", "4d5357494d00000000"), ("j.7z", "00"), ("k.qcow2", "ff"), ("l.txt", "")]


def _blobs(spark):
    return spark.createDataFrame(_BLOBS, "source_path string, h string").select("source_path", F.unhex("h").alias("content"))


@_query(
    "SELECT source_path, CASE WHEN contains(lower(h), '2d4656452d46532d') THEN 'bitlocker' WHEN starts_with(lower(h), '4c554b53babe') THEN 'luks' WHEN contains(lower(h), '436f726553746f72616765') THEN 'filevault' WHEN contains(source_path, 'rkey') THEN 'keyfile' ELSE 'none' END AS state FROM (VALUES "
    + ", ".join(map(str, _BLOBS))
    + ") t(source_path, h) UNION ALL SELECT 'documents/' || doc_id, 'none' FROM documents"
)
def encryption_markers(spark, sf_dir):
    rows = _blobs(spark).unionByName(_documents(spark, sf_dir))
    return rows.select("source_path", markers.encryption(F.col("content"), F.col("source_path")).alias("state"))


@_query(
    "SELECT source_path, CASE WHEN starts_with(h, '4b444d56') THEN 'vmdk' WHEN starts_with(h, '7668647866696c65') THEN 'vhdx' WHEN starts_with(h, '514649fb') THEN 'qcow2' WHEN starts_with(h, '3412aa55') THEN 'vpk' WHEN starts_with(h, '4d5357494d000000') THEN 'wim' WHEN source_path LIKE '%.vmdk' THEN 'vmdk' WHEN source_path LIKE '%.7z' THEN 'archive' WHEN source_path LIKE '%.qcow2' THEN 'qcow2' ELSE 'unknown' END AS kind FROM (VALUES "
    + ", ".join(map(str, _BLOBS))
    + ") t(source_path, h) UNION ALL SELECT 'pages/' || page_id, 'unknown' FROM pages"
)
def container_detect(spark, sf_dir):
    rows = _blobs(spark).unionByName(_pages(spark, sf_dir))
    return rows.select("source_path", markers.container(F.col("content"), F.col("source_path")).alias("kind"))


@_query("SELECT doc_id, sha256(doc_id || '|' || n_chars || '|0') AS fingerprint FROM documents")
def source_fingerprint(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", reports.fingerprint(F.col("doc_id").cast("string"), F.col("n_chars"), F.lit(0)).alias("fingerprint"))


_NS = reports.NAMESPACE.replace("-", "")


@_query(f"SELECT doc_id, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-' || substr('89ab', 1 + (strpos('0123456789abcdef', substr(x, 17, 1)) - 1) % 4, 1) || substr(x, 18, 3) || '-' || substr(x, 21, 12) AS finding_id FROM (SELECT doc_id, sha1(unhex('{_NS}') || encode(source || '||' || doc_id || '|sig-common-0001|Deep')) AS x FROM documents)")
def finding_ids(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", reports.finding_id(F.col("source"), F.lit(None).cast("string"), F.col("doc_id"), F.lit("sig-common-0001"), "Deep").alias("finding_id"))


def _blocks(spark, sf_dir):
    return _table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 4).alias("stripe"), (F.col("event_id") % 4).alias("member"), "user_id", "event_id")


@_query("SELECT event_id // 4 AS stripe, bit_xor(user_id) AS parity, count(*) AS members FROM events GROUP BY 1")
def raid5_parity(spark, sf_dir):
    return raid.parity(_blocks(spark, sf_dir), "stripe", "user_id")


@_query("SELECT event_id // 4 AS stripe, user_id AS rebuilt FROM events WHERE event_id % 4 = 1")
def raid5_rebuild(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    return raid.rebuild(blocks, raid.parity(blocks, "stripe", "user_id"), "stripe", "member", "user_id", 1)


@_query("SELECT event_id, row_number() OVER (ORDER BY event_id // 4, event_id % 4) - 1 AS place FROM events")
def raid0_order(spark, sf_dir):
    return raid.stripe_order(_blocks(spark, sf_dir), "stripe", "member").select("event_id", "place")


@_query("SELECT user_id, event_type AS dominant, votes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) AS k FROM (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY 1, 2)) WHERE k = 1")
def raid_dominant(spark, sf_dir):
    return raid.dominant(_table(spark, sf_dir, "events"), "user_id", "event_type")


@_query("WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber AS slot FROM lineitem) SELECT l_orderkey, slot::INT AS slot FROM (SELECT l_orderkey, unnest(range(1, max(slot) + 1)) AS slot FROM s GROUP BY 1) EXCEPT SELECT * FROM s")
def missing_slots(spark, sf_dir):
    return raid.missing_slots(_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@_query(
    """WITH c AS (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS p, sum(n_chars) OVER () AS t FROM documents),
    d AS (SELECT doc_id, p, least(100, 100 * p // greatest(t, 1)) AS pct FROM c),
    e AS (SELECT *, lag(pct) OVER (ORDER BY doc_id) AS b FROM d)
    SELECT doc_id, p::BIGINT AS processed, pct::BIGINT AS percent FROM e WHERE b IS NULL OR pct > b"""
)
def progress_events(spark, sf_dir):
    return reports.progress(_table(spark, sf_dir, "documents"), "doc_id", "n_chars")


@_query("WITH l AS (SELECT event_id, sha256(event_id || '|' || event_type) AS entry, CASE WHEN event_id % 97 = 5 THEN 'tampered' WHEN event_id = 0 THEN 'genesis' ELSE sha256((event_id - 1) || '|' || lag(event_type) OVER (ORDER BY event_id)) END AS prev FROM events) SELECT event_id, prev = coalesce(lag(entry) OVER (ORDER BY event_id), 'genesis') AS valid FROM l")
def audit_chain(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", "event_type")
    hashed = lambda df: F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type"), 256)
    rows = e.withColumn("entry", hashed(e))
    before = rows.select((F.col("event_id") + 1).alias("event_id"), F.col("entry").alias("before"))
    rows = rows.join(before, "event_id", "left").withColumn("prev", F.when(F.col("event_id") % 97 == 5, "tampered").otherwise(F.coalesce("before", F.lit(reports.GENESIS)))).drop("before")
    return reports.chain_check(rows, "event_id", "prev", "entry", F.floor(F.col("event_id") / 5000)).select("event_id", "valid")


@_query("SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def latest_shard(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return carry.latest_by_key(events, None, "user_id", ["ts", "event_id"]).select("user_id", "value")


@_query("SELECT d.doc_id, l.doc_id IS NOT NULL AS encrypted, CASE WHEN l.doc_id IS NOT NULL THEN 'encrypted_detected' ELSE 'unencrypted' END AS encryption_state FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def encryption_overlay(spark, sf_dir):
    return reports.overlay(_table(spark, sf_dir, "documents").select("doc_id"), _table(spark, sf_dir, "labels"), "doc_id")


@_query("SELECT source, sum(n_chars)::BIGINT AS n_chars, sum(doc_id)::BIGINT AS doc_id, count(*) AS reports FROM documents GROUP BY 1")
def merge_counters(spark, sf_dir):
    return reports.merge_reports(_table(spark, sf_dir, "documents"), "source", ["n_chars", "doc_id"])


@_query("SELECT source, n_chars, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2")
def report_sort_dedup(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("source", "n_chars", "doc_id")
    return reports.first_of(d.unionByName(d), ["source", "n_chars"], ["doc_id"]).orderBy("source", "n_chars")


@_query(
    """WITH i AS (SELECT doc_id AS id, source AS fp, doc_id % 50 * 40 AS "offset", n_chars AS length, lang || '.' || (doc_id % 40) AS name FROM documents)
    SELECT id, coalesce(nullif(fp, ''), 'unknown-source') || '||' || "offset" || '|sig|' || id AS manifest_key, regexp_replace(name, '[^A-Za-z0-9_-]', '_', 'g') || '.jpg' AS out_path, least(1000, length - "offset")::BIGINT AS expected,
    row_number() OVER (PARTITION BY regexp_replace(name, '[^A-Za-z0-9_-]', '_', 'g') ORDER BY id) > 1 AS dropped FROM i WHERE "offset" < length"""
)
def recover_plan(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    lit = lambda x: F.lit(x)
    items = d.select(F.col("doc_id").alias("id"), F.col("source").alias("fp"), lit(None).cast("string").alias("container"), (F.col("doc_id") % 50 * 40).alias("offset"), F.col("n_chars").alias("length"), F.concat_ws(".", "lang", F.col("doc_id") % 40).alias("name"), lit("JPG").alias("extension"), lit("sig").alias("sig"), lit(1000).cast("long").alias("size"))
    items = items.withColumns({"hint": lit(None).cast("string"), "source_path": F.col("fp")})
    return recovery.plan(items).select("id", "manifest_key", "out_path", "expected", "dropped")


@_query("SELECT 'documents/' || doc_id AS source_path, sha256(unhex(substr(hex(encode(text)), 33, 256))) AS sha256 FROM documents WHERE octet_length(encode(text)) > 16")
def recover_sha256(spark, sf_dir):
    """Digests of a planned recovery: 128 bytes from byte 16 on of each document that has as many."""
    d = _documents(spark, sf_dir)
    none = F.lit(None).cast("string")
    items = d.select(F.col("source_path").alias("id"), "source_path", none.alias("fp"), none.alias("container"), none.alias("hint"), F.lit(16).cast("long").alias("offset"), F.lit(128).cast("long").alias("size"), F.octet_length("content").cast("long").alias("length"), F.lit("sig").alias("sig"), F.col("source_path").alias("name"), F.lit("bin").alias("extension"))
    return recovery.digests(recovery.plan(items), d).select("source_path", "sha256")


@_query(
    """WITH p AS (SELECT 'pages/' || page_id AS source_path, regexp_extract_all(lower(hex(encode(html))), '.{1,32}') AS l FROM pages),
    q AS (SELECT source_path, unnest(l) AS bytes, unnest(range(len(l))) AS i FROM p)
    SELECT source_path, (16 * i)::BIGINT AS "offset", lower(lpad(to_hex(16 * i), 8, '0')) AS address, bytes FROM q"""
)
def hexdump_pages(spark, sf_dir):
    p = _pages(spark, sf_dir).where(F.octet_length("content") > 0)
    starts = F.sequence(F.lit(0).cast("long"), (F.octet_length("content") - 1).cast("long"), F.lit(16).cast("long"))
    lines = F.transform(starts, lambda i: F.struct(i.alias("offset"), F.substring(F.col("content"), (i + 1).cast("int"), F.lit(16)).alias("b")))
    rows = p.select("source_path", F.explode(lines).alias("x")).select("source_path", "x.offset", binary.hex_line(F.col("x.b"), F.col("x.offset")).alias("line"))
    return rows.select("source_path", "offset", F.substring("line", 1, 8).alias("address"), F.replace(F.substring("line", 11, 47), F.lit(" ")).alias("bytes"))


@_query("SELECT page_id, string_split(url, '.')[-1] AS extension FROM pages")
def entry_extension(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", binary.extension(F.col("url")).alias("extension"))


@_query("SELECT 'a.zip' AS source_path, 'inside.txt' AS name, 5::BIGINT AS size UNION ALL SELECT 'b.vmdk', 'disk-flat.vmdk', 1048576 UNION ALL SELECT 'c.qcow2', 'c.qcow2', 33554432")
def container_entries(spark, sf_dir):
    return containers.mount(containers.samples(spark)).select("source_path", "name", "size")


@_query("SELECT 'x' || i AS source_path, ['ntfs', 'hfs_plus', 'tail'][i] AS found, [5000, 976, 64][i]::BIGINT AS \"offset\", [8, 1028, 0][i]::BIGINT AS size FROM range(1, 4) t(i)")
def healed_samples(spark, sf_dir):
    data = [bytes(5000) + b"\xebR\x90NTFS ", bytes(2000) + b"H+\x00\x04", bytes(64)]
    return healer.heal(spark.createDataFrame([(f"x{k}", bytearray(d)) for k, d in enumerate(data, 1)], "source_path string, content binary"))


@_query("SELECT 'mdadm' AS controller, 'raid5' AS mode, 'left_asymmetric' AS layout, 65536::BIGINT AS stripe_size, 3::BIGINT AS expected_members, 2::BIGINT AS detected_members, 'Missing member slot #1' AS missing, true AS degraded")
def array_report(spark, sf_dir):
    def member(k: int) -> bytearray:
        block = bytearray(512)
        block[:4] = b"\xfc\x4e\x2b\xa9"
        for at, x in ((0x48, 5), (0x58, 64), (0x5C, 3), (0x90, k)):
            block[at : at + 4] = x.to_bytes(4, "little")
        return bytearray(4096) + block

    probes = raid.probe(spark.createDataFrame([(f"m{k}", member(k)) for k in (0, 2)], "source_path string, content binary"))
    return raid.detect(probes).select("controller", "mode", "layout", "stripe_size", "expected_members", "detected_members", F.array_join("missing", ", ").alias("missing"), "degraded")


@_query("SELECT doc_id, regexp_replace(source, '[^A-Za-z0-9_-]', '_', 'g') || '.html' AS file_name FROM documents")
def recovery_names(spark, sf_dir):
    """File names of recovered items: the source's name made safe, its extension put on."""
    return _table(spark, sf_dir, "documents").select("doc_id", recovery.file_name(F.col("source"), F.lit("HTML")).alias("file_name"))
