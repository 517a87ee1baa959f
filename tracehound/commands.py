"""What a user calls: scan, scan_report, mount, detect, reconstruct, recover, signature_summary, hex_dump."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehound.functions.binary import hex_line
from tracehound.operators import containers, healer, markers, raid, recovery, report_files, reports, signatures
from tracehound.operators.scoring import REACH, Classifier, learned
from tracehound.sources import ranged

# File systems known by name, warnings, tools that other engines ask, prefixes of raw devices.
FILE_SYSTEMS = ["ntfs", "refs", "ext4", "btrfs", "apfs", "hfs_plus", "xfs", "zfs"]
SYNOLOGY = "Synology mode enabled: assuming SHR + ext4/btrfs metadata hints and rkey workflow"
READ_ONLY = "Synology mode forced read-only safety checks"
TOOLS = ["sleuthkit-fls", "libbde-bdemount", "cryptsetup", "mdadm"]
RAW_DEVICES = ("\\\\.\\PhysicalDrive", "\\\\.\\Volume{")
RECORD = 1024


@dataclass(frozen=True)
class Options:
    mode: str = "hybrid"
    chunk: int = 8 << 20
    max_carve: int = 16 << 20
    profile: str = "strict"
    containers: bool = True
    strict_containers: bool = False
    read_only: bool = True
    synology: bool = False
    heal: bool = False
    bypass: bool = False
    case_id: str = ""
    authority: str = ""
    unlock_with: str = ""
    detect_only: bool = False
    adapters: str = "native_only"

    def check(self) -> None:
        if self.chunk < 1024:
            raise ValueError("chunk below 1024")
        if self.mode not in ("quick", "deep", "hybrid"):
            raise ValueError(f"unknown mode {self.mode}")
        if self.bypass and not (self.case_id.strip() and self.authority.strip()):
            raise ValueError("bypass needs a case id and an authority")
        if self.unlock_with and self.detect_only:
            raise ValueError("unlocking and detecting only exclude each other")
        if self.adapters not in ("native_only", "hybrid", "external_preferred"):
            raise ValueError(f"unknown adapter policy {self.adapters}")


def source_key(path: str, windows: bool = False) -> str:
    """What makes two paths one source."""
    return path.replace("/", "\\").lower() if windows else path


def raw_device(path: str) -> bool:
    """Whether a path names a raw device of Windows."""
    return path.startswith(RAW_DEVICES)


def sources_of(sources: list[str], drive: str | None = None, windows: bool = False) -> list[str]:
    """Roots, trimmed, the drive first, each once."""
    named = [x.strip() for x in ([drive] if drive else []) + list(sources)]
    return list({source_key(x, windows): x for x in reversed(named) if x}.values())[::-1] if windows else list(dict.fromkeys(x for x in named if x))


def warnings_of(options: Options) -> list[str]:
    return ([SYNOLOGY] + ([] if options.read_only else [READ_ONLY])) if options.synology else []


def _about(spark: SparkSession, files: list[str]) -> DataFrame:
    rows = [(f, ranged.size_of(f), int(os.stat(f).st_mtime)) for f in files]
    df = spark.createDataFrame(rows, "source_path string, length long, mtime long")
    return df.withColumn("fp", reports.fingerprint(F.col("source_path"), F.col("length"), F.col("mtime")))


_SHAPE = ["source_path", "container", "outer", "offset", "size", "sig", "name", "extension", "category", "validation_score", "confidence", "extent_length", "branch"]


def _null() -> Column:
    return F.lit(None).cast("string")


def _carved(parts: DataFrame, known: DataFrame, chunk: int, options: Options, classifier: Classifier) -> DataFrame:
    """Scored matches with what the signature says: source_path, offset, size, sig, name, extension, category, scores."""
    hits = signatures.carve_chunks(parts, known, chunk, options.profile == "broad", classifier)
    named = known.select(F.col("id").alias("signature_id"), F.col("name").alias("n"), "extension", "category", "default_size").dropDuplicates(["signature_id"])
    size = F.coalesce("default_size", F.lit(min(options.max_carve, 16 << 20)).cast("long"))
    return hits.join(named, "signature_id").select("source_path", "offset", size.alias("size"), F.col("signature_id").alias("sig"), F.concat_ws("_", "n", "offset").alias("name"), "extension", "category", "validation_score", "confidence")  # no hint: the join is chosen by measured size


def extents(entries: DataFrame) -> DataFrame:
    """source_path (the extent's file), outer, container, length of the disk extents that exist, of mounted entries."""
    name = F.replace(F.col("name"), F.lit("\\"), F.lit("/"))
    path = F.when(F.startswith(name, F.lit("/")), name).otherwise(F.concat(F.regexp_replace("source_path", "[^/]*$", ""), name))
    rows = entries.where("kind = 'vmdk' and error is null").select(path.alias("path"), "source_path", F.col("name").alias("container"))

    def there(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column(0).to_pylist()
            size = [ranged.size_of(p) if os.path.isfile(p) else -1 for p in paths]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size, pa.int64())], ["source_path", "outer", "container", "length"])

    return rows.mapInArrow(there, "source_path string, outer string, container string, length long").where("length >= 0")


def _branches(spark: SparkSession, files: list[str], options: Options, known: DataFrame, classifier: Classifier) -> tuple[DataFrame, DataFrame | None]:
    """All hits, with the branch that found them, and the containers' entries."""
    parts = []
    if options.mode != "quick":
        chunk = max(options.chunk, 1 << 20)
        deep = _carved(ranged.chunks(spark, files, chunk, REACH), known, chunk, options, classifier)
        parts.append(deep.withColumns({"container": _null(), "outer": _null(), "extent_length": _null().cast("long"), "branch": F.lit("deep")}))
    if options.mode != "deep":
        blocks = ranged.chunks(spark, files, options.chunk, RECORD)
        found = containers.file_records(blocks.select(F.to_json(F.struct("source_path", "chunk_start")).alias("source_path"), "content")).withColumn("o", F.from_json("source_path", "source_path string, chunk_start long")).where(F.col("offset") < options.chunk)
        score = F.when(F.col("in_use"), 0.74).otherwise(0.89)
        sig = F.when(F.col("in_use"), "ntfs-mft-active-entry").otherwise("ntfs-mft-deleted-entry")
        quick = found.select(F.col("o.source_path").alias("source_path"), (F.col("o.chunk_start") + F.col("offset")).alias("offset"), F.lit(RECORD).cast("long").alias("size"), sig.alias("sig"), "name", "extension", F.lit("filesystem_metadata").alias("category"), score.alias("validation_score"), score.alias("confidence"))
        parts.append(quick.withColumns({"container": _null(), "outer": _null(), "extent_length": _null().cast("long"), "branch": F.lit("quick")}))
    entries = None
    if options.containers:
        entries = containers.mount_files(ranged.rows_of(spark, files), options.strict_containers)
        held = entries.where("error is null and kind != 'vmdk'")
        vpk = F.col("kind") == "vpk"
        pick = lambda a, b: F.when(vpk, a).otherwise(b)
        listed = held.select("source_path", F.col("name").alias("container"), "offset", "size", pick("vpk-entry", "container-entry").alias("sig"), "name", F.element_at(F.split("name", r"\."), -1).alias("extension"), pick("archive_entry", "container_metadata").alias("category"), pick(0.8, 0.4).alias("validation_score"), pick(0.9, 0.6).alias("confidence"))
        parts.append(listed.withColumns({"outer": _null(), "extent_length": _null().cast("long"), "branch": F.lit("container")}))
        # Extents of a disk are files of their own: carved where they lie, known by their disk and name.
        chunk = max(options.chunk, 1 << 20)
        own = extents(entries)
        nested = _carved(ranged.read_ranges(own, chunk, REACH), known, chunk, options, classifier).join(own.select("source_path", "outer", "container", F.col("length").alias("extent_length")).distinct(), "source_path")
        parts.append(nested.withColumn("branch", F.lit("container")))
    rows = parts[0].select(*_SHAPE)
    for p in parts[1:]:
        rows = rows.unionByName(p.select(*_SHAPE))
    return rows, entries


def _prepared(spark: SparkSession, sources: list[str], options: Options, extra: DataFrame | None) -> tuple[list[str], list[str], DataFrame]:
    options.check()
    roots = sources_of(sources)
    if not roots:
        raise ValueError("no source given")
    files = list(dict.fromkeys(f for r in roots for f in ranged.regular_files(r)))
    if not files:
        raise ValueError(f"no readable files below {', '.join(roots)}")
    known = signatures.builtin(spark, options.profile)
    return roots, files, known if extra is None else known.unionByName(signatures.with_profile(extra, options.profile))


def _finished(hits: DataFrame, about: DataFrame, marked: DataFrame, options: Options) -> DataFrame:
    """Findings of hits: each once, with identity and encryption state."""
    kind = {"quick": "Quick", "deep": "Deep", "hybrid": "Hybrid"}[options.mode]
    rows = hits.drop("branch").dropDuplicates(["source_path", "offset", "sig", "container"]).withColumn("evidence_path", F.coalesce("outer", "source_path")).drop("outer")
    rows = rows.join(about.select(F.col("source_path").alias("evidence_path"), "length", "fp"), "evidence_path")
    rows = rows.withColumn("length", F.coalesce("extent_length", "length")).drop("extent_length")
    rows = rows.withColumn("id", reports.finding_id(F.col("fp"), F.col("container"), F.col("offset"), F.col("sig"), kind))
    return reports.overlay(rows, marked, "source_path", options.bypass)


def _marked(spark: SparkSession, files: list[str]) -> DataFrame:
    ends = ranged.edges(ranged.rows_of(spark, files), markers.LOOKED_AT, 0)
    return ends.select("source_path", markers.encryption(F.col("content"), F.col("source_path")).alias("m")).where("m != 'none'")


def scan(spark: SparkSession, sources: list[str], options: Options = Options(), extra: DataFrame | None = None, classifier: Classifier = learned) -> DataFrame:
    """Findings of all sources in one plan, sorted by source, offset, signature.

    extra: signatures beside the built-in ones; classifier: the learned part of scores. Columns: id,
    source_path, evidence_path (the container's file, for what lies in a disk's extent), fp, container,
    offset, size, length, sig, name, extension, category, validation_score, confidence, encrypted,
    encryption_state.
    """
    _, files, known = _prepared(spark, sources, options, extra)
    hits, _ = _branches(spark, files, options, known, classifier)
    rows = _finished(hits, _about(spark, files), _marked(spark, files), options)
    return rows.orderBy("source_path", "offset", "sig", F.coalesce("container", F.lit("")))


def scan_report(spark: SparkSession, sources: list[str], path: str, options: Options = Options(), extra: DataFrame | None = None, classifier: Classifier = learned) -> report_files.Report:
    """Scans once and writes a report below path, with counters, volume layers and warnings; gives it as read back.

    The hits are written first, so that counting them doesn't read the evidence again.
    """
    started = spark.sql("select current_timestamp() t").first()["t"]
    roots, files, known = _prepared(spark, sources, options, extra)
    about, marked = _about(spark, files), _marked(spark, files)
    hits, entries = _branches(spark, files, options, known, classifier)
    hits.write.parquet(f"{path}/hits")
    hits = spark.read.parquet(f"{path}/hits")
    rows = _finished(hits, about, marked, options)
    none = _null()
    findings = rows.select("id", F.col("name").alias("display_name"), "extension", F.col("sig").alias("signature_id"), "source_path", F.col("fp").alias("source_fingerprint"), "evidence_path", F.col("container").alias("container_path"), "offset", "size", "confidence", "validation_score", "category", "encrypted", "encryption_state", F.lit(None).cast("struct<volume_layer:string,reconstructed_path:string,notes:string>").alias("reconstruction_context"), none.alias("notes"))
    array = detect(spark, roots).first() if len(roots) > 1 and not any(map(os.path.isdir, roots)) else None
    said = _capability_warnings(options.adapters) + warnings_of(options)
    if array and array["detected"]:
        said.append(f"RAID topology detected: controller={array['controller']}, mode={array['mode']}, members={array['detected_members']}/{array['expected_members']}")
        if array["degraded"]:
            said.append(f"RAID set is degraded: {', '.join(array['missing'])}")
    if any(map(os.path.isdir, roots)):
        said.append(f"Directory source detected: scanning {len(files)} file(s) recursively")
    warnings = spark.createDataFrame([(w,) for w in said], "warning string")
    warnings = warnings.unionByName(marked.select(F.concat(F.lit("Encryption marker detected on "), "source_path", F.lit(" ("), "m", F.lit(")")).alias("warning")))
    if options.unlock_with:
        warnings = warnings.unionByName(marked.select(F.concat(F.lit(f"No adapter unlocks with {options.unlock_with}: "), "source_path").alias("warning")))
    if options.bypass:
        warnings = warnings.unionByName(marked.select(F.concat(F.lit("Bypass was asked for, none is applied: "), "source_path").alias("warning")))
    kind = spark.createDataFrame([(None,)], "container_type string")
    if entries is not None:
        warnings = warnings.unionByName(entries.where("error is not null").select(F.concat_ws(": ", "source_path", "error").alias("warning")))
        kind = entries.agg(F.min_by("kind", "source_path").alias("container_type"))
    head = report_files.counters(hits).crossJoin(about.agg(F.sum("length").alias("bytes_scanned"))).crossJoin(kind).crossJoin(marked.agg(F.count("*").alias("marked")))  # a row each
    raid_seen = F.lit(bool(options.synology or array and array["detected"]))
    found = F.col("quick_hits") + F.col("deep_hits") + F.col("container_hits") > 0
    native = [f"{r[0]}:{'available' if r[1] else 'missing'}:n/a" for r in _capability_rows(options.adapters)]
    now = F.current_timestamp()
    elapsed = (now.cast("double") - F.lit(started).cast("timestamp").cast("double")) * 1000
    metadata = F.struct("bytes_scanned", elapsed.cast("long").alias("elapsed_ms"), "quick_hits", "deep_hits", "container_hits", "container_type", report_files.layers(raid_seen, F.col("marked") > 0, found).alias("volume_layers"), F.array(*map(F.lit, native)).alias("adapter_capabilities"))
    head = head.select(report_files.scan_id().alias("scan_id"), F.lit(started).cast("timestamp").alias("started_at"), now.alias("finished_at"), F.lit(roots[0]).alias("source"), F.array(*map(F.lit, roots)).alias("sources"), F.lit(options.mode).alias("mode"), metadata.alias("metadata"))
    report_files.write(report_files.Report(head, findings, warnings), path)
    return report_files.read(spark, path)


def mount(spark: SparkSession, path: str, strict: bool = False, heal: bool = False) -> DataFrame:
    """Entries of a container; heal: what is left of one that can't be read or isn't known."""
    files = ranged.rows_of(spark, ranged.regular_files(path))
    listed = containers.mount_files(files, strict and not heal)
    if not heal:
        return listed
    good = listed.where("error is null")
    rest = files.join(good.select("source_path").distinct(), "source_path", "left_anti")
    null = F.lit(None).cast("string")
    healed = healer.heal_files(rest).select("source_path", F.lit("healed").alias("kind"), F.when(F.col("found") == "vhdx_header", "vhdx_redundant_recovery.raw").otherwise(F.col("found")).alias("name"), "offset", "size", F.lit(False).alias("encrypted"), null.alias("error"))
    return good.unionByName(healed)


def detect(spark: SparkSession, members: list[str]) -> DataFrame:
    """Report on the array whose members are given, by the first and last 8 MiB of each."""
    members = sources_of(members)
    if not members:
        raise ValueError("no members given")
    window = raid.READ_WINDOW
    ends = ranged.chunks(spark, members, window, 0, stop=window, tail=window)
    joined = ends.groupBy("source_path").agg(F.array_sort(F.collect_list(F.struct("chunk_start", "content"))).alias("p"))  # three blocks at most
    content = F.aggregate("p.content", F.lit(b""), lambda a, x: F.concat(a, x))
    return raid.detect(raid.probe(joined.select("source_path", content.alias("content"))))


def reconstruct(spark: SparkSession, members: list[str], mode: str, stripe: int, output: str, layout: str = "left_symmetric") -> dict:
    """members: paths, or missing, none or - for one that is not there."""
    return raid.reconstruct(spark, [None if m.strip().lower() in ("missing", "none", "-") else m for m in members], mode, stripe, output, layout)


def recover(findings: DataFrame, dest: str, manifest: str, sources: list[str], overwrite: bool = False, preserve: bool = False, other_device: bool = True) -> DataFrame:
    """Writes the bytes of findings (as scan gives them) below dest, which must lie on another device than the sources."""
    recovery.safe_destination(dest, sources, other_device)
    return recovery.recover(findings.withColumn("hint", F.col("container")), dest, manifest, sources, overwrite, preserve)


def recover_report(spark: SparkSession, path: str, dest: str, manifest: str, overwrite: bool = False, preserve: bool = False, other_device: bool = True) -> DataFrame:
    """Recovers the findings of a report (see report_files.read)."""
    report = report_files.read(spark, path)
    sources = report.head.select(F.explode("sources")).distinct().collect()  # the roots that were given to the scan
    items = report.findings.select("id", "source_path", F.col("source_fingerprint").alias("fp"), F.col("container_path").alias("container"), F.coalesce("reconstruction_context.reconstructed_path", "container_path").alias("hint"), "offset", "size", F.col("signature_id").alias("sig"), F.col("display_name").alias("name"), "extension")

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([ranged.size_of(p) if os.path.exists(p) else 0 for p in b.column(0).to_pylist()], pa.int64())], ["source_path", "length"])

    items = items.join(items.select("source_path").distinct().mapInArrow(sized, "source_path string, length long"), "source_path")
    recovery.safe_destination(dest, [r[0] for r in sources], other_device)
    return recovery.recover(items, dest, manifest, [r[0] for r in sources], overwrite, preserve)


def signature_summary(spark: SparkSession, path: str | None = None, profile: str = "strict") -> DataFrame:
    """Number and greatest length of the signatures in a JSON file, or of the built-in ones."""
    table = signatures.from_json(spark, path) if path else signatures.builtin(spark, profile)
    signatures.compiled(table)  # raises ValueError where a magic can't be read
    return signatures.summary(table)


def hex_dump(spark: SparkSession, path: str, offset: int = 0, length: int = 256) -> DataFrame:
    """offset, line: 16 bytes a line, of at most 16 MiB."""
    data = ranged.block(spark, path, offset, min(length, 16 << 20))
    rows = spark.createDataFrame([(bytearray(data),)], "content binary").where(F.octet_length("content") > 0)
    rows = rows.select("content", F.explode(F.sequence(F.lit(0), F.octet_length("content") - 1, F.lit(16))).alias("k"))
    at = F.col("k").cast("long") + offset
    return rows.select(at.alias("offset"), hex_line(F.substring(F.col("content"), F.col("k") + 1, F.lit(16)), at).alias("line"))


def file_systems(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x, x == "ntfs") for x in FILE_SYSTEMS], "name string, parsed boolean")


def _capability_rows(policy: str) -> list[tuple[str, bool, str | None]]:
    rows: list[tuple[str, bool, str | None]] = [("native-core", True, None)]
    if policy != "native_only":
        rows += [(t, False, "outside programs are not run") for t in TOOLS]
    if policy == "external_preferred":
        rows.append(("adapter-policy", True, "external adapters are preferred when available"))
    return rows


def _capability_warnings(policy: str) -> list[str]:
    return [f"Adapter '{name}' unavailable (external): {note}" for name, there, note in _capability_rows(policy) if not there]


def capabilities(spark: SparkSession, policy: str = "native_only") -> DataFrame:
    """Tools that a scan could use under a policy: the engine's own core; outside programs are named, not run."""
    return spark.createDataFrame(_capability_rows(policy), "name string, available boolean, note string")
