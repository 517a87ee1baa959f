"""Scan reports as files: a head of one row, findings and warnings of any number."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehound.operators.reports import first_of

# Names of a report's fields.
FINDING = "id string, display_name string, extension string, signature_id string, source_path string, source_fingerprint string, evidence_path string, container_path string, offset long, size long, confidence double, validation_score double, category string, encrypted boolean, encryption_state string, reconstruction_context struct<volume_layer:string,reconstructed_path:string,notes:string>, notes string"
METADATA = "bytes_scanned:bigint,elapsed_ms:bigint,quick_hits:bigint,deep_hits:bigint,container_hits:bigint,container_type:string,volume_layers:array<string>,adapter_capabilities:array<string>"
HEAD = f"scan_id string, started_at timestamp, finished_at timestamp, source string, sources array<string>, mode string, metadata struct<{METADATA}>"
COUNTERS = ["bytes_scanned", "quick_hits", "deep_hits", "container_hits", "elapsed_ms"]
#: What readers see where an older report lacks a field.
ABSENT = {"source_fingerprint": "", "evidence_path": "", "validation_score": 0.0, "encryption_state": "unknown", "encrypted": False}
ORDER = ["source_path", "offset", "signature_id"]


@dataclass
class Report:
    """head: one row (HEAD); findings: rows of FINDING; warnings: rows of warning."""

    head: DataFrame
    findings: DataFrame
    warnings: DataFrame


def scan_id() -> Column:
    return F.concat(F.lit("scan-"), F.expr("uuid()"))


def default_path(source: Column) -> Column:
    """Name of a report that is given none: that of the source, or scan."""
    last = F.regexp_extract(source, r"([^/]+)/*$", 1)
    return F.concat(F.when(last.isin("", ".", ".."), "scan").otherwise(last), F.lit(".tracehound.scan.json"))


def in_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*ORDER, F.coalesce("container_path", F.lit("")))


def top(findings: DataFrame, n: int = 500) -> DataFrame:
    """The first n findings by source, offset, signature and container, as a table shows them."""
    return in_order(findings).limit(n)


def find(findings: DataFrame, id_: str) -> DataFrame:
    return findings.where(F.col("id") == id_)


def layers(raid: Column, encrypted: Column, found: Column) -> Column:
    """Volume layers of a scan, each once, in the order in which a scan meets them."""
    named = [F.lit("physical"), F.when(raid, "raid_virtual"), F.when(encrypted, "encrypted_volume"), F.when(found, "filesystem")]
    return F.array_distinct(F.filter(F.array(*named), lambda x: x.isNotNull()))


def counters(hits: DataFrame) -> DataFrame:
    """quick_hits, deep_hits, container_hits of hits (branch), as one row; repeated hits count."""
    count = lambda b: F.coalesce(F.sum((F.col("branch") == b).cast("long")), F.lit(0)).cast("long").alias(f"{b}_hits")
    return hits.agg(count("quick"), count("deep"), count("container"))


def write(report: Report, path: str) -> None:
    """JSON lines below path: head, findings (sorted in each file's range) and warnings."""
    report.head.write.json(f"{path}/head")
    in_order(report.findings).write.json(f"{path}/findings")
    report.warnings.write.json(f"{path}/warnings")


def read(spark: SparkSession, path: str) -> Report:
    """A report that write() gave, or one JSON document with findings and warnings inside."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isDirectory()
    if folder:
        head = spark.read.schema(HEAD).json(f"{path}/head")
        findings = spark.read.schema(FINDING).json(f"{path}/findings")
        warnings = spark.read.schema("warning string").json(f"{path}/warnings")
    else:
        inner = FINDING.replace(" struct<", "§").replace(", ", ",").replace(" ", ":").replace("§", ":struct<")
        whole = spark.read.schema(f"{HEAD}, findings array<struct<{inner}>>, warnings array<string>").option("multiLine", True).json(path)
        head = whole.drop("findings", "warnings")
        findings = whole.select(F.inline("findings"))
        warnings = whole.select(F.explode("warnings").alias("warning"))
    return Report(head, findings.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in ABSENT.items()}), warnings)


def merged_findings(parts: list[DataFrame], keep_containers: bool = False) -> DataFrame:
    """Findings of all parts, one for each source, offset and signature (that of the first part), sorted.

    keep_containers: findings inside different containers are different ones, too.
    """
    rows = None
    for k, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(k))
        rows = p if rows is None else rows.unionByName(p)
    inside = F.coalesce("container_path", F.lit(""))
    keys = [*ORDER, *(["_inside"] if keep_containers else [])]
    best = first_of(rows.withColumn("_inside", inside), keys, ["_part", "_inside", "id"]).drop("_part", "_inside")
    return in_order(best) if keep_containers else best.orderBy(*ORDER)


def merge(reports: list[Report], keep_containers: bool = False) -> Report:
    """One report of several: counters and times summed, lists put together, the first one's id marked merged."""
    if not reports:
        raise ValueError("no reports given")
    heads = None
    for k, r in enumerate(reports):
        h = r.head.withColumn("_part", F.lit(k))
        heads = h if heads is None else heads.unionByName(h)
    row = heads.agg(F.array_sort(F.collect_list(F.struct("_part", *(c for c in heads.columns if c != "_part")))).alias("h"), F.max("finished_at").alias("last"))  # a row a report
    first = F.get("h", F.lit(0))
    m = F.col("h.metadata")
    joined = lambda a: F.array_distinct(F.flatten(F.filter(a, lambda x: x.isNotNull())))
    total = lambda c: F.aggregate(m, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x[c], F.lit(0)))
    kind = F.get(F.filter(F.transform(m, lambda x: x["container_type"]), lambda x: x.isNotNull()), F.lit(0))
    metadata = F.struct(total("bytes_scanned").alias("bytes_scanned"), total("elapsed_ms").alias("elapsed_ms"), total("quick_hits").alias("quick_hits"), total("deep_hits").alias("deep_hits"), total("container_hits").alias("container_hits"), kind.alias("container_type"), joined(F.transform(m, lambda x: x["volume_layers"])).alias("volume_layers"), first["metadata"]["adapter_capabilities"].alias("adapter_capabilities"))
    head = row.select(F.concat(first["scan_id"], F.lit("-merged")).alias("scan_id"), first["started_at"].alias("started_at"), F.col("last").alias("finished_at"), first["source"].alias("source"), joined(F.transform("h", lambda x: x["sources"])).alias("sources"), first["mode"].alias("mode"), metadata.alias("metadata"))
    warnings = reports[0].warnings
    for r in reports[1:]:
        warnings = warnings.unionByName(r.warnings)
    return Report(head, merged_findings([r.findings for r in reports], keep_containers), warnings)
