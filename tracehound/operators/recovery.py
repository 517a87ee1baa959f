"""Recovered files: where each finding goes, what is written, and the manifest that lets a run go on.

Runs are appended to the manifest folder as Parquet, so the folder must be shared by driver and executors,
as must the destination.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUFFER = 64 << 10
MANIFEST = "manifest_key string, source_path string, offset long, expected long, bytes_written long, out_path string, completed boolean, sha256 string, state string, updated_at timestamp"


def file_name(name: Column, extension: Column) -> Column:
    clean, ext = F.regexp_replace(name, "[^A-Za-z0-9_-]", "_"), F.lower(F.btrim(F.coalesce(extension, F.lit("")), F.lit(".")))
    return F.when((ext == "") | F.endswith(F.lower(clean), F.concat(F.lit("."), ext)), clean).otherwise(F.concat(clean, F.lit("."), ext))


def relative(path: Column) -> Column:
    """Parts of a path without root, . and .., each without characters that a name can't have."""
    parts = F.filter(F.split(path, r"[/\\]+"), lambda x: ~x.isin("", ".", "..") & ~F.rlike(x, F.lit("^[A-Za-z]:$")))
    return F.array_join(F.transform(parts, lambda x: F.regexp_replace(x, "[^A-Za-z0-9._-]", "_")), "/")


def output_path(name: Column, extension: Column, fp: Column, hint: Column, preserve: bool) -> Column:
    """Flat, or fingerprint/hint; the name is put below a hint whose last part has no dot."""
    file = file_name(name, extension)
    if not preserve:
        return file
    root = F.when(F.coalesce(fp, F.lit("")) == "", "unknown_source").otherwise(F.regexp_replace(fp, "[^A-Za-z0-9._-]", "_"))
    rel = relative(F.coalesce(hint, F.lit("")))
    return F.when(rel == "", F.concat_ws("/", root, file)).when(F.contains(F.element_at(F.split(rel, "/"), -1), F.lit(".")), F.concat_ws("/", root, rel)).otherwise(F.concat_ws("/", root, rel, file))


def manifest_key(df_fp: Column, container: Column, offset: Column, sig: Column, id_: Column) -> Column:
    fp = F.when(F.coalesce(df_fp, F.lit("")) == "", "unknown-source").otherwise(df_fp)
    return F.concat_ws("|", fp, F.coalesce(container, F.lit("")), offset.cast("string"), sig, id_)


def safe_destination(dest: str, sources: list[str], other_device: bool = False) -> None:
    """Raises ValueError if dest is a source or inside one or, if asked for, on a source's device."""
    real = os.path.realpath(dest)
    up = real
    while not os.path.exists(up):
        up = os.path.dirname(up)
    for s in map(os.path.realpath, sources):
        if real == s or real.startswith(s.rstrip("/") + "/"):
            raise ValueError(f"destination {dest} lies in source {s}")
        if other_device and os.path.exists(s) and os.stat(s).st_dev == os.stat(up).st_dev:
            raise ValueError(f"destination {dest} is on the device of source {s}")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The last entry of each key; none if nothing was recovered yet."""
    if not os.path.isdir(f"{path}/runs"):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/runs/*")
    names = [c for c in rows.columns if c != "manifest_key"]
    best = rows.where("state != 'skipped'").groupBy("manifest_key").agg(F.max_by(F.struct(*names), "updated_at").alias("b"))
    return best.select("manifest_key", *(F.col(f"b.{c}").alias(c) for c in names))


def plan(items: DataFrame, preserve: bool = False) -> DataFrame:
    """Items with manifest_key, out_path, expected. Items beyond their source are left out; of items with one path all but the first by id are marked dropped.

    items: id, source_path, fp, container, hint, offset, size, length, sig, name, extension.
    """
    col = F.col
    size = F.least("size", col("length") - col("offset"))
    rows = items.where((col("offset") < col("length")) & (size > 0))
    rows = rows.select("id", "source_path", "offset", manifest_key(col("fp"), col("container"), col("offset"), col("sig"), col("id")).alias("manifest_key"), output_path(col("name"), col("extension"), col("fp"), F.coalesce("hint", "container"), preserve).alias("out_path"), size.cast("long").alias("expected"))
    first = rows.groupBy("out_path").agg(F.min_by("manifest_key", F.struct("id", "manifest_key")).alias("_key"))
    return rows.join(first, "out_path").withColumn("dropped", col("manifest_key") != col("_key")).drop("_key").dropDuplicates(["manifest_key"])


def with_manifest(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Planned rows with had, done, old_sha of the manifest's entry by key or, where older runs wrote it so, by id."""
    old = known.select("manifest_key", F.col("bytes_written").alias("had"), F.col("completed").alias("done"), F.col("sha256").alias("old_sha"))
    by_id = old.select(F.col("manifest_key").alias("id"), F.col("had").alias("had_i"), F.col("done").alias("done_i"), F.col("old_sha").alias("sha_i"))
    both = rows.join(old, "manifest_key", "left").join(by_id.withColumnRenamed("id", "_id"), F.col("id").cast("string") == F.col("_id"), "left").drop("_id")
    pick = lambda a, b: F.when(F.col("had").isNotNull() | F.col("done").isNotNull(), F.col(a)).otherwise(F.col(b)).alias(a)
    return both.select(*rows.columns, pick("had", "had_i"), pick("done", "done_i"), pick("old_sha", "sha_i"))


def digests(planned: DataFrame, evidence: DataFrame) -> DataFrame:
    """planned rows (source_path, offset, expected) with the digest of the bytes that a recovery would write, from rows that hold whole sources."""
    part = F.substring(F.col("content"), (F.col("offset") + 1).cast("int"), F.col("expected").cast("int"))
    return planned.join(evidence.select("source_path", "content"), "source_path").withColumn("sha256", F.sha2(part, 256)).drop("content")


def _copy(source: str, offset: int, size: int, path: str, start: int, buffer: int = BUFFER) -> tuple[int, str]:
    """Bytes written in all and their digest; what the file holds up to start stays."""
    digest, at = hashlib.sha256(), 0
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(source, "rb") as f, open(path, "r+b" if start else "wb") as out:
        while at < start and (data := out.read(min(buffer, start - at))):
            digest.update(data)
            at += len(data)
        out.seek(at)
        out.truncate()
        f.seek(offset + at)
        while at < size and (data := f.read(min(buffer, size - at))):
            out.write(data)
            digest.update(data)
            at += len(data)
        out.flush()
        os.fsync(out.fileno())
    return at, digest.hexdigest()


def recover(items: DataFrame, dest: str, manifest: str, sources: list[str], overwrite: bool = False, preserve: bool = False) -> DataFrame:
    """Writes the files and returns this run's entries: state is copied, resumed, reused, skipped, dropped or failed.

    What is there beforehand is written down first, so a task that is run again after a lost executor
    does the same as before. A file that no entry knows stays as it is (skipped).
    """
    spark = items.sparkSession
    safe_destination(dest, sources)
    run = uuid.uuid4().hex
    rows = with_manifest(plan(items, preserve), load_manifest(spark, manifest))
    rows = rows.select("manifest_key", "source_path", "offset", "expected", F.concat(F.lit(dest.rstrip("/") + "/"), "out_path").alias("out_path"), "dropped", "had", "done", "old_sha")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = [os.path.getsize(p) if os.path.isfile(p) else -1 for p in b.column("out_path").to_pylist()]
            yield b.append_column("present", pa.array(size, pa.int64()))

    shape = "manifest_key string, source_path string, offset long, expected long, out_path string, dropped boolean, had long, done boolean, old_sha string"
    looked = f"{manifest}/plans/{run}"
    rows.mapInArrow(look, f"{shape}, present long").write.parquet(looked)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                there = r["present"] >= 0 and not overwrite
                wrote, sha, state = r["had"] or 0, r["old_sha"], None
                if r["dropped"]:
                    state, wrote, sha = "dropped", 0, None
                elif there and r["had"] is None:
                    state = "skipped"
                elif there and r["done"]:
                    state = "reused"
                else:
                    start = min(r["present"], wrote, r["expected"]) if there else 0
                    try:
                        wrote, sha = _copy(r["source_path"], r["offset"], r["expected"], r["out_path"], start)
                        state = "resumed" if start else "copied"
                    except OSError as e:  # the entry says how far it got; the next run goes on from there
                        held = os.path.getsize(r["out_path"]) if os.path.isfile(r["out_path"]) else 0
                        wrote, sha, state = held, None, f"failed: {e.strerror}"
                done = state == "reused" or state in ("copied", "resumed") and wrote == r["expected"]
                out.append((r["manifest_key"], r["source_path"], r["offset"], r["expected"], wrote, r["out_path"], done, sha if done else None, state))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 9, kinds)], [c.split()[0] for c in MANIFEST.split(", ")[:9]])

    todo = spark.read.schema(f"{shape}, present long").parquet(looked).repartition("out_path")
    done = todo.mapInArrow(copy, ", ".join(MANIFEST.split(", ")[:9])).withColumn("updated_at", F.current_timestamp())
    done.write.parquet(f"{manifest}/runs/{run}")
    return spark.read.schema(MANIFEST).parquet(f"{manifest}/runs/{run}")
