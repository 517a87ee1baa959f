"""Arrays: votes on topology, missing members, stripe order and XOR reconstruction."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracehound.functions.binary import int_le, latin1
from tracehound.sources import ranged

# Window at each end, superblock mark, levels, layouts, marks of other families.
READ_WINDOW, MDADM = 8 << 20, "\xfc\x4e\x2b\xa9"
LEVELS = {0: "raid0", 1: "raid1", 5: "raid5", 6: "raid6", 10: "raid10", 0xFFFFFFFF: "jbod"}
LAYOUTS = {0: "left_asymmetric", 1: "right_asymmetric", 2: "left_symmetric", 3: "right_symmetric"}
FAMILIES = [("windows_dynamic", ["privhead", "ldm_database"]), ("windows_storage_spaces", ["storage spaces", "spaces"]), ("hardware_ddf", ["snia ddf", "ddf_header"]), ("apple_raid", ["apple_raid", "appleraid"])]
#: Bytes of each member that are put together at once.
SPAN = 1 << 20


def dominant(df: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group; ties go to the least value."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("votes"))
    best = counts.groupBy(group).agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col(value))).alias("b"))
    return best.select(group, F.col(f"b.{value}").alias("dominant"), (-F.col("b.v")).alias("votes"))


def missing_slots(df: DataFrame, group: str, slot: str) -> DataFrame:
    """Slots from 1 to each group's largest that no row has."""
    seen = df.select(group, F.col(slot).cast("int").alias("slot")).distinct()
    every = seen.groupBy(group).agg(F.max("slot").alias("n")).select(group, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("slot"))
    return every.join(seen, [group, "slot"], "left_anti")


def parity(blocks: DataFrame, stripe: str, value: str) -> DataFrame:
    return blocks.groupBy(stripe).agg(F.bit_xor(value).alias("parity"), F.count("*").alias("members"))


def rebuild(blocks: DataFrame, parity_rows: DataFrame, stripe: str, member: str, value: str, missing: int) -> DataFrame:
    """Values of one missing member from the others and the parity."""
    left = blocks.where(F.col(member) != missing).groupBy(stripe).agg(F.bit_xor(value).alias("x"))
    return left.join(parity_rows.select(stripe, "parity"), stripe).select(stripe, F.col("x").bitwiseXOR(F.col("parity")).alias("rebuilt"))


def syndrome(stripes: DataFrame, group: str, size: int) -> DataFrame:
    """group, syndrome: XOR of all stripes (content) of a group, size bytes each; shorter or null ones count as zeros behind.

    Stripes are put together in each task first, so a group meets as one row a task.
    """
    if size < 4 or size % 4:
        raise ValueError("a stripe has a multiple of four bytes")
    kind = stripes.schema[group].dataType.simpleString()

    def folded(keys: list, blocks: list) -> tuple[list, list[bytes]]:
        held: dict = {}
        for k, data in zip(keys, blocks):
            x = np.frombuffer((data or b"")[:size].ljust(size, b"\0"), np.uint8)
            held[k] = held[k] ^ x if k in held else x
        return list(held), [x.tobytes() for x in held.values()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, blocks = folded(b.column(0).to_pylist(), b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(blocks, pa.binary())], [group, "syndrome"])

    def join(t: pa.Table) -> pa.Table:
        keys, blocks = folded(t.column(0).to_pylist(), t.column(1).to_pylist())
        return pa.table([pa.array(keys, t.schema.field(0).type), pa.array(blocks, pa.binary())], names=[group, "syndrome"])

    parts = stripes.select(group, "content").mapInArrow(scan, f"{group} {kind}, syndrome binary")
    return parts.groupBy(group).applyInArrow(join, f"{group} {kind}, syndrome binary")


def default_shr(disks: int) -> dict:
    """Layout taken for an array of the kind that says nothing of its own."""
    return {"mode": "shr", "chunk_size": 64 << 10, "disk_count": disks}


def parity_slot(stripe: Column, members: int, layout: str) -> Column:
    turn = F.pmod(stripe, F.lit(members))
    return turn if layout.startswith("right") else members - 1 - turn


def stripe_order(blocks: DataFrame, stripe: str, member: str) -> DataFrame:
    """Place of each block in a striped image: stripe by stripe, member by member, without one global sort."""
    n = blocks.groupBy(stripe).agg(F.count("*").alias("c"))
    n = n.withColumn("bucket", F.floor(F.col(stripe) / 4096))
    per = n.groupBy("bucket").agg(F.sum("c").alias("bc")).withColumn("base", F.coalesce(F.sum("bc").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    n = n.join(per.select("bucket", "base"), "bucket").withColumn("before", F.col("base") + F.coalesce(F.sum("c").over(W.partitionBy("bucket").orderBy(stripe).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(W.partitionBy(stripe).orderBy(member)) - 1
    return blocks.withColumn("k", inside).join(n.select(stripe, "before"), stripe).withColumn("place", (F.col("before") + F.col("k")).cast("long")).drop("k", "before")


def probe(evidence: DataFrame) -> DataFrame:
    """source_path, family, array_id, expected_members, member_index, stripe_size, mode, layout from each member's two ends.

    The superblock is at 4096, else the first in the head if aligned, else the first in the tail.
    """
    n = F.octet_length("content")
    head, tail = F.substring("content", 1, READ_WINDOW), F.substring(F.col("content"), F.greatest(n - READ_WINDOW, F.lit(0)) + 1, F.lit(READ_WINDOW))
    rows = evidence.select("source_path", "content", head.alias("head"), tail.alias("tail")).withColumns({"a": F.locate(MDADM, latin1(F.col("head"))) - 1, "b": F.locate(MDADM, latin1(F.col("tail"))) - 1})
    whole = lambda part, at: F.when(F.octet_length(F.substring(F.col(part), at + 1, F.lit(256))) == 256, F.substring(F.col(part), at + 1, F.lit(256)))
    fixed = F.when(F.substring("head", 4097, 4) == F.lit(MDADM.encode("latin-1")), whole("head", F.lit(4096)))
    block = F.coalesce(fixed, F.when((F.col("a") >= 0) & (F.col("a") % 4096 == 0), whole("head", F.col("a"))), F.when(F.col("b") >= 0, whole("tail", F.col("b"))))
    rows = rows.select("source_path", "head", "tail", block.alias("sb"))
    sb, known = F.col("sb"), F.col("sb").isNotNull()
    low = F.lower(F.concat(latin1(F.col("head")), F.lit("\n"), latin1(F.col("tail"))))
    other = F.lit("unknown")
    for family, marks in reversed(FAMILIES):
        holds = F.lit(False)
        for m in marks:
            holds = holds | F.contains(low, F.lit(m))
        other = F.when(holds, family).otherwise(other)
    name = F.lower(F.split(latin1(F.substring(sb, 33, 32)), "\\x00")[0])
    shr = F.contains(name, F.lit("syno")) | F.contains(F.lower("source_path"), F.lit("synology"))
    named = lambda at, names: F.create_map(*(F.lit(x) for p in names.items() for x in p))[int_le(sb, at, 4).cast("long")]
    fields = {
        "family": F.when(known & shr, "synology_shr").when(known, "mdadm").otherwise(other),
        "array_id": F.lower(F.hex(F.substring(sb, 17, 16))),
        "expected_members": F.nullif(int_le(sb, 0x5C, 4).cast("long"), F.lit(0)),
        "member_index": int_le(sb, 0x90, 4).cast("long"),
        "stripe_size": int_le(sb, 0x58, 4).cast("long") * 1024,
        "mode": named(0x48, {k: v for k, v in LEVELS.items()}),
        "layout": F.when(known, F.coalesce(named(0x4C, LAYOUTS), F.lit("unknown"))),
    }
    return rows.select("source_path", *(c.alias(k) for k, c in fields.items()))


def detect(probes: DataFrame, group: str | None = None) -> DataFrame:
    """One report for each group of members: detected, controller, mode, layout, stripe_size, counts, missing, degraded."""
    g = F.col(group) if group else F.lit("all")
    rows = probes.withColumn("_g", g)
    order = ["mdadm", "synology_shr", *(f for f, _ in FAMILIES)]

    def vote(value: str, ties: list[str]) -> DataFrame:
        place = F.array_position(F.array(*map(F.lit, ties)), F.col(value))
        counts = rows.where(F.col(value).isin(ties)).groupBy("_g", value).agg(F.count("*").alias("c"))
        return counts.groupBy("_g").agg(F.min_by(value, F.struct((-F.col("c")).alias("c"), place.alias("p"))).alias(value))

    size = rows.groupBy("_g").agg(F.max("stripe_size").alias("stripe_size"), F.greatest(F.max("expected_members"), F.count("*")).alias("expected_members"), F.count("*").alias("detected_members"), F.max(F.col("member_index").isNotNull()).alias("_i"))
    slots = F.explode(F.sequence(F.lit(0).cast("long"), F.col("expected_members") - 1))
    short = size.where("expected_members > detected_members")
    absent = short.where("_i").select("_g", slots.alias("member_index")).join(rows.select("_g", "member_index").distinct(), ["_g", "member_index"], "left_anti").select("_g", "member_index", F.concat(F.lit("Missing member slot #"), "member_index").alias("text"))
    beyond = short.where("not _i").select("_g", F.explode(F.sequence(F.col("detected_members") + 1, F.col("expected_members"))).alias("member_index"))
    absent = absent.unionByName(beyond.withColumn("text", F.concat(F.lit("Missing member #"), "member_index")))
    missing = absent.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("member_index", "text"))).alias("m")).select("_g", F.col("m.text").alias("missing"))
    out = size.join(vote("family", order), "_g", "left").join(vote("mode", list(LEVELS.values())), "_g", "left").join(vote("layout", ["unknown", *LAYOUTS.values()]), "_g", "left").join(missing, "_g", "left")
    mode = F.when(F.col("family") == "synology_shr", "shr").otherwise(F.coalesce("mode", F.lit("unknown")))
    cols = [F.col("family").isNotNull().alias("detected"), F.coalesce("family", F.lit("unknown")).alias("controller"), mode.alias("mode"), F.coalesce("layout", F.lit("unknown")).alias("layout"), "stripe_size", "expected_members", "detected_members", F.coalesce("missing", F.array().cast("array<string>")).alias("missing"), F.col("missing").isNotNull().alias("degraded")]
    return out.select(*([F.col("_g").alias(group)] if group else []), *cols)


def merged_span(mode: str, layout: str, stripe: int, first: int, held: list[bytes | None]) -> bytes:
    """The image's bytes for one span of all members; first: the number of its first stripe."""
    there = [x for x in held if x is not None]
    if mode == "raid1":
        return there[0]
    steps = range(0, max(map(len, there)), stripe)
    if mode == "raid0":
        return b"".join(x[a : a + stripe] for a in steps for x in there)
    gaps = [k for k, x in enumerate(held) if x is None]
    if gaps:
        whole = np.bitwise_xor.reduce([np.frombuffer(x, np.uint8) for x in there])
        held = [whole.tobytes() if x is None else x for x in held]
    out, n = [], len(held)
    for k, a in enumerate(steps):
        turn = (first + k) % n
        parity_at = turn if layout.startswith("right") else n - 1 - turn
        out += [held[(parity_at + d) % n][a : a + stripe] for d in range(1, n)]
    return b"".join(out)


def assembled(blocks: DataFrame, members: int, mode: str, stripe: int, layout: str = "left_symmetric", group: str | None = None) -> DataFrame:
    """position, content of arrays' images, from rows (slot, chunk_start, content[, group]) of the members that are there.

    All members of an array have chunks of the same starts, whole stripes long but for the last. The spans
    that begin at one place are put together; in raid5 a slot without a chunk is rebuilt.
    """
    keys = [group] if group else []
    there = blocks.select(*keys, "slot", "chunk_start", "content")
    kinds = {c: blocks.schema[c].dataType.simpleString() for c in keys}
    schema = ", ".join([*(f"{c} {t}" for c, t in kinds.items()), "position long, content binary"])
    raid0 = mode == "raid0"

    def put(key: tuple, table: pa.Table) -> pa.Table:
        held: list[bytes | None] = [None] * members
        at = key[-1].as_py()
        for slot, data in zip(table["slot"].to_pylist(), table["content"].to_pylist()):
            held[slot] = data
        present = sum(x is not None for x in held)
        factor = present if raid0 else 1 if mode == "raid1" else members - 1
        cols = [*(pa.array([k.as_py()], k.type) for k in key[:-1]), pa.array([at * factor], pa.int64()), pa.array([merged_span(mode, layout, stripe, at // stripe, held)], pa.binary())]
        return pa.table(cols, names=[*keys, "position", "content"])

    return there.groupBy(*keys, "chunk_start").applyInArrow(put, schema)


def image(spark: SparkSession, members: list[str | None], mode: str, stripe: int, layout: str = "left_symmetric") -> DataFrame:
    """position, content of the array's image. None is a missing member: left out in raid0, rebuilt in raid5 (one at most)."""
    there = [m for m in members if m]
    if not there or stripe < 1 or len(set(there)) < len(there):
        raise ValueError("needs members, each named once, and a stripe size")
    if mode not in ("raid0", "raid1", "raid5"):
        raise ValueError(f"unsupported mode {mode}")
    if mode == "raid5" and (len(members) < 3 or len(members) - len(there) > 1):
        raise ValueError("raid5 needs three members, of which one may be missing")
    sizes = [ranged.size_of(m) for m in there]
    least = sizes[0] if mode == "raid1" else min(sizes) if mode == "raid0" else min(sizes) // stripe * stripe
    read = there[:1] if mode == "raid1" else there
    span = stripe * max(1, -(-SPAN // stripe))
    places = {os.path.realpath(m): k for k, m in enumerate(members) if m in read}
    slot = F.create_map(*(F.lit(x) for p in places.items() for x in p))
    rows = ranged.chunks(spark, [os.path.realpath(m) for m in read], span, stop=least).where(F.col("chunk_start") < least)
    rows = rows.select(slot[F.col("source_path")].alias("slot"), "chunk_start", F.substring(F.col("content"), F.lit(1), (F.lit(least) - F.col("chunk_start")).cast("int")).alias("content"))
    return assembled(rows, len(members), mode, stripe, layout)


def reconstruct(spark: SparkSession, members: list[str | None], mode: str, stripe: int, output: str, layout: str = "left_symmetric") -> dict:
    """Writes the image to a file that executors share, each span at its place, so a repeated task does no harm."""
    if os.path.realpath(output) in {os.path.realpath(m) for m in members if m}:
        raise ValueError("the output is a member")
    parts = image(spark, members, mode, stripe, layout)
    with open(output, "wb"):
        pass

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(output, "r+b") as f:
            for b in batches:
                ends = []
                for at, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    f.seek(at)
                    f.write(data)
                    ends.append(at + len(data))
                f.flush()
                os.fsync(f.fileno())
                yield pa.RecordBatch.from_arrays([pa.array(ends, pa.int64())], ["ending"])

    end = parts.mapInArrow(write, "ending long").agg(F.coalesce(F.max("ending"), F.lit(0))).first()[0]
    return {"mode": mode, "bytes_written": end, "reconstructed_missing_members": sum(m is None for m in members), "output": output}
