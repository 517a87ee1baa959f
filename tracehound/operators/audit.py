"""Audit log: JSON lines, each of which names the hash of the one before it."""

from __future__ import annotations

import datetime
import hashlib
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehound.operators import reports

# Names of the two ways to sign.
KEYED, CHAINED = "keyed-sha256-v1", "hash-chain-sha256-v1"
#: Lines that are checked side by side.
RANGE = 100_000


def signature(entry_hash: Column, envelope: Column, key: str | None = None) -> Column:
    """Keyed or unkeyed digest over an entry's hash and envelope."""
    named = bool(key and key.strip())
    return F.sha2(F.concat_ws("|", *([F.lit(KEYED), F.lit(key)] if named else [F.lit(CHAINED)]), entry_hash, envelope), 256)


def _last_line(path: str) -> str:
    """The log's last line that isn't blank, read from its end."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        held = b""
        while at and b"\n" not in held.strip():
            step = min(at, 1 << 16)
            at -= step
            f.seek(at)
            held = f.read(step) + held
    lines = held.decode().strip().splitlines()
    return lines[-1] if lines else ""


def append(path: str, event: str, payload: dict, key: str | None = None) -> dict:
    """Adds an entry to the log and returns it."""
    last = _last_line(path) if os.path.exists(path) else ""
    try:
        before = json.loads(last)["entry_hash"]
    except (ValueError, KeyError, TypeError):
        before = reports.GENESIS
    envelope = {"event_type": event, "payload": payload, "prev_hash": before, "timestamp": datetime.datetime.now(datetime.timezone.utc).isoformat()}
    text = json.dumps(envelope, separators=(",", ":"), sort_keys=True, ensure_ascii=False)
    digest = hashlib.sha256(text.encode()).hexdigest()
    way = KEYED if key and key.strip() else CHAINED
    signed = hashlib.sha256("|".join([way, *([key] if way == KEYED else []), digest, text]).encode()).hexdigest()
    entry = {"entry_hash": digest, "envelope": envelope, "signature": signed, "signature_mode": way}
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(entry, separators=(",", ":"), sort_keys=True, ensure_ascii=False) + "\n")
        f.flush()
        os.fsync(f.fileno())
    return entry


def check(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """seq, event_type, linked (names the entry before it), hash_valid, signature_valid for every line of a log."""
    lines = spark.read.text(path).where(F.btrim("value") != "").select(F.monotonically_increasing_id().alias("seq"), "value")
    part = lambda p: F.get_json_object("value", p)
    rows = lines.select("seq", part("$.envelope").alias("envelope"), part("$.envelope.event_type").alias("event_type"), part("$.envelope.prev_hash").alias("prev"), part("$.entry_hash").alias("entry"), part("$.signature").alias("signature"))
    rows = reports.chain_check(rows, "seq", "prev", "entry", F.floor(F.col("seq") / RANGE))
    own = F.sha2("envelope", 256) == F.col("entry")
    return rows.select("seq", "event_type", F.col("valid").alias("linked"), own.alias("hash_valid"), (signature(F.col("entry"), F.col("envelope"), key) == F.col("signature")).alias("signature_valid"))
