"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes handed to Python at once; with very long texts the default of 10,000 rows doesn't fit a worker.
ARROW_ROWS, ARROW_BYTES = "2048", str(1 << 20)


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run on one machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tracehound-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/tracehound/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Removes the files of tables that written() gave, once nothing will read them again."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/tracehound/" not in path:
                raise ValueError(f"not a table of written(): {path}")
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI.create(path))  # inputFiles() gives encoded addresses
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def arrow_rows(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(value: Column, body) -> Column:
    """body(value) with value computed once: an expression named by a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_key(text: str | Column = "text") -> Column:
    """With doc_id, names a row even where ids repeat."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def uid_of(docs: DataFrame) -> tuple[Column, bool]:
    """A long that names a row, and whether it is doc_id itself.

    Where ids repeat or are null it is a hash of id and text instead, which equal rows share.
    """
    plain = not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    named = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))
    return (F.col("doc_id").cast("long") if plain else named), plain
