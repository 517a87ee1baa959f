"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (uid, comp) after merging along edges (u, v): comp is the least label reachable.

    Vertices that labels lack are their own label; those with edges are in the result. Each round
    every component hooks to its least neighbour if that is smaller, chains are halved until flat, and
    the edges are drawn between what is left; so components with an edge at least halve and only their
    tables are written, in the shared folder.
    """
    ends = edges.select(F.col("u").alias("uid")).unionAll(edges.select(F.col("v").alias("uid"))).distinct()
    labels = written(labels.unionByName(ends.join(labels, "uid", "left_anti").select("uid", F.col("uid").alias("comp"))), "labels")
    a = labels.select(F.col("uid").alias("u"), F.col("comp").alias("a"))
    b = labels.select(F.col("uid").alias("v"), F.col("comp").alias("b"))
    between = written(edges.join(a, "u").join(b, "v").where("a != b").select("a", "b").distinct(), "edges")
    into = None
    while True:
        hooks = written(between.union(between.select("b", "a")).groupBy("a").agg(F.min("b").alias("p")).where("p < a"), "hooks")
        if not hooks.limit(1).count():
            break
        while True:
            up = hooks.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            further = written(hooks.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), "hooks")
            hooks = further.select("a", "p")
            if not further.where("moved").limit(1).count():
                break
        to = lambda name, new: hooks.select(F.col("a").alias(name), F.col("p").alias(new))
        between = written(between.join(to("a", "x"), "a", "left").join(to("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).where("a != b").distinct(), "edges")
        into = hooks if into is None else written(into.join(to("p", "x"), "p", "left").select("a", F.coalesce("x", "p").alias("p")).unionByName(hooks), "into")
    if into is None:
        return labels
    return written(labels.join(into.withColumnRenamed("a", "comp"), "comp", "left").select("uid", F.coalesce("p", "comp").alias("comp")), "labels")
