"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def components(edges: DataFrame, scratch: shared.Scratch | None = None) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node it is connected to.

    Every step joins edges with one row for each node, so a node with many neighbours is only a long
    run of rows, and the number of steps grows with the logarithm of the longest path.
    Each result is written to the shared folder, which cuts the lineage; scratch: what removes the last one.
    """
    spark = edges.sparkSession
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    path = shared.write(pairs)
    state = _state(spark.read.parquet(path))
    while True:
        now = spark.read.parquet(path)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        kept = shared.write(large)
        large = spark.read.parquet(kept)
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(down.select("u", F.col("m").alias("v"))).distinct()
        new = shared.write(small)
        for old in (path, kept):
            shared.remove(spark, old)
        path, before = new, state
        state = _state(spark.read.parquet(path))
        if state == before:
            done = spark.read.parquet(path)
            if scratch:
                scratch.paths.append(path)
            return done.select(F.col("u").alias("node"), F.col("v").alias("component")).union(done.select("v", "v").distinct())


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
