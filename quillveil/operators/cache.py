"""Detection results kept by text: each distinct text of a tenant is searched once a version.

The cache is a table (version, tenant, digest, spans); digests are salted, so the table tells nothing about texts.  Results of another
version are never served: a sweep drops them.

A ``Store`` keeps such a table in a folder, by version and bucket of the digests: what is new is added to its buckets, and nothing else is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from . import audit, detection
from .spans import SPANS_TYPE

SCHEMA = "version string, tenant string, digest string"
#: Hex digits of a digest that make its bucket: 256 buckets.
BUCKET_DIGITS = 2


def key(salt: bytes, tenant: Column, text: Column) -> list[Column]:
    """The digests that a text of a tenant is kept by."""
    return [audit.digest(salt, tenant).alias("tenant"), audit.digest(salt, text).alias("digest")]


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], SCHEMA).withColumn("spans", F.lit(None).cast(SPANS_TYPE))


def probe(df: DataFrame, cache: DataFrame, salt: bytes, tenant: str, text: str = "text", version: str | None = None) -> DataFrame:
    """df with hit: whether the cache holds its text at this version."""
    own = df.withColumns(dict(zip(("__tenant", "__digest"), key(salt, F.col(f"`{tenant}`"), F.col(f"`{text}`")), strict=True)))
    held = cache.where(F.col("version") == (version or detection.version())).select(F.col("tenant").alias("__tenant"), F.col("digest").alias("__digest"), F.lit(True).alias("hit")).distinct()
    return own.join(held, ["__tenant", "__digest"], "left").select(*df.columns, F.coalesce("hit", F.lit(False)).alias("hit"))


def _searched(df: DataFrame, cache: DataFrame, salt: bytes, tenant: str, text: str, into: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(df with spans, (tenant, digest, spans) of the texts that the cache didn't hold)."""
    given = df.select(*[c for c in df.columns if c != into])
    own = given.withColumns(dict(zip(("__tenant", "__digest"), key(salt, F.col(f"`{tenant}`"), F.col(f"`{text}`")), strict=True)))
    held = cache.where(F.col("version") == version).select(F.col("tenant").alias("__tenant"), F.col("digest").alias("__digest"), "spans").dropDuplicates(["__tenant", "__digest"])
    texts = own.where(F.col(f"`{text}`").isNotNull()).groupBy("__tenant", "__digest").agg(F.any_value(F.col(f"`{text}`")).alias("__text"))  # copies become one before they are shuffled
    distinct = texts.join(held, ["__tenant", "__digest"], "left_anti")
    fresh = tables.table(detection.detect(distinct, "__text", "spans", keep=["__tenant", "__digest"]))
    known = held.unionByName(fresh)
    out = own.join(known.withColumnRenamed("spans", "__spans"), ["__tenant", "__digest"], "left")
    return out.select(*given.columns, F.coalesce("__spans", F.array().cast(SPANS_TYPE)).alias(into)), fresh.toDF("tenant", "digest", "spans")


def detect_cached(df: DataFrame, cache: DataFrame, salt: bytes, tenant: str, text: str = "text", into: str = "spans", version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(df with spans, the cache with what was new).  Each distinct missing text is searched once; a null text has no findings and isn't kept."""
    version = version or detection.version()
    out, fresh = _searched(df, cache, salt, tenant, text, into, version)
    return out, sweep(cache, version).unionByName(fresh.select(F.lit(version).alias("version"), "tenant", "digest", "spans"))


def sweep(cache: DataFrame, version: str) -> DataFrame:
    """The cache without results of other versions."""
    return cache.where(F.col("version") == version)


class Store:
    """A cache in a folder of Parquet files, by version and bucket.

    A lookup reads one version; additions are new files in the buckets that they belong to, so two runs may add at once, and a text that both
    add is served once.  Where a run is lost while it adds, its files don't appear.  merge makes one file of the files of crowded buckets and should run
    while nothing is added; sweep removes other versions' folders.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _there(self) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _all(self) -> DataFrame:
        if not self._there():
            return empty(self.spark).withColumn("bucket", F.lit(""))
        schema = empty(self.spark).withColumn("bucket", F.lit("").cast("string")).schema
        return self.spark.read.schema(schema).parquet(self.path)

    def rows(self, version: str | None = None) -> DataFrame:
        """(version, tenant, digest, spans) of a version, each text once."""
        rows = self._all().where(F.col("version") == (version or detection.version()))
        return rows.dropDuplicates(["tenant", "digest"]).select("version", "tenant", "digest", "spans")

    def detect(self, df: DataFrame, salt: bytes, tenant: str, text: str = "text", into: str = "spans", version: str | None = None) -> DataFrame:
        """df with spans; what the store didn't hold is searched and added."""
        version = version or detection.version()
        held = self._all().where(F.col("version") == version)
        out, fresh = _searched(df, held.select("version", "tenant", "digest", "spans"), salt, tenant, text, into, version)
        rows = fresh.withColumns({"version": F.lit(version), "bucket": F.substring("digest", 1, BUCKET_DIGITS)})
        rows.repartition("bucket").write.mode("append").partitionBy("version", "bucket").parquet(self.path)
        return out

    def merge(self, most_files: int = 8, version: str | None = None) -> int:
        """Rewrites the buckets of a version that have more files than that, each text once; how many buckets."""
        version = version or detection.version()
        own = self._all().where(F.col("version") == version)
        counts = own.select("bucket", F.input_file_name().alias("file")).groupBy("bucket").agg(F.countDistinct("file").alias("files")).where(F.col("files") > most_files)
        crowded = [r["bucket"] for r in counts.collect()]  # of 256 at most
        if crowded:
            rows = tables.table(own.where(F.col("bucket").isin(crowded)).dropDuplicates(["tenant", "digest"]))
            rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "bucket").parquet(self.path)
        return len(crowded)

    def sweep(self, version: str | None = None) -> None:
        """Removes what other versions left, folder by folder, without reading it."""
        if not self._there():
            return
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(self.path)
        system = at.getFileSystem(context._jsc.hadoopConfiguration())
        for entry in system.listStatus(at):
            name = entry.getPath().getName()
            if name.startswith("version=") and name != f"version={version or detection.version()}":
                system.delete(entry.getPath(), True)
