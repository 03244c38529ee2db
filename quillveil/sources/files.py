"""Files as tables: directories of texts, annotated corpora, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detection
from . import directory

CORPUS = "id string, lang string, text string, entities array<struct<entity_type:string,start:int,end:int>>"
DOCUMENTS = "id string, leaves array<struct<key:string,text:string,entities:array<struct<entity_type:string,start:int,end:int>>>>"


def texts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((path, text) of the UTF-8 files below a directory of any file system of Spark's, (path) of those that are not UTF-8).  Line ends stay as they are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    ok = F.expr("is_valid_utf8(content)")
    return files.where(ok).select("path", F.decode("content", "UTF-8").alias("text")), files.where(~ok).select("path")


def local_texts(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((path, text) of the UTF-8 files below a mounted folder, (path) of the others, (path) of what can't be read); links and pipes are left out."""
    rows = directory.contents(directory.entries(spark, root).where(F.col("kind").isin("file", "unreadable")))
    return rows.where("kind = 'text'").select("path", "text"), rows.where("kind = 'not_utf8'").select("path"), rows.where("kind = 'unreadable'").select("path")


def corpus(spark: SparkSession, path: str, schema: str = CORPUS) -> DataFrame:
    """An annotated corpus in JSON lines, with a declared schema."""
    return spark.read.schema(schema).json(path)


def gold(rows: DataFrame) -> DataFrame:
    """(id, lang, entity_type, start, end) of a corpus."""
    return rows.select("id", "lang", F.explode("entities").alias("e")).select("id", "lang", "e.*")


def scan(spark: SparkSession, path: str, show_values: bool = False, local: bool = False, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, totals, skipped) of a directory of texts; values are abbreviated unless asked for.

    local: a mounted folder, whose unreadable entries are counted; else a path that Spark reads.
    """
    good, skipped, *bad = local_texts(spark, path) if local else texts(spark, path)
    found = detection.findings(good, ["path"], **options)
    if not show_values:
        found = found.withColumn("value", detection.displayed("value"))
    counts = [found.agg(F.count("*").alias("findings")), good.agg(F.count("*").alias("files")), skipped.agg(F.count("*").alias("skipped"))]  # one row each
    totals = counts[0].crossJoin(counts[1]).crossJoin(counts[2])
    return found, totals.crossJoin(bad[0].agg(F.count("*").alias("unreadable"))) if bad else totals.withColumn("unreadable", F.lit(0)), skipped


def by_type(found: DataFrame) -> list[tuple[str, int]]:
    """Counts by type, the largest first, then by name.  Only counts come to the driver."""
    return [(r["entity_type"], r["count"]) for r in found.groupBy("entity_type").count().orderBy(F.desc("count"), "entity_type").collect()]


def render(found: DataFrame, totals: DataFrame, ner: tuple[bool, str | None] = (False, "no weights")) -> str:
    """A text report: totals, counts by type, and whether the named-entity layer ran."""
    t = totals.first()
    lines = [f"{t['files']} files, {t['findings']} findings, {t['skipped']} skipped, {t['unreadable']} unreadable"]
    lines += [f"{kind}: {n}" for kind, n in by_type(found)]
    return "\n".join([*lines, f"named-entity layer: {'on' if ner[0] else f'off ({ner[1]})'}"])


def report(found: DataFrame, totals: DataFrame, listed: DataFrame, show_values: bool = False, ner: tuple[bool, str | None] = (False, "no weights")) -> DataFrame:
    """(path, report): a JSON object for each file with its findings in order, and a last row without a path with the summary.

    listed: (path) of the files that were read.  A report of any size is written by the executors; joined, its rows are the report.
    """
    value = "value" if show_values else "masked_value"
    finding = F.struct("start", "end", F.col("entity_type").alias("type"), "confidence", "recognizer", F.col("value").alias(value))
    grouped = found.groupBy("path").agg(F.sort_array(F.collect_list(finding)).alias("findings"))
    none = F.array().cast(grouped.schema["findings"].dataType)
    files = listed.select("path").join(grouped, "path", "left").select("path", F.to_json(F.struct("path", F.coalesce("findings", none).alias("findings"))).alias("report"))
    kinds = dict(by_type(found))
    summary = totals.select(
        F.lit(None).cast("string").alias("path"),
        F.to_json(
            F.struct(F.struct(F.col("files").alias("files_scanned"), F.col("skipped").alias("files_skipped"), F.col("unreadable").alias("files_unreadable"), F.lit(ner[0]).alias("ner"), F.lit(None if ner[0] else ner[1]).alias("ner_off_reason"), F.col("findings").alias("total_findings"), F.from_json(F.lit(json.dumps(kinds)), "map<string,long>").alias("by_type")).alias("summary")),
            {"ignoreNullFields": "false"},
        ).alias("report"),
    )
    return files.unionByName(summary)
