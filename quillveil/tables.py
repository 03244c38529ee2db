"""Tables in the folder that the cluster shares, to cut lineage, to read a costly result twice and to survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset, a temporary folder that is then set, but on one machine only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="quillveil-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def place(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{folder(spark)}/quillveil-{uuid.uuid4().hex}"


#: Tables that were written since the innermost call of alone() began.
_passing: ContextVar[list[str] | None] = ContextVar("_passing", default=None)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _without_leftovers(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files: it is on disk, so nothing reads them again."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def write(df: DataFrame) -> str:
    """df as a new Parquet table in the shared folder; its path."""
    path = place(df.sparkSession)
    with _without_leftovers(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    if (passing := _passing.get()) is not None:
        passing.append(path)
    return path


def delete(spark: SparkSession, *paths: str | None) -> None:
    """Tables that nothing reads any more."""
    for path in filter(None, paths):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def alone(spark: SparkSession, build: Callable[[], DataFrame]) -> str:
    """The path of the table that build describes; what build wrote on the way is deleted once that table is there."""
    passing: list[str] = []
    token = _passing.set(passing)
    try:
        path = write(build())
    finally:
        _passing.reset(token)
    delete(spark, *[p for p in passing if p != path])
    if (outer := _passing.get()) is not None:
        outer.append(path)
    return path


def collected(df: DataFrame) -> pa.Table:
    """The rows of a small result."""
    path = write(df)
    rows = df.sparkSession.read.parquet(path).toArrow()
    delete(df.sparkSession, path)
    return rows


def table(df: DataFrame) -> DataFrame:
    """df written and read again: later steps depend on the files alone."""
    return df.sparkSession.read.parquet(write(df))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """The condition that all keys are equal, nulls included."""
    on = F.lit(True)
    for k in keys:
        on &= left[k].eqNullSafe(right[k])
    return on


def matching(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right where all keys are equal, nulls included; the keys appear once, and both may come from one table."""
    renamed = right.select(*[F.col(f"`{k}`").alias(f"__right{i}") for i, k in enumerate(keys)], *[F.col(f"`{c}`") for c in right.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on &= F.col(f"`{k}`").eqNullSafe(F.col(f"__right{i}"))
    return left.join(renamed, on, how).drop(*[f"__right{i}" for i in range(len(keys))])


#: Tasks for each core that work is dealt to before tasks grow.
TASKS_A_CORE = 4


def spread(df: DataFrame, work: Column, most: int, streamed: int | None = None) -> DataFrame:
    """df's rows dealt evenly to as many tasks as hold about most of their summed work each; for narrow rows of which wide or costly ones are made.

    streamed: where there are more tasks than TASKS_A_CORE for each core, they hold up to so much instead, for work that no task holds at once.
    """
    total = df.agg(F.sum(work.cast("double"))).first()[0] or 0
    if streamed:
        most = min(max(most, -int(-total // (TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism))), streamed)
    return df.repartition(max(1, -int(-total // most)))
