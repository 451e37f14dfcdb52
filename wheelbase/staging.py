"""Materialising an intermediate table that several later steps read."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wheelbase.session import ensure_checkpoint_dir

PER_FILE, LEAST_FILES = 8_192, 4
# Parts that keys are dealt into, and rows that are worked on together.
SLICES, TOGETHER = 32, 50_000_000
# Spark's setting of how many files a task may write side by side; with fewer than the slices it sorts all rows first.
SIDE_BY_SIDE = "spark.sql.maxConcurrentOutputFileWriters"
# Spark's setting that rows dealt by some columns of a join are dealt anew by all of them.
DEALT_ANEW = "spark.sql.requireAllClusterKeysForCoPartition"
# Spark's setting that removes the shuffle files of an execution at its end.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _tidy(spark: SparkSession, **more: str) -> Iterator[None]:
    settings = {TIDY: "true", **more}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write the frame once to the shared checkpoint folder and go on from the copy.

    The copy survives lost executors and cuts the lineage, so later steps do not redo the scans. The shuffle files behind it go as soon as
    it is written; nothing reads them again. Spark takes that setting when a frame is made, hence the select.
    """
    ensure_checkpoint_dir(df.sparkSession)
    with _tidy(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``checkpointed`` as a Parquet table in that folder, for large tables and for those that a loop makes from the ones before.

    Its columns are packed, where a checkpoint takes the rows as they lie in memory. Spark plans with the size of its files. A checkpoint keeps the size guessed by the plan behind it, and guesses of joins multiply: after a few
    rounds they are numbers of millions of digits, which the driver is busy with. Column names must differ. Where the caller has counted about how many ``rows`` there
    will be, they go into files of some ``PER_FILE``, and at most as many as there are partitions: a small table isn't dealt out over hundreds of tasks.
    """
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, -(-rows // PER_FILE)))
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    with _tidy(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def in_slices(frames: Sequence[DataFrame], key: str, work: Callable[..., DataFrame], together: int = TOGETHER) -> DataFrame:
    """``work(*frames)``, stored, for work that never brings rows of different keys together.

    The frames are written packed and by slices of the keys, then as many slices at a time are worked on as hold about ``together`` rows. So the shuffle files of
    the work lie on disk for these rows only, not for all of them, and those behind the frames are gone by then. Rows are dealt by the key once: joins and
    groups by the key and more columns need no further shuffle. The rows of one key meet in one task.
    """
    spark = frames[0].sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/slices-{uuid.uuid4().hex}"
    rows = 0
    for i, frame in enumerate(frames):
        seen = Observation()
        dealt = frame.withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(SLICES)).cast("int")).observe(seen, F.count(F.lit(1)).alias("n"))
        with _tidy(spark, **{SIDE_BY_SIDE: str(SLICES)}):
            dealt.write.partitionBy("_slice").parquet(f"{folder}/frame-{i}")
        rows += seen.get["n"]
    turns = min(SLICES, max(1, -(-rows // together)))
    schemas = [f"{frame.select(frame.columns)._jdf.schema().toDDL()}, _slice int" for frame in frames]
    for turn in range(turns):
        some = [spark.read.schema(schema).parquet(f"{folder}/frame-{i}").filter(F.col("_slice") % turns == turn).drop("_slice").repartition(key) for i, schema in enumerate(schemas)]
        done = work(*some)
        with _tidy(spark, **{DEALT_ANEW: "false"}):
            done.write.mode("append").parquet(f"{folder}/done")
    for i in range(len(frames)):
        _delete(spark, f"{folder}/frame-{i}")
    return spark.read.schema(done.schema).parquet(f"{folder}/done")
