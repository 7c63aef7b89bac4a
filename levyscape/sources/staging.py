"""Cut the lineage of a frame that several later passes read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the session names for checkpoints.

    Only a session that runs in this process alone (master local[...]) may name none;
    it gets a temporary folder.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="levyscape-"))
        named = sc.getCheckpointDir()
    return named


def remove_at_end(spark: SparkSession, path: str) -> None:
    """What stands at the path goes when the session's JVM ends."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)


def stage(df: DataFrame) -> DataFrame:
    """Write the frame as Parquet to the shared folder and read it back.

    Later passes read only the columns and rows they need, a lost executor never
    re-runs the joins behind them, and every pass sees the very same floating-point
    sums. The planner knows the size of what was written. The files go when the
    session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def stage_observing(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """The staged frame and aggregates of its rows, taken while they are written.

    No further pass reads the rows. A task that runs twice may count twice: ask for
    extremes and conditions, not for exact counts. A measure of no rows may be missing.
    """
    seen = Observation()
    staged = stage(df.observe(seen, *[c.alias(name) for name, c in measures.items()]))
    return staged, seen.get
