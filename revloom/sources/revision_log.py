"""Tables that can be viewed as a revision log.

A revision log has one row per file revision: event_id, t (Unix seconds), path, author,
log, dead, commitid and rn, the revision's number within its path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revloom.operators.ordered import day_of, ranked


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unnumbered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("t"),
        F.concat(F.lit("src/"), "event_type", F.lit("/u"), (F.col("user_id") % 40).cast("string"), F.lit(".c")).alias("path"),
        F.concat(F.lit("a"), (F.col("user_id") % 7).cast("string")).alias("author"),
        F.col("event_type").alias("log"),
        (F.col("event_id") % 10 == 0).alias("dead"),
        F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("commitid"),
    )


def revision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a revision log."""
    rows = unnumbered_log(spark, sf_dir).withColumn("day", day_of("t"))
    return ranked(rows, ["path"], "day", [F.col("t"), F.col("event_id")], "rn").drop("day")
