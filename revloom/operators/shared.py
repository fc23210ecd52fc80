"""Cutting lineage, and what passes between Spark and its Python workers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows of what a worker gives out at a time.
BATCH, BATCH_ROWS = 1 << 22, 5_000


def framed(rows: Iterable[tuple[int, tuple]], columns: list[str]) -> Iterator[pd.DataFrame]:
    """``rows``, each behind its size in bytes, as tables of bounded size.

    A batch that comes in is bounded by Spark; what is made of it may be many times as large.
    """
    out, size = [], 0
    for n, row in rows:
        out.append(row)
        size += n
        if size >= BATCH or len(out) >= BATCH_ROWS:
            yield pd.DataFrame(out, columns=columns)
            out, size = [], 0
    if out:
        yield pd.DataFrame(out, columns=columns)


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Only a local session without that setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="revloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, into a table in the shared folder.

    A checkpoint would run the last stage twice, once to compute and once to write it, and is
    read whole, by rows.
    """
    folder = f"{shared_root(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with those of equal keys in one partition, for a step that takes partitions as
    they are.

    A repartition by the very keys of a join below it is left out as needless, and adaptive
    execution may then read that join's rows where they lie, with a key in several tasks.
    So rows are dealt by a hash of the keys, which no join is by.
    """
    return rows.repartition(F.xxhash64(*keys))
