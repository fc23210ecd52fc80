"""Ordered computations over keys of any size.

A window over a whole key puts the key into one task.  These operators cut a key's rows
into buckets along the order (say, days), work inside the buckets, and carry what one
bucket owes the next through a table with one row per key and bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revloom.operators.shared import materialize

DAY = 86_400


def day_of(t: Column | str) -> Column:
    return F.floor((F.col(t) if isinstance(t, str) else t) / DAY)


def _joined(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    table = table.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in table.columns if c not in keys])
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return rows.join(table, condition).drop(*[f"__{k}" for k in keys])


def running(rows: DataFrame, keys: list[str], bucket: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, for each name in ``sums``, the sum of its expression up to and with the row."""
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"__v_{n}": e for n, e in sums.items()})
    totals = rows.groupBy(*keys, bucket).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    before = totals.select(*keys, bucket, *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__b_{n}") for n in sums])
    rows = rows.withColumns({f"__i_{n}": F.sum(f"__v_{n}").over(inside) for n in sums})
    rows = _joined(rows, before, [*keys, bucket])
    return rows.withColumns({n: F.col(f"__b_{n}") + F.col(f"__i_{n}") for n in sums}).drop(*[f"__{x}_{n}" for n in sums for x in "vib"])


def ranked(rows: DataFrame, keys: list[str], bucket: str, order: list[Column], name: str = "rn") -> DataFrame:
    """Adds the row's number, from 1, within its key."""
    return running(rows, keys, bucket, order, {name: F.lit(1).cast("long")})


def numbered(rows: DataFrame, order: list[Column], name: str, keys: list[str] = ()) -> DataFrame:
    """Adds the row's number, from 1, in the order of all rows, or of those of its key.

    Rows are dealt over ranges of the order, so a key of any size is spread.
    """
    cut = materialize(rows.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    return ranked(cut, list(keys), "__part", order, name).drop("__part")


def with_neighbour(rows: DataFrame, keys: list[str], bucket: str, order: list[Column], columns: dict[str, str], following: bool = False) -> DataFrame:
    """Adds columns of the row before (or after) it within its key: {new name: column}.

    ``order`` must tell a key's rows apart.
    """
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(bucket)
    move = F.lead if following else F.lag
    values = F.struct(*columns.values())
    ends = rows.withColumn("__n", F.row_number().over(inside if following else Window.partitionBy(*keys, bucket).orderBy(*[_reversed(o) for o in order]))).filter("__n = 1")
    ends = ends.select(*keys, bucket, move(values).over(across).alias("__far"))
    rows = rows.withColumn("__near", move(values).over(inside))
    rows = _joined(rows, ends, [*keys, bucket])
    found = F.coalesce("__near", "__far")
    return rows.withColumns({n: found[c] for n, c in columns.items()}).drop("__near", "__far")


def _reversed(order: Column) -> Column:
    """Orders are given as plain columns, ascending; the reverse is descending."""
    return order.desc()
