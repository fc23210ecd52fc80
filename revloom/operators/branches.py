"""Branch points and parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revloom.functions import revnum
from revloom.operators.ordered import day_of


def as_of_backward(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], order: str = "event_id") -> DataFrame:
    """``left`` with the ``values`` of the newest row of ``right`` not later, or nulls.

    Both have the keys, t and ``order``; ties in time go to the larger ``order``.  Each key's
    days are windows of their own; a day hands its last row on to the next.
    """
    value = F.struct(*values)
    none = F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType)
    columns = [c for c in left.columns]
    both = left.select(*columns, none.alias("__v"), F.lit(1).alias("__side"))
    extra = [F.lit(None).cast(left.schema[c].dataType).alias(c) if c not in {*keys, "t", order} else F.col(c) for c in columns]
    both = both.unionByName(right.withColumn("__v", value).select(*extra, "__v", F.lit(0).alias("__side"))).withColumn("__day", day_of("t"))
    inside = Window.partitionBy(*keys, "__day").orderBy("t", "__side", order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    days = both.groupBy(*keys, "__day").agg(F.max(F.when(F.col("__side") == 0, F.struct("t", order, "__v"))).alias("__last"))
    earlier = Window.partitionBy(*keys).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*keys, "__day", F.last("__last", ignorenulls=True).over(earlier).alias("__carried"))
    found = both.withColumn("__near", F.last("__v", ignorenulls=True).over(inside)).filter("__side = 1").join(days, [*keys, "__day"])
    found = found.withColumn("__found", F.coalesce("__near", F.col("__carried.__v")))
    return found.select(*columns, *[F.col(f"__found.{v}").alias(v if v not in columns else f"found_{v}") for v in values])


def newest_match(left: DataFrame, right: DataFrame, keys: list[str], window: int, left_id: str, right_id: str, others: bool = False) -> DataFrame:
    """For each row of ``left`` the newest row of ``right`` with the same keys and a time
    closer than ``window``.  ``others``: not the row of the same id, where both sides are one
    table.

    A sliding frame over both, in stretches of 64 windows: a row of ``right`` near the end of
    one stands in the next as well, so nothing is paired.
    """
    stretch = 64 * window
    found = F.struct(F.col("t").alias("t"), F.col(right_id).alias("id"))
    shares = F.array_distinct(F.transform(F.array(F.lit(1 - window), F.lit(0), F.lit(window - 1)), lambda d: F.floor((F.col("t") + d) / stretch)))
    near = right.select(*keys, "t", F.explode(shares).alias("__b"), found.alias("__found"), F.lit(None).cast(dict(left.dtypes)[left_id]).alias("__id"))
    asked = left.select(*keys, "t", F.floor(F.col("t") / stretch).alias("__b"), F.lit(None).cast(near.schema["__found"].dataType).alias("__found"), F.col(left_id).alias("__id"))
    both = near.unionByName(asked)
    frame = Window.partitionBy(*keys, "__b").orderBy("t").rangeBetween(1 - window, window - 1)
    rows = both.withColumn("__best", F.max("__found").over(frame))
    if others:
        # the newest may be the row itself: then it is the one before it, if that is near enough
        order = Window.partitionBy(*keys, "__b").orderBy("t", F.coalesce("__found.id", "__id"), F.col("__found").isNull()).rowsBetween(Window.unboundedPreceding, -2)
        rows = rows.withColumn("__before", F.last("__found", ignorenulls=True).over(order)).withColumn("__own", F.col("__best.id") == F.col("__id"))
        before = F.when(F.col("t") - F.col("__before.t") < window, F.col("__before"))
        rows = rows.withColumn("__best", F.when(F.col("__own"), before).otherwise(F.col("__best")))
    return rows.filter(F.col("__id").isNotNull() & F.col("__best").isNotNull()).select(F.col("__id").alias(left_id), F.col("__best.t").alias("found_t"), F.col("__best.id").alias("found_id"))


def deepest_branch(numbers: DataFrame, heads: DataFrame) -> DataFrame:
    """Each number's branch or the nearest one it nests in: (key, head).

    ``numbers`` has key, ``heads`` has head, both branch keys: an equi-join on all
    prefixes keeps the longest.
    """
    tried = numbers.select("key").distinct().withColumn("head", F.explode(revnum.prefixes("key")))
    found = tried.join(heads.select("head").distinct(), "head")
    best = F.max(F.struct(F.size("head").alias("n"), F.col("head").alias("head")))
    return found.groupBy("key").agg(best.alias("best")).select("key", F.col("best.head").alias("head"))


def parents_over_masters(heads: DataFrame) -> DataFrame:
    """Over all masters, each branch's parent: the one named by most masters' deepest entry.

    ``heads``: ref_name, parent_ref, depth.  Returns ref_name, parent_ref.
    """
    best = F.max(F.struct("depth", F.col("parent_ref")))
    return heads.groupBy("ref_name").agg(best.alias("b")).select("ref_name", F.col("b.parent_ref").alias("parent_ref"))
