"""File trees over time as intervals.

A revision stands in the trees from its own position up to the next revision of its file.
No tree is stored; what a tree holds, and what changes between two, are range filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revloom.operators.branches import as_of_backward
from revloom.operators.ordered import day_of, numbered, running, with_neighbour
from revloom.operators.shared import materialize

FOREVER = 2**62


def tree_intervals(rows: DataFrame, order: str = "event_id") -> DataFrame:
    """path, rn, from_t, to_t (exclusive; FOREVER at the end) of live revisions."""
    rows = rows.withColumn("__day", day_of("t"))
    rows = with_neighbour(rows, ["path"], "__day", [F.col("t"), F.col(order)], {"__next": "t"}, following=True)
    live = rows.filter(~F.col("dead"))
    return live.select("path", "rn", order, F.col("t").alias("from_t"), F.coalesce("__next", F.lit(FOREVER)).alias("to_t")).filter("from_t < to_t")


def tree_at(intervals: DataFrame, at: Column) -> DataFrame:
    return intervals.filter((F.col("from_t") <= at) & (at < F.col("to_t")))


def latest_at(rows: DataFrame, at: Column | int, order: str = "event_id") -> DataFrame:
    """Each file's newest revision up to a time, if it is live: a combined aggregate."""
    at = F.lit(at) if isinstance(at, int) else at
    newest = F.max(F.struct("t", order, "rn", "dead")).alias("newest")
    found = rows.filter(F.col("t") <= at).groupBy("path").agg(newest)
    return found.filter(~F.col("newest.dead")).select("path", F.col(f"newest.{order}").alias(order), F.col("newest.rn").alias("rn"))


def stabbed(stretches: DataFrame, refs: DataFrame) -> DataFrame:
    """Each stretch (from_t, to_t exclusive) with each of ``refs`` (ref, t) that lies in it.

    Refs are numbered in order of time, so a stretch's are a run of numbers: two as-of
    lookups and an equal join, however many refs there are.
    """
    numbers = materialize(numbered(refs.select("ref", "t"), [F.col("t"), F.col("ref")], "rank"))
    rows = materialize(stretches.withColumn("__id", F.monotonically_increasing_id()))
    known = numbers.select(F.lit(0).alias("all"), "t", F.col("rank").alias("__id"), F.col("rank").alias("before"))

    def refs_before(column: str, name: str) -> DataFrame:
        asked = rows.select(F.lit(0).alias("all"), (F.col(column) - 1).alias("t"), "__id")
        return as_of_backward(asked, known, ["all"], ["before"], "__id").select("__id", F.coalesce("before", F.lit(0).cast("long")).alias(name))

    run = rows.join(refs_before("from_t", "low"), "__id").join(refs_before("to_t", "high"), "__id").filter("low < high")
    return run.withColumn("rank", F.explode(F.sequence(F.col("low") + 1, F.col("high")))).join(numbers.select("rank", "ref"), "rank").drop("rank", "low", "high", "__id")


def trees_at(rows: DataFrame, instants: DataFrame, order: str = "event_id") -> DataFrame:
    """The trees at several times: (instant, path, rn) for ``instants`` (instant)."""
    stretches = tree_intervals(rows, order).select("path", "rn", "from_t", "to_t")
    found = stabbed(stretches, instants.select(F.col("instant").alias("ref"), F.col("instant").alias("t")))
    return found.select(F.col("ref").alias("instant"), "path", "rn")


def file_operations(rows: DataFrame, order: str = "event_id") -> DataFrame:
    """What each revision does to its file: M (new or changed) or D; nothing if it was
    dead already.  Columns: order, t, path, rn, op."""
    rows = rows.withColumn("__day", day_of("t"))
    rows = with_neighbour(rows, ["path"], "__day", [F.col("t"), F.col(order)], {"__was_dead": "dead"})
    op = F.when(~F.col("dead"), "M").when(~F.coalesce("__was_dead", F.lit(True)), "D")
    return rows.withColumn("op", op).filter(F.col("op").isNotNull()).select(order, "t", "path", "rn", "op")


def tree_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, old_rn, new_rn, change (added, removed or changed) between two trees."""
    both = old.select("path", F.col("rn").alias("old_rn")).join(new.select("path", F.col("rn").alias("new_rn")), "path", "full_outer")
    change = F.when(F.col("old_rn").isNull(), "added").when(F.col("new_rn").isNull(), "removed").when(F.col("old_rn") != F.col("new_rn"), "changed")
    return both.withColumn("change", change).filter(F.col("change").isNotNull())


def files_per_tree(intervals: DataFrame) -> DataFrame:
    """t, files: how many files the tree holds after each time at which it changes."""
    steps = intervals.select(F.col("from_t").alias("t"), F.lit(1).cast("long").alias("step"))
    steps = steps.unionByName(intervals.filter(F.col("to_t") < FOREVER).select(F.col("to_t").alias("t"), F.lit(-1).cast("long").alias("step")))
    steps = steps.groupBy("t").agg(F.sum("step").alias("step")).withColumn("day", day_of("t")).withColumn("all", F.lit(0))
    return running(steps, ["all"], "day", [F.col("t")], {"files": F.col("step")}).select("t", "files")
