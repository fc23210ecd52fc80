"""Chat formatting after the collapse of cumulative snapshots.

Loggers often write a conversation again after every turn.  A rolling hash over the turns
names each prefix of each conversation; a conversation whose whole is a proper prefix of
another, or equals one with a smaller id, is dropped by an anti-join.  What is left is
rendered, in parts of a bounded number of turns.

No task holds a whole conversation: turns are numbered and hashed within blocks of
consecutive turn numbers, and blocks are chained by their counts and hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revloom.llm.common import materialize

#: Consecutive turn numbers in a block, and turns in a rendered part.
BLOCK, PART = 1024, 256
TEMPLATE = "<|{role}|>\n{text}<|end|>\n"


def lane(n: int, position: Column) -> Column:
    """One of two 64-bit terms of a turn at a position; the terms of a prefix are XORed."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(n)), position.cast("string"), F.col("content")), 256)
    return F.xxhash64(F.lit(n), digest)


def numbered_turns(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, position (from 0), role, text, h1, h2: the rolling hash up to the turn.

    Order is by turn number (null first), then role and text; exact repeats of a row
    count once.
    """
    rows = turns.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role"), F.col("text")).distinct()
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(2**62))))
    rows = rows.withColumn("content", F.to_json(F.struct("role", "text")))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto_here = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = rows.withColumn("rank", F.row_number().over(inside)).join(counts.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "first"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b")
    placed = placed.withColumn("position", F.col("first") + F.col("rank") - 1)
    placed = placed.withColumn("t1", lane(1, F.col("position"))).withColumn("t2", lane(2, F.col("position")))
    sums = placed.groupBy("conv_id", "block").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"))
    chained = sums.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), *[F.coalesce(F.bit_xor(f"x{i}").over(before), F.lit(0)).alias(f"o{i}") for i in (1, 2)])
    rolled = placed.withColumn("r1", F.bit_xor("t1").over(upto_here)).withColumn("r2", F.bit_xor("t2").over(upto_here))
    rolled = rolled.join(chained, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    return rolled.select("conv_id", "position", "role", "text", F.col("o1").bitwiseXOR(F.col("r1")).alias("h1"), F.col("o2").bitwiseXOR(F.col("r2")).alias("h2"))


def maximal_conversations(numbered: DataFrame) -> DataFrame:
    """conv_id, n_turns, h1, h2 of the conversations that are no prefix of another."""
    last = F.max(F.struct("position", "h1", "h2"))
    whole = numbered.groupBy("conv_id").agg(last.alias("last")).select("conv_id", (F.col("last.position") + 1).alias("n_turns"), F.col("last.h1").alias("h1"), F.col("last.h2").alias("h2"))
    whole = whole.groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    tops = numbered.groupBy("conv_id").agg(F.max("position").alias("top")).withColumnRenamed("conv_id", "c")
    prefixes = numbered.join(tops, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("position") < F.col("top")))
    prefixes = prefixes.select((F.col("position") + 1).alias("n_turns"), "h1", "h2").distinct()
    return whole.join(prefixes, ["n_turns", "h1", "h2"], "left_anti")


def rendered_turn(template: str = TEMPLATE) -> Column:
    head, _, rest = template.partition("{role}")
    middle, _, tail = rest.partition("{text}")
    return F.concat(F.lit(head), F.coalesce("role", F.lit("unknown")), F.lit(middle), F.coalesce("text", F.lit("")), F.lit(tail))


def chat_format(turns: DataFrame, template: str = TEMPLATE, part: int = PART, block: int = BLOCK) -> DataFrame:
    """conv_id, part, n_turns, rendered: the maximal conversations as text.

    ``part`` numbers pieces of ``PART`` turns each, to be joined in order; ``n_turns``
    counts the whole conversation.  Of equal conversations the smallest id stays.  Rows
    with a null id form one conversation; a null role is ``unknown``, a null text empty.
    Repeated rows count once; an empty table gives an empty result.
    """
    numbered = materialize(numbered_turns(turns, block))
    kept = maximal_conversations(numbered).select(F.col("conv_id").alias("c"), "n_turns")
    rows = numbered.join(kept, F.col("conv_id").eqNullSafe(F.col("c"))).withColumn("part", F.floor(F.col("position") / part))
    pieces = rows.groupBy("conv_id", "part", "n_turns").agg(F.array_sort(F.collect_list(F.struct("position", rendered_turn(template).alias("turn_text")))).alias("all"))
    return pieces.select("conv_id", "part", "n_turns", F.array_join(F.transform("all", lambda x: x["turn_text"]), "").alias("rendered"))
