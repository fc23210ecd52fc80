"""The orders of the model that aren't the natural one of their columns, as sort keys.

A key is one column (bytes, or a struct of plain columns) that ascends in the wanted order,
so rows can be dealt over ranges of it and no task sorts a whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revloom.functions import revnum
from revloom.operators.ordered import numbered


def _hex(n: Column) -> Column:
    return F.lpad(F.hex(n), 8, "0")


def component_key(rev: Column) -> Column:
    """Bytes that sort as the components do, a number before those that it begins."""
    return F.unhex(F.array_join(F.transform(rev, lambda x: _hex(x + 1)), ""))


def node_key(rev: Column) -> Column:
    """Bytes that sort by the number of components, then by the components: all of the trunk
    before all of its branches, and those before theirs."""
    return F.concat(F.unhex(_hex(F.size(rev))), component_key(rev))


def head_key(name: Column, number: Column) -> Column:
    """Branch heads of a file: those that no symbol names come first, the others by its number."""
    known = name.isNotNull() & number.isNotNull()
    return F.when(known, F.concat(F.unhex(F.lit("01")), component_key(number))).otherwise(F.unhex(F.lit("00")))


def join_key(t: Column, tailed: Column) -> Column:
    """Entries of several files where a branch begins: without a revision last, those on a
    tail that other branches share next, the newest first."""
    return F.struct(t.isNull().alias("missing"), F.coalesce(tailed, F.lit(False)).alias("tailed"), (-t).alias("newest"))


def placed_heads(heads: DataFrame, symbols: DataFrame) -> DataFrame:
    """``heads`` (master_id, ref_name) with ``number``, their symbol's, and ``place`` in
    their file's order, from 1; those alike go by name.  Of a symbol given twice the first
    counts."""
    named = symbols.filter(revnum.is_magic("rev") | (F.size("rev") % 2 == 1)).select("master_id", F.col("name").alias("ref_name"), F.col("rev").alias("number"))
    rows = heads.join(named, ["master_id", "ref_name"], "left")
    return numbered(rows.withColumn("__key", head_key(F.col("ref_name"), F.col("number"))), [F.col("__key"), F.col("ref_name")], "place", ["master_id"]).drop("__key")
