"""Tags: the sets of revisions they name, and the trees that equal them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(member: Column) -> tuple[Column, Column, Column]:
    """Aggregates that agree for equal sets of distinct members: size and two hash sums.

    Sums and XORs of hashes combine before the shuffle and don't hold the set.
    """
    return F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64(member)).alias("f1"), F.sum(F.xxhash64(F.lit(7), member).cast("decimal(38,0)")).alias("f2")


def set_prints(rows: DataFrame, owner: str, member: str) -> DataFrame:
    return rows.select(owner, member).distinct().groupBy(owner).agg(*fingerprint(F.col(member)))


def matching_trees(tags: DataFrame, trees: DataFrame, tag: str, tree: str, member: str) -> DataFrame:
    """For each tag: n_trees with exactly its members, and the smallest of them (or null)."""
    wanted, held = set_prints(tags, tag, member), set_prints(trees, tree, member)
    by_print = held.groupBy("size", "f1", "f2").agg(F.count(F.lit(1)).alias("n_trees"), F.min(tree).alias("first_tree"))
    found = wanted.join(by_print, ["size", "f1", "f2"], "left")
    return found.select(tag, F.col("size").alias("members"), F.coalesce("n_trees", F.lit(0)).alias("n_trees"), "first_tree")


def normalised_revision(rev: Column) -> Column:
    """The first import equals the revision it was made from."""
    first_import = F.array(*[F.lit(1)] * 4)
    return F.when(rev == first_import, F.slice(rev, 1, 2)).otherwise(rev)
