"""Trees of any depth by doubling: a row per node, and as many rounds as the depth has bits.

A node's pointer leads twice as far in every round.  What is gathered on the way up covers
the nodes that the pointer has passed; what is gathered from below covers the descendants
that are nearer than the pointer's length.  No table of all ancestors is made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revloom.operators.shared import materialize


class BranchCycle(ValueError):
    """Nodes that are each other's ancestors."""


Fold = Callable[[Column, Column], Column]


def _linked(nodes: DataFrame) -> tuple[DataFrame, int]:
    """``nodes`` with their pointer, null for roots and where the parent isn't a node; how many."""
    nodes = materialize(nodes)  # read three times
    known = nodes.select(F.col("node").alias("__up"))
    lost = nodes.filter(F.col("parent").isNotNull()).select(F.col("parent").alias("__up")).distinct().join(known, "__up", "left_anti").withColumn("__lost", F.lit(True))
    linked = nodes.withColumnRenamed("parent", "__up").join(lost, "__up", "left")
    linked = materialize(linked.withColumn("__up", F.when(F.col("__lost").isNull(), F.col("__up"))).drop("__lost"))
    return linked, linked.count()


def climbed(nodes: DataFrame, folds: dict[str, tuple[Column, Fold]]) -> DataFrame:
    """node and, for each name, a value folded over the path from the node to its root.

    ``nodes``: node, parent (null at a root) and other columns.  A fold is a node's own value
    and how the values of a nearer and a farther piece of path become one.
    """
    return _climbed(*_linked(nodes.select("node", "parent", *[v.alias(k) for k, (v, _) in folds.items()])), {k: f for k, (_, f) in folds.items()})


def _climbed(rows: DataFrame, n: int, folds: dict[str, Fold]) -> DataFrame:
    """``climbed`` for rows of ``_linked``, or some of them whose pointers stay among them; n
    bounds their number."""
    done, active = rows.filter("__up is null"), rows.filter("__up is not null")
    finished = done.drop("__up")
    for _ in range(n.bit_length() + 1):
        if active.isEmpty():
            return finished
        far = done.unionByName(active).select(F.col("node").alias("__up"), F.col("__up").alias("__next"), *[F.col(k).alias(f"__{k}") for k in folds])
        moved = active.join(far, "__up").select("node", F.col("__next").alias("__up"), *[f(F.col(k), F.col(f"__{k}")).alias(k) for k, f in folds.items()])
        moved = materialize(moved)
        # whatever has got to a root is looked up no more than by its own number
        done, active = done.unionByName(moved.filter("__up is null")), moved.filter("__up is not null")
        finished = done.drop("__up")
    raise BranchCycle("the branch tree has a cycle")


def gathered_below(nodes: DataFrame, values: dict[str, tuple[Column, Callable[[Column | str], Column], Fold]]) -> DataFrame:
    """node and, for each name, a value over the node and all its descendants.

    A value is a node's own one, the aggregate (say, F.sum) and the same for two columns.
    Every descendant is counted once: those at a distance under the pointer's length are in
    a node's value already, and the others below a node at just that distance.
    """
    rows, n = _linked(nodes.select("node", "parent", *[v.alias(k) for k, (v, _, _) in values.items()]))
    for _ in range(n.bit_length() + 1):
        active = rows.filter("__up is not null")
        if active.isEmpty():
            return rows.drop("__up")
        given = active.groupBy(F.col("__up").alias("node")).agg(*[a(k).alias(f"__{k}") for k, (_, a, _) in values.items()])
        merged = rows.join(given, "node", "left").withColumns({k: F.when(F.col(f"__{k}").isNull(), F.col(k)).when(F.col(k).isNull(), F.col(f"__{k}")).otherwise(f(F.col(k), F.col(f"__{k}"))) for k, (_, _, f) in values.items()}).drop(*[f"__{k}" for k in values])
        far = rows.select(F.col("node").alias("__up"), F.col("__up").alias("__next"))
        rows = materialize(merged.join(far, "__up", "left").drop("__up").withColumnRenamed("__next", "__up"))
    raise BranchCycle("the branch tree has a cycle")


def add(near: Column, far: Column) -> Column:
    return near + far


def depths(parents: DataFrame) -> DataFrame:
    """(node, depth), 0 at a root: parents come before their children in this order."""
    counted = climbed(parents, {"depth": (F.lit(1).cast("long"), add)})
    return counted.withColumn("depth", F.col("depth") - 1)


def path_names(parents: DataFrame, name: Column, separator: str = " > ") -> DataFrame:
    """(node, label): the names on the way from the root to the node."""
    return climbed(parents, {"label": (name, lambda near, far: F.concat(far, F.lit(separator), near))})


#: One node of so many is a station.
SPACING = 16


def first_of_history(parents: DataFrame, value: Column) -> DataFrame:
    """(node, first): the value at the node's root.

    All nodes climb to the next station, picked by a hash, or to their root if that is nearer;
    only the stations, a few of all nodes, climb on from one to the next.  So most nodes are
    in as many rounds as stations are apart by, however deep the tree is.
    """
    far = {"top": lambda near, far: far}
    nodes, n = _linked(parents.select("node", "parent", value.alias("first")))
    station = F.col("__up").isNotNull() & (F.pmod(F.xxhash64("node"), F.lit(SPACING)) == 0)
    cut = nodes.select("node", F.when(~station, F.col("__up")).alias("__up"), F.col("node").alias("top"))
    near = materialize(_climbed(cut, n, far).select("node", "top"))
    # where the stations' parents lead to; stops are stations and roots, which lead nowhere
    leads = near.select(F.col("node").alias("__up"), F.col("top").alias("__stop"))
    stations = nodes.filter(station).select("node", "__up").join(leads, "__up").select("node", F.col("__stop").alias("__up"), F.col("node").alias("top"))
    roots = nodes.filter("__up is null")
    stops = materialize(stations.unionByName(roots.select("node", "__up", F.col("node").alias("top"))))
    tops = _climbed(stops, n, far).select(F.col("node").alias("top"), F.col("top").alias("__root"))
    tops = tops.join(roots.select(F.col("node").alias("__root"), "first"), "__root").select("top", "first")
    return near.join(tops, "top").select("node", "first")


def reference_counts(parents: DataFrame, heads: DataFrame) -> DataFrame:
    """For each node that a head reaches: (node, refs, owner), ``owner`` the smallest head,
    on whose branch it counts first.

    ``heads``: head and, if its order isn't its own, ``place``.
    """
    order = F.col("place") if "place" in heads.columns else F.col("head")
    mine = heads.groupBy(F.col("head").alias("node")).agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct(order.alias("place"), F.col("head").alias("head"))).alias("__o"))
    nodes = parents.select("node", "parent").join(mine, "node", "left")
    least = lambda near, far: F.least(near, far)
    found = gathered_below(nodes, {"refs": (F.coalesce("__n", F.lit(0).cast("long")), F.sum, add), "owner": (F.col("__o"), F.min, least)})
    return found.filter("refs > 0").select("node", "refs", F.col("owner.head").alias("owner"))


def tail_bits(parents: DataFrame, heads: DataFrame) -> DataFrame:
    """(node, owner, tail) of nodes that a head reaches: with the tail bit a walk down the
    owner's branch ends, as the next node is an earlier branch's."""
    owned = materialize(reference_counts(parents, heads).select("node", "owner"))
    above = owned.select(F.col("node").alias("parent"), F.col("owner").alias("__above"))
    linked = owned.join(parents.select("node", "parent"), "node").join(above, "parent", "left")
    return linked.select("node", "owner", F.coalesce(F.col("__above") != F.col("owner"), F.lit(False)).alias("tail"))


def ordered_commits(commits: DataFrame) -> DataFrame:
    """(node, rank) in a total order of commits: by date; ties by author and log, and where
    these agree by the parents in the same way; a parent stands before its child in any case.

    ``commits``: node, parent, t, author, log.  A commit that shares its date with its
    parent comes as many steps after the first such one as it has ancestors of that date.
    Ranks are refined by those of ancestors at twice the distance in every round, until no
    tie is left that its ancestors could settle.  Equal commits share a rank.
    """
    commits = materialize(commits.select("node", "parent", "t", "author", "log"))
    # steps through ancestors of the same date: chains cut where the date changes
    dates = commits.select(F.col("node").alias("parent"), F.col("t").alias("__pt"))
    cut = commits.join(dates, "parent", "left").select("node", F.when(F.col("__pt") == F.col("t"), F.col("parent")).alias("parent"))
    step = depths(cut).withColumnRenamed("depth", "step")
    keyed = commits.join(step, "node").withColumn("key", F.struct("t", "step", "author", "log"))
    rows, n = _linked(keyed.select("node", "parent", "key"))
    rows = materialize(dense_ranks(rows, "key"))
    for _ in range(n.bit_length() + 1):
        if rows.filter("__up is not null").isEmpty():
            break
        before = rows.agg(F.max("rank")).first()[0]
        far = rows.select(F.col("node").alias("__up"), F.col("__up").alias("__next"), F.col("rank").alias("__far"))
        pairs = rows.join(far, "__up", "left").select("node", F.col("__next").alias("__up"), F.struct("rank", F.coalesce("__far", F.lit(-1).cast("long"))).alias("key"))
        rows = materialize(dense_ranks(pairs, "key"))
        if rows.agg(F.max("rank")).first()[0] in (before, n - 1):
            break
    return rows.select("node", "rank")


def dense_ranks(rows: DataFrame, key: str) -> DataFrame:
    """Adds rank, from 0, equal for equal keys, which are numbered over ranges of their order."""
    from revloom.operators.ordered import numbered

    places = numbered(rows.select(key).distinct(), [F.col(key)], "rank").select(F.col(key).alias("__key"), (F.col("rank") - 1).alias("rank"))
    return rows.join(places, F.col(key) == F.col("__key")).drop("__key", key)
