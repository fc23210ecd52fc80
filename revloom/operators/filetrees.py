"""The branches of single files: chains, names, parents, and where they start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revloom.functions import revnum
from revloom.operators.repair import repaired_dates
from revloom.operators.shared import materialize


def _key_text(key: Column) -> Column:
    return F.array_join(key.cast("array<string>"), ".")


def file_revisions(deltas: DataFrame, symbols: DataFrame) -> DataFrame:
    """Revisions with their branch, parent and repaired date.

    Columns: master_id, fileop_path, rev, key (of the branch, as text), branch, parent_rev,
    parent_t, root (first of its branch), t, author, log, commitid, dead, state.

    A file that only has 1.1 on its trunk goes on along its last import branch.  Import
    branches are named by number; others by their first symbol, or after the nearest named
    branch.  Branches without a name and a live revision are left out.
    """
    rows = deltas.select("master_id", "fileop_path", "rev", "t", "author", "log", "commitid", "dead", "state").withColumn("bkey", revnum.branch_key("rev")).withColumn("key", _key_text(F.col("bkey")))
    rows = materialize(rows)  # flat and without the texts
    vendor = F.coalesce(revnum.is_vendor("rev"), F.lit(False))
    shape = rows.groupBy("master_id").agg(F.count(F.when(F.size("bkey") == 0, 1)).alias("on_trunk"), F.max(F.when(vendor, F.col("bkey"))).alias("import_key"), F.max(F.when(F.size("bkey") == 0, F.col("rev"))).alias("tip"))
    rows = rows.join(shape, "master_id").withColumn("spliced", (F.col("on_trunk") == 1) & F.coalesce(F.col("bkey") == F.col("import_key"), F.lit(False)))
    dates = repaired_dates(rows.select("master_id", "key", "rev", "t"), ["master_id", "key"], "rev").select("master_id", "rev", "repaired")
    rows = rows.join(dates, ["master_id", "rev"]).withColumn("t", F.col("repaired")).drop("repaired")
    chain = Window.partitionBy("master_id", "key").orderBy("rev")
    rows = rows.withColumn("before", F.lag("rev").over(chain)).withColumn("root", F.col("before").isNull() & (F.size("bkey") > 0) & ~F.col("spliced"))
    rows = rows.withColumn("parent_rev", F.coalesce("before", F.when(F.col("spliced"), F.col("tip")).when(F.size("bkey") > 0, revnum.sprout("rev"))))
    rows = materialize(rows)  # read for the names, the revisions and their parents

    magic = symbols.filter(revnum.is_magic("rev")).select("master_id", _key_text(revnum.branch_key("rev")).alias("key"), F.struct("pos", "name").alias("s"))
    names = magic.groupBy("master_id", "key").agg(F.min("s").alias("s")).select("master_id", "key", F.col("s.name").alias("symbol"))
    known = rows.groupBy("master_id", "key", "bkey").agg(F.max("rev").alias("last"), F.max_by("commitid", "rev").alias("last_id"), F.max(F.when(~F.col("dead"), 1)).alias("alive"), F.max("spliced").alias("spliced"), F.max(vendor).alias("vendor"))
    known = known.join(names, ["master_id", "key"], "left")
    fixed = F.when((F.size("bkey") == 0) | F.col("spliced"), "master").when(F.col("vendor"), F.concat(F.lit("import-"), F.col("key"))).otherwise(F.col("symbol"))
    known = known.withColumn("name", fixed)
    tried = known.filter(F.col("name").isNull() & F.col("alive").isNotNull()).select("master_id", "key", "last_id", F.explode(F.slice(revnum.prefixes("bkey"), F.lit(2), F.size(revnum.prefixes("bkey")))).alias("above"))
    above = known.filter(F.col("name").isNotNull()).select("master_id", F.col("bkey").alias("above"), F.col("name").alias("above_name"))
    nearest = tried.join(above, ["master_id", "above"]).groupBy("master_id", "key", "last_id").agg(F.max(F.struct(F.size("above"), F.col("above_name").alias("n"))).alias("a"))
    made = F.concat_ws("-", F.col("a.n"), F.lit("UNNAMED-BRANCH"), F.col("last_id"))
    nearest = nearest.withColumn("made", made).withColumn("again", F.row_number().over(Window.partitionBy("master_id", "made").orderBy("key")))
    nearest = nearest.select("master_id", "key", F.when(F.col("again") > 1, F.concat_ws("-", "made", "key")).otherwise(F.col("made")).alias("made"))
    named = known.join(nearest, ["master_id", "key"], "left").withColumn("branch", F.coalesce("name", "made")).filter(F.col("branch").isNotNull())
    rows = rows.join(named.select("master_id", "key", "branch"), ["master_id", "key"])
    parents = rows.select("master_id", F.col("rev").alias("parent_rev"), F.col("t").alias("parent_t"), F.col("branch").alias("parent_branch"), F.col("dead").alias("parent_dead"))
    rows = rows.join(parents, ["master_id", "parent_rev"], "left")
    rows = rows.withColumn("parent_rev", F.when(F.col("parent_t").isNotNull(), F.col("parent_rev")))
    return rows.select("master_id", "fileop_path", "rev", "key", "branch", "parent_rev", "parent_t", "parent_branch", "parent_dead", "root", "t", "author", "log", "commitid", "dead", "state")


def branch_heads(revisions: DataFrame, symbols: DataFrame) -> DataFrame:
    """(master_id, ref_name, rev, parent_ref, depth, own): each file's entry on each branch.

    ``rev`` is the file's newest revision there or, for a branch without one (``own``
    false), the nearest revision that it grows from.
    """
    own = revisions.groupBy("master_id", F.col("branch").alias("ref_name")).agg(F.max("rev").alias("rev"), F.max("parent_branch").alias("any_parent"), F.max(F.when(F.col("root"), F.col("parent_branch"))).alias("root_parent"))
    own = own.withColumn("depth", F.when(F.col("ref_name") == "master", 0).otherwise(F.greatest(F.floor(F.size("rev") / 2).cast("int") - 1, F.lit(1))))
    own = own.select("master_id", "ref_name", "rev", F.when(F.col("ref_name") != "master", F.coalesce("root_parent", F.lit("master"))).alias("parent_ref"), "depth", F.lit(True).alias("own"))
    magic = symbols.filter(revnum.is_magic("rev")).select("master_id", F.col("name").alias("ref_name"), F.col("rev").alias("number"))
    empty = magic.join(own, ["master_id", "ref_name"], "left_anti")
    steps = F.sequence(F.lit(1), F.greatest(F.floor(F.size("number") / 2).cast("int") - 1, F.lit(1)))
    tried = empty.withColumn("rev", F.explode(F.transform(steps, lambda i: F.slice("number", 1, F.size("number") - 2 * i))))
    found = tried.join(revisions.select("master_id", "rev", "branch"), ["master_id", "rev"])
    best = F.max(F.struct(F.size("rev"), F.col("rev").alias("rev"), F.col("branch").alias("branch")))
    empty = found.groupBy("master_id", "ref_name").agg(best.alias("b"), F.max(F.size("number")).alias("n"))
    empty = empty.select("master_id", "ref_name", F.col("b.rev").alias("rev"), F.col("b.branch").alias("parent_ref"), (F.floor(F.col("n") / 2) - 1).cast("int").alias("depth"), F.lit(False).alias("own"))
    return own.unionByName(empty)


def file_tags(revisions: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, master_id, rev, dead, t) of symbols that aren't branches; unknown numbers drop out."""
    plain = symbols.filter(~revnum.is_magic("rev") & (F.size("rev") % 2 == 0)).select("master_id", "name", "rev")
    return plain.join(revisions.select("master_id", "rev", "dead", "t", "author", "branch", "fileop_path"), ["master_id", "rev"])
