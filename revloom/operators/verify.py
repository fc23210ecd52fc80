"""Comparing two trees, and two histories at all their branches and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revloom.functions import paths
from revloom.operators.shared import materialize
from revloom.operators.trees import stabbed


def compared(left: DataFrame, right: DataFrame, key: str, content: str) -> DataFrame:
    """Files that two trees don't have in common: key and status (left_only, right_only, differs).

    Contents are compared by digest, so they don't travel.
    """
    a = left.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("__a"), F.lit(True).alias("__in_a"))
    b = right.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("__b"), F.lit(True).alias("__in_b"))
    both = a.join(b, key, "full_outer")
    status = F.when(F.col("__in_b").isNull(), "left_only").when(F.col("__in_a").isNull(), "right_only").when(~F.col("__a").eqNullSafe(F.col("__b")), "differs")
    return both.withColumn("status", status).filter(F.col("status").isNotNull()).select(key, "status")


def summary(compared_files: DataFrame) -> DataFrame:
    return compared_files.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


#: Files that a version-control tool keeps for itself, and its folders.
TOOL_FILES, TOOL_FOLDERS = (".cvsignore", ".gitignore"), ("CVS", ".git")


def visible(path: Column, files: tuple[str, ...] = TOOL_FILES, folders: tuple[str, ...] = TOOL_FOLDERS) -> Column:
    """Whether a walk over a tree for comparison meets the file: not if it has one of the
    names or lies in one of the folders."""
    parts = F.split(path, "/")
    return ~(F.element_at(parts, -1).isin(*files) | F.exists(parts, lambda x: x.isin(*folders)))


def changing_folders(left: DataFrame, right: DataFrame) -> DataFrame:
    """folder: those that the two histories don't have alike at all times.

    ``left``, ``right``: path, content, from_t, to_t.  A folder's print is a sum of hashes,
    which a file's coming adds to and its going takes from; it is the difference of the
    two prints that is kept, so that a folder alike at all times has no step at all.
    """

    def steps(rows: DataFrame, sign: int) -> DataFrame:
        mark = F.xxhash64("path", "content").cast("decimal(38,0)")
        rows = rows.select(paths.directory("path").alias("folder"), mark.alias("mark"), "from_t", "to_t")
        return rows.select("folder", F.inline(F.array(F.struct(F.col("from_t").alias("t"), (F.col("mark") * sign).alias("d")), F.struct(F.col("to_t").alias("t"), (F.col("mark") * -sign).alias("d")))))

    both = steps(left, 1).unionByName(steps(right, -1))
    return both.groupBy("folder", "t").agg(F.sum("d").alias("d")).filter("d != 0").select("folder").distinct()


def differing_stretches(left: DataFrame, right: DataFrame) -> DataFrame:
    """path, from_t, to_t, status: when a file is in one history only, or not the same.

    Only files in folders that ever differ are looked at, one by one.
    """
    folders = materialize(changing_folders(left, right))

    def below(rows: DataFrame, side: str) -> DataFrame:
        rows = rows.withColumn("folder", paths.directory("path")).join(folders, "folder", "left_semi")
        come = rows.select("path", F.col("from_t").alias("t"), F.lit(1).alias("is_start"), F.struct(F.col("content").alias("content")).alias(side))
        gone = rows.select("path", F.col("to_t").alias("t"), F.lit(0).alias("is_start"), F.struct(F.lit(None).cast(rows.schema["content"].dataType).alias("content")).alias(side))
        return come.unionByName(gone)

    both = below(left, "a").unionByName(below(right, "b"), allowMissingColumns=True)
    # of what happens at one time the start of a stretch counts, not the end of the one before
    at = both.groupBy("path", "t").agg(F.max_by("a", F.when(F.col("a").isNotNull(), F.col("is_start"))).alias("a"), F.max_by("b", F.when(F.col("b").isNotNull(), F.col("is_start"))).alias("b"))
    file = Window.partitionBy("path").orderBy("t")
    known = at.withColumns({c: F.last(c, ignorenulls=True).over(file) for c in "ab"} | {"to_t": F.lead("t").over(file)})
    a, b = F.col("a.content"), F.col("b.content")
    status = F.when(a.isNull() & b.isNotNull(), "right_only").when(a.isNotNull() & b.isNull(), "left_only").when(a != b, "differs")
    return known.select("path", F.col("t").alias("from_t"), "to_t", status.alias("status")).filter("status is not null and to_t is not null")


def compared_refs(left: DataFrame, right: DataFrame, refs: DataFrame, ignore: tuple[str, ...] = TOOL_FILES) -> DataFrame:
    """ref, path, status: what two histories don't have alike at any of ``refs`` (ref, t), all
    branches and tags at once.  Refs and files without a difference give no rows."""
    seen = [x.filter(visible(F.col("path"), ignore)) for x in (left, right)]
    return stabbed(differing_stretches(*seen), refs).select("ref", "path", "status")
