"""Column expressions over master paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rectified(path: Column | str, prefix: Column | str | None = None) -> Column:
    """Drop a leading prefix, Attic/ and RCS/ folders, and the ,v at the end of the name."""
    path = _col(path)
    if prefix is not None:
        prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
        path = F.when(path.startswith(prefix), F.substring(path, F.length(prefix) + 1, F.length(path))).otherwise(path)
    path = F.regexp_replace(path, r"(?<=^|/)(?:Attic|RCS)/", "")
    return F.regexp_replace(path, r"(?<=[^/]),v$", "")


def ignore_renamed(path: Column | str) -> Column:
    """The ignore file gets the name that the target system reads."""
    return F.regexp_replace(_col(path), r"\.cvsignore$", ".gitignore")


def directory(path: Column | str) -> Column:
    """Up to the last slash, or empty."""
    return F.regexp_extract(_col(path), "^(.*)/", 1)


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def ancestors(folder: Column | str) -> Column:
    """The folder and those above it, the deepest first; none for the root."""
    parts = F.split(_col(folder), "/")
    every = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(_col(folder) == "", F.array().cast("array<string>")).otherwise(every)


def absolute(path: Column | str, root: str) -> Column:
    """A path below ``root``, unless it begins at the root of all; ./ in front is dropped."""
    path = _col(path)
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(path, "^([.]/+)+", "")))


def deep_key(path: Column | str) -> Column:
    """Sorts bytewise, but files below a folder come before the files in it."""
    path = _col(path)
    return F.concat(F.regexp_extract(path, "^(.*/)?", 0), F.lit("\U0010ffff"), base_name(path))


def shared_prefix(a: Column, b: Column) -> Column:
    """The folders, with their slashes, that two paths share from the start."""
    x, y = F.split(directory(a), "/"), F.split(directory(b), "/")
    pairs = F.arrays_zip(x.alias("x"), y.alias("y"))
    start = F.struct(F.lit(True).alias("same"), F.lit("").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        same = acc["same"] & p["x"].eqNullSafe(p["y"])
        return F.struct(same.alias("same"), F.when(same, F.concat(acc["out"], p["x"], F.lit("/"))).otherwise(acc["out"]).alias("out"))

    none = (directory(a) == "") | (directory(b) == "")
    return F.when(none, "").otherwise(F.aggregate(pairs, start, step, lambda acc: acc["out"]))


def common_folder(paths: DataFrame, path_col: str = "path", keys: list[str] | None = None) -> DataFrame:
    """``prefix``, the folders that all paths (of each key) share.

    The paths that all others lie between share what all share, so two extremes suffice:
    a combined aggregate instead of a walk over neighbours.
    """
    ends = paths.groupBy(*(keys or [])).agg(F.min(path_col).alias("low"), F.max(path_col).alias("high"))
    return ends.select(*(keys or []), F.coalesce(shared_prefix(F.col("low"), F.col("high")), F.lit("")).alias("prefix"))
