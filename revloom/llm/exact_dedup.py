"""Exact dedup by skew-safe combining.

Rows are combined three times, each time comparing the whole normalised text and not
only its digest: inside a map task (the partial aggregate), among the rows of one
(digest, salt) group, and among the salt winners of a digest.  A group of copies that
holds a third of all rows thus reaches a reducer as at most one row per map task and
salt.  The winners then go back to their rows by digest, hot digests by a broadcast of
bounded size; texts leave the join unless two different texts really share a digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revloom.llm.common import joined_by_key, materialize, quoted, text_or_empty

#: A lone space needs no replacement; every other white-space run becomes one space.
RUNS_TO_REPLACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text_or_empty(text), RUNS_TO_REPLACE, " ")


def sha256_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest=sha256_digest) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty.  ``keep_id`` is the smallest non-null id among rows with
    equal normalised text (null if all are null).  Rows that repeat an id all carry
    ``kept`` if theirs is the smallest id; ``keep_one`` keeps exactly one row.  An
    empty table gives an empty result; other columns are ignored, whatever their names.

    ``digest`` may be replaced, even by a colliding function: texts that differ are
    never merged, since every stage groups by the text as well.
    """
    rows = docs.select(quoted(id_col).alias("doc_id"), normalised(quoted(text_col)).alias("norm"))
    rows = rows.withColumn("digest", digest(F.col("norm")))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    by_salt = salted.groupBy("digest", "salt", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    winners = by_salt.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    by_digest = winners.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    by_digest = materialize(by_digest)
    clashing = by_digest.filter("texts > 1").select("digest")

    def result(df: DataFrame) -> DataFrame:
        return df.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")

    sha = F.col("digest") if digest is sha256_digest else F.sha2("norm", 256)
    narrow = materialize(rows.select("doc_id", "digest", sha.alias("text_sha256")))
    plain = joined_by_key(narrow, by_digest.filter("texts = 1"), "digest", "group_size")
    if clashing.isEmpty():
        return result(plain)
    exact = winners.join(clashing, "digest", "left_semi")
    told_apart = rows.join(clashing, "digest", "left_semi").withColumn("text_sha256", sha).join(exact, ["digest", "norm"])
    return result(plain).unionByName(result(told_apart))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """The rows of ``docs`` without copies, with all their columns, of any type.

    Of equal texts the row with the smallest id stays (a null id counts as the largest);
    of rows that repeat that id, one, chosen by a hash of what else is in them.  The text is a
    grouping key, so that a hot group is combined before the shuffle; the row's other
    columns travel as one struct.  An empty table gives an empty one.
    """
    rest = [c for c in docs.columns if c != text_col]
    text, norm = quoted(text_col), normalised(quoted(text_col))
    other = F.struct(*[quoted(c).alias(c) for c in rest])
    own = F.when(~text.eqNullSafe(norm), text)  # the text itself is carried only where it differs from the key
    row = F.struct(other.alias("other"), own.alias("text"), text.isNull().alias("empty"))
    place = F.struct(quoted(id_col).isNull().alias("k0"), quoted(id_col).alias("k1"), F.xxhash64(other.cast("string"), own).alias("k2"))
    keyed = docs.select(norm.alias("norm"), F.xxhash64(norm).alias("digest"), F.pmod(F.xxhash64(quoted(id_col)), F.lit(salts)).cast("int").alias("salt"), row.alias("row"), place.alias("place"))
    first = keyed.groupBy("digest", "salt", "norm").agg(F.min_by("row", "place").alias("row"), F.min("place").alias("place"))
    last = first.groupBy("digest", "norm").agg(F.min_by("row", "place").alias("row"))
    back = F.when(~F.col("row.empty"), F.coalesce("row.text", "norm"))
    return last.select(*[(back if c == text_col else F.col("row.other").getField(c)).alias(c) for c in docs.columns])
