"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six ASCII white-space characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not root:
        root = sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="revloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, into the shared checkpoint folder, and cut its lineage."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def fresh_folder(spark: SparkSession, prefix: str) -> str:
    return f"{shared_root(spark)}/{prefix}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Like ``materialize``, as a compressed table: for many narrow rows."""
    folder = fresh_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


#: Narrow rows that fill a partition.
PARTITION_ROWS = 10_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of up to ``rows`` narrow rows, in no more partitions than these fill.

    A shuffle or checkpoint leaves files by the number of partitions, which many rounds over
    a small table would multiply.  A table that fills its partitions keeps them.
    """
    return df.coalesce(min(max(1, -(-rows // PARTITION_ROWS)), 2**31 - 1))


#: Rows of under 100 bytes that may be broadcast.
MOST_BROADCAST_ROWS = 100_000
#: A key with over one in so many of the rows is hot.
HOT_SHARE = 1000


def joined_by_key(big: DataFrame, small: DataFrame, key: str, size: str, how: str = "inner", rows: int | None = None) -> DataFrame:
    """``big`` with the one row of ``small``, a table of narrow rows (up to ``rows``, if that
    is known), that has its key; ``size`` is how many rows have that key.

    ``small`` is counted, and broadcast whole if it has few rows.  Else the rows of hot keys
    stay where they are: as each key has over a thousandth of the rows, there are under
    HOT_SHARE of them, and their rows of ``small`` are broadcast.  The others are joined by
    a shuffle, none of whose keys then has more than that share.
    """
    small = materialize(small if rows is None else gathered(small, rows))
    n, total = small.agg(F.count(F.lit(1)), F.sum(size)).first()
    if n <= MOST_BROADCAST_ROWS:
        return big.join(F.broadcast(gathered(small, n)), key, how)
    hot, cold = small.filter(F.col(size) * HOT_SHARE > total), small.filter(F.col(size) * HOT_SHARE <= total)
    rest = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return big.join(F.broadcast(hot), key).unionByName(rest)


def salted_join(big: DataFrame, small: DataFrame, key: str, draw: Column, salts: int = 64) -> DataFrame:
    """Left join of ``big``, a materialised table, to the rows of ``small``, one for a key, of
    any width.  The keys with over a thousandth of the rows of ``big`` (under HOT_SHARE of
    them, without their rows) are broadcast, to deal their rows over salts by ``draw``."""
    sizes = big.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = big.count()
    hot = materialize(sizes.filter(F.col("__n") * HOT_SHARE > total).select(key, F.lit(salts).alias("__salts")))

    def dealt(df: DataFrame, salt) -> DataFrame:
        return df.join(F.broadcast(hot), key, "left").withColumn("__salt", salt(F.coalesce("__salts", F.lit(1)))).drop("__salts")

    spread = dealt(big, lambda n: F.pmod(draw, n).cast("int"))
    copied = dealt(small, lambda n: F.explode(F.sequence(F.lit(0), n - 1)))
    return spread.join(copied, [key, "__salt"], "left").drop("__salt")


def quoted(name: str) -> Column:
    """The column of this very name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed_row(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that no helper column clashes with them."""
    return F.struct(*[quoted(c).alias(c) for c in df.columns])


def unpacked_row(df: DataFrame, names: list[str], row: str = "row") -> DataFrame:
    return df.select(*[F.col(row).getField(c).alias(c) for c in names])


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words, as a long; null counts as empty.

    Splitting at white space gives one piece per word, and an empty piece at either
    end of a text that begins or ends with white space.
    """
    text = text_or_empty(text)
    pieces = F.size(F.split(text, SPACE_CLASS + "+", -1))
    edges = F.when(text.rlike("^" + SPACE_CLASS), 1).otherwise(0) + F.when(text.rlike(SPACE_CLASS + r"\z"), 1).otherwise(0)
    return F.when(text == "", 0).otherwise(F.greatest(pieces - edges, F.lit(0))).cast("long")
