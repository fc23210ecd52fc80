"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its words' worth of whole epochs plus a fraction of one more.  For
the fraction, each document draws an exponential key whose rate is its quality weight;
the documents in key order, prefix-summed, fill what the epochs leave of the budget.

The order is global within a source, but no task sorts a whole source: the keys fall
into buckets of bounded expected size, a window over the bucket totals gives each bucket
its offset, and only the documents inside a bucket are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revloom.llm.common import materialize, packed_row, quoted, text_or_empty, unpacked_row, word_count

#: Weights of the sources in code-point order, repeating.
SOURCE_WEIGHTS = (3.0, 1.0, 2.0)
#: Words wanted, of all words there are, and the most epochs of one source.
SHARE, MOST_EPOCHS = 1.5, 2.0
#: Quality weights lie between this and 1, which bounds a bucket's share of the documents.
LEAST_QUALITY = 0.25
#: Documents meant for one bucket; above so many buckets of a source, buckets and their
#: documents both grow with the root of the source.
BUCKET_ROWS, MANY_BUCKETS = 256, 65536
#: Sources that may be broadcast: at most so many rows of about 100 bytes.
MOST_BROADCAST_ROWS = 20_000
SYMBOLS = r"[#*$%&|<>]+"


def quality_weight(text: Column, words: Column) -> Column:
    """Falls from 1 to LEAST_QUALITY with the symbols in a text per word."""
    text = text_or_empty(text)
    symbols = F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))
    return F.greatest(F.lit(LEAST_QUALITY), 1.0 / (1.0 + 10.0 * symbols / F.greatest(words, F.lit(1))))


def exponential_key(identity: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight, with u in (0, 1) from a hash, so that reruns agree."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), identity), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = SOURCE_WEIGHTS, share: float = SHARE, most_epochs: float = MOST_EPOCHS) -> DataFrame:
    """Targets of the sources (source, source_size, docs), one row per source.

    What a capped source can't take goes to the others by weight, until none is above its
    cap: sources fill up in order of cap per weight, and the rest share one level.  The
    windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most_epochs))).withColumn("full_at", F.col("cap") / F.col("weight"))
    whole, before = Window.partitionBy(), Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(whole) * F.lit(float(share))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / open_weight
    order = F.row_number().over(Window.orderBy("full_at", F.col("source").asc_nulls_last()))
    ranked = ranked.withColumn("level", level).withColumn("order", order)
    first_open = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("order", "level"))).over(whole)
    ranked = ranked.withColumn("level", first_open["level"])
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return ranked.select("source", "source_size", "docs", target.alias("target"))


def with_small(big: DataFrame, small: DataFrame, condition: Column) -> DataFrame:
    """Join to a materialised table, broadcast only if it has few rows when counted."""
    few = small.limit(MOST_BROADCAST_ROWS + 1).count() <= MOST_BROADCAST_ROWS
    return big.join(F.broadcast(small) if few else small, condition)


def keyed_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, *keep: Column) -> DataFrame:
    text = quoted(text_col)
    size = word_count(text)
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(source_col).alias("source"), size.alias("size"), F.xxhash64(text).alias("tie"), quality_weight(text, size).alias("quality"), *keep)
    return rows.withColumn("key", exponential_key(F.struct("doc_id", "tie"), F.col("quality"), seed)).drop("quality")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = SOURCE_WEIGHTS, share: float = SHARE, most_epochs: float = MOST_EPOCHS, seed: int = 17, whole_documents: bool = False) -> DataFrame:
    """doc_id, size, source, source_size, target, epochs, taken, key, tie.

    ``epochs`` are the complete passes over the source, the same for all its documents;
    ``taken`` the words taken in all.  The document at which the fraction's budget ends
    is cut there, or, with ``whole_documents``, taken whole if more than half of it fits.
    A null text has size 0 and takes 0; a null source is one, the last; repeated rows
    and ids take their own share each; an empty table gives an empty result.
    """
    rows = keyed_rows(docs, id_col, text_col, source_col, seed)
    rows = materialize(rows)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    targets = source_targets(sizes, weights, share, most_epochs)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("left_over", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    targets = targets.withColumn("buckets", F.least(F.greatest(F.lit(MANY_BUCKETS), F.ceil(F.sqrt("docs"))), F.ceil(F.col("docs") / BUCKET_ROWS))).drop("docs").withColumnRenamed("source", "target_source")
    placed = with_small(rows, materialize(targets), F.col("source").eqNullSafe(F.col("target_source"))).drop("target_source")
    # the density of documents along this scale is at most 1 / LEAST_QUALITY times its mean
    scale = 1.0 - F.exp(-F.col("key") * LEAST_QUALITY)
    placed = placed.withColumn("bucket", F.least(F.floor(scale * F.col("buckets")), F.col("buckets") - 1).cast("int"))
    in_bucket = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words")).withColumn("offset", F.coalesce(F.sum("words").over(upto), F.lit(0))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "offset")
    placed = placed.withColumn("inside", F.sum("size").over(in_bucket))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    before = F.col("offset") + F.col("inside") - F.col("size")
    room = F.col("left_over") - before
    part = F.greatest(F.lit(0), F.least(F.col("size"), room))
    if whole_documents:
        part = F.when(2 * room > F.col("size"), F.col("size")).otherwise(0)
    return placed.select("doc_id", "size", "source", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "key", "tie")


def mixture_report(docs: DataFrame) -> DataFrame:
    return mixture(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the same columns.

    What the fraction takes of a source is what comes up to one place in its key order, so
    the texts needn't move: each row compares its key with its source's last one.  Rows
    that repeat both id and text share a key and are taken alike.  Null texts and sources,
    repeated rows and empty tables are as in ``mixture``.
    """
    mixed = mixture(docs, id_col, text_col, source_col, seed=seed, whole_documents=True, **options)
    place = F.struct("key", "doc_id", "tie")
    ends = mixed.groupBy("source").agg(F.max("epochs").alias("epochs"), F.max(F.when(F.col("taken") > F.col("epochs") * F.col("size"), place)).alias("last"))
    ends = materialize(ends.select(F.col("source").alias("end_source"), "epochs", "last"))
    rows = keyed_rows(docs, id_col, text_col, source_col, seed, packed_row(docs).alias("row"))
    placed = with_small(rows, ends, F.col("source").eqNullSafe(F.col("end_source")))
    copies = F.col("epochs") + F.when(place <= F.col("last"), 1).otherwise(0)
    repeated = placed.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
    return unpacked_row(repeated, docs.columns)
