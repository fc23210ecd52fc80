"""Near-duplicate classes by DartMinHash and banding.

A document is a weighted set: its five-word shingles, each weighing as often as it stands
in the text.  Each element owns a region as wide as its weight.  Hashed darts fall into
the regions, each with a rank and a coordinate; of the darts up to a rank that leaves no
coordinate empty, the earliest of each coordinate is the signature.  Two documents agree
in a coordinate with the probability of their weighted Jaccard similarity (the sum of the
smaller weights over that of the larger ones), and the number of darts doesn't grow with
the document.

Documents that agree in all rows of a band meet in a bucket.  In each bucket a leader is
drawn, the texts of other components meet it, and every link rests on the weighted
Jaccard similarity of the two texts themselves.  Classes are the connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revloom.llm.common import MOST_BROADCAST_ROWS, gathered, joined_by_key, materialize, packed_row, quoted, text_or_empty, unpacked_row, written
from revloom.llm.shingles import ODD, batches_of, mix, run_hashes, texts_hashes

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 36, 7
COORDINATES = BANDS * ROWS
#: Texts of a bucket that are compared inside one task.
BUCKET_PART = 2048
#: Leaders that a text meets in a round; rounds go on while the rows in open buckets fall to
#: this share or below.
LEADERS, GOING_ON = 4, 0.95
#: Parts of the largest family of texts in which all meet.
FAMILY_PARTS = 4


def weighted_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(cells, index of the text of each): a text's shingles, a cell for each time one
    stands there.

    A shingle of weight w owns the cells (shingle, 0) to (shingle, w - 1).  Of a text under
    five words all words are the one shingle.  Cells are sorted within a text.
    """
    hashes = texts_hashes(texts)
    sizes = np.array([len(h) for h in hashes], dtype=np.int64)
    flat = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    of = np.repeat(np.arange(len(texts)), sizes)
    runs = run_hashes(flat, SHINGLE)
    inside = of[: len(runs)] == of[len(flat) - len(runs) :]
    short = np.flatnonzero(sizes < SHINGLE)
    whole = [run_hashes(hashes[i], len(hashes[i]))[0] if len(hashes[i]) else np.uint64(1) for i in short]
    runs, of = np.concatenate([runs[inside], np.array(whole, dtype=np.uint64)]), np.concatenate([of[: len(runs)][inside], short])
    order = np.lexsort((runs, of))
    runs, of = runs[order], of[order]
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (runs[1:] != runs[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    time = np.arange(len(runs)) - np.repeat(first, np.diff(first, append=len(runs)))
    cells = mix(runs + time.astype(np.uint64) * np.uint64(ODD))
    order = np.lexsort((cells, of))
    return cells[order], of[order]


def regions(elements: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, index of the set of each, widths): regions of any width, cut into cells of
    width 1, the last one narrower."""
    cells, of, widths = [], [], []
    for i, (element, weight) in enumerate(zip(elements, weights, strict=True)):
        count = np.ceil(weight).astype(np.int64)
        which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        cells.append(mix(np.repeat(element, count) + which.astype(np.uint64) * np.uint64(ODD)))
        of.append(np.full(len(which), i))
        widths.append(np.minimum(1.0, np.repeat(weight, count) - which))
    return np.concatenate(cells), np.concatenate(of), np.concatenate(widths)


def dart_signatures(cells: np.ndarray, of: np.ndarray, widths: np.ndarray | None = None, n: int | None = None, k: int = COORDINATES) -> np.ndarray:
    """One row of ``k`` coordinates for each of the ``n`` weighted sets, given by cells in
    order of ``of`` (all of width 1 if None)."""
    n = int(of[-1]) + 1 if n is None else n
    signatures = np.full((n, k), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat = signatures.reshape(-1)
    totals = np.bincount(of, weights=widths, minlength=n)
    darts, todo = k * (np.log(k) + 4), np.ones(n, dtype=bool)
    while todo.any():
        chosen = todo[of]
        seed, own = mix(cells[chosen]), of[chosen]
        width = None if widths is None else widths[chosen]
        rank, last = np.zeros(len(seed)), darts / totals[own]
        while len(seed):
            seed = mix(seed + np.uint64(ODD))
            rank = rank - np.log(((seed >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53)
            alive = rank <= last
            seed, rank, last, own = seed[alive], rank[alive], last[alive], own[alive]
            dart = mix(seed ^ np.uint64(0x5851F42D4C957F2D))
            at = own * k + (dart >> np.uint64(32)).astype(np.int64) * k // (1 << 32)
            value = (rank.view(np.uint64) & ~np.uint64(0xFFFFF)) | (dart & np.uint64(0xFFFFF))
            if width is not None:
                width = width[alive]
                inside = (mix(dart) >> np.uint64(11)).astype(float) * 2.0**-53 < width
                at, value = at[inside], value[inside]
            np.minimum.at(flat, at, value)
        todo = (signatures == np.iinfo(np.uint64).max).any(axis=1) & (totals > 0)
        darts *= 2
    return signatures


def band_hashes(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, -1)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(parts.shape[2]):
        h = mix(h * np.uint64(ODD) + parts[:, :, j])
    return h.view(np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def banded(texts: pd.Series) -> pd.Series:
    """Of each text the hashes of its bands."""
    bands = []
    for _, some in batches_of(texts.tolist()):
        bands += list(band_hashes(dart_signatures(*weighted_shingles(some), n=len(some))))
    return pd.Series(bands, dtype=object)


def cells_of(texts: list[str]) -> Iterator[np.ndarray]:
    """Each text's cells, sorted."""
    for _, some in batches_of(texts):
        cells, of = weighted_shingles(some)
        yield from np.split(cells, np.searchsorted(of, np.arange(1, len(some))))


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether the weighted Jaccard similarity of two sets of sorted cells reaches the threshold."""
    if min(len(a), len(b)) < threshold * max(len(a), len(b)) - 1e-9:
        return False
    common = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return common >= threshold * (len(a) + len(b) - common) - 1e-9


def compared(threshold: float):
    """Links of the cells of one partition, which comes sorted, each cell's leader first."""

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leader, mine = None, np.zeros(0, np.uint64)
        for pdf in batches:
            found = []
            for node, b, own in zip(pdf["node"].tolist(), pdf["b"].tolist(), cells_of(pdf["text"].tolist()), strict=True):
                if node == b:
                    leader, mine = b, own
                elif b != leader:
                    raise ValueError("a cell came without its leader")
                elif similar(mine, own, threshold):
                    found.append((node, b))
            yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return links


class Members:
    """Nodes of a part, and how many cells another set has in common with each."""

    def __init__(self):
        self.nodes, self.roots, self.cells, self.index = [], [], [], None

    def add(self, node: int, root: int, cells: np.ndarray) -> None:
        for values, value in zip((self.nodes, self.roots, self.cells), (node, root, cells), strict=True):
            values.append(value)

    def similar_to(self, own: np.ndarray, threshold: float) -> np.ndarray:
        if self.index is None:
            sizes = np.array([len(c) for c in self.cells], dtype=np.int64)
            flat = np.concatenate([*self.cells, np.zeros(0, np.uint64)])
            order = np.argsort(flat)
            self.index, self.cells = (flat[order], np.repeat(np.arange(len(sizes)), sizes)[order], sizes), []
        flat, owner, sizes = self.index
        low, high = np.searchsorted(flat, own), np.searchsorted(flat, own, side="right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(sizes))
        return np.flatnonzero(common >= threshold * (sizes + len(own) - common) - 1e-9)


def compared_parts(threshold: float):
    """Links between the members of a part and those that visit it, enough to connect them.

    A partition comes sorted, each part's members first; only these are held.
    """

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, members, parent = None, Members(), {}

        def root(r: int) -> int:
            while parent.get(r, r) != r:
                r = parent[r]
            return r

        for pdf in batches:
            found = []
            columns = [pdf[c].tolist() for c in ("key", "part", "visits", "node", "root")]
            for key, part, visits, node, own_root, own in zip(*columns, cells_of(pdf["text"].tolist()), strict=True):
                if (key, part) != at:
                    at, members, parent = (key, part), Members(), {}
                if not visits:
                    members.add(node, own_root, own)
                    continue
                for i in members.similar_to(own, threshold).tolist():
                    x, y = root(own_root), root(members.roots[i])
                    if x != y:
                        found.append((node, members.nodes[i]))
                        parent[x] = y
            yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return links


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of ``pairs`` (a, b) those whose texts are similar.

    The texts of many a meet that of one b: by salted cells, each of which gets b's text
    once, in front.  The salts grow with the session's partitions.  A task holds one text and
    a batch of others, whatever a cell's size.
    """
    salts = max(256, 4 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cells = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(salts)).cast("int").alias("salt"))
    rows = cells.select(F.col("a").alias("node"), "b", "salt").unionByName(cells.select(F.col("b").alias("node"), "b", "salt").distinct())
    rows = rows.join(texts.select("node", "text"), "node").select("b", "salt", (F.col("node") != F.col("b")).alias("visits"), "node", "text")
    return rows.repartition("b", "salt").sortWithinPartitions("b", "salt", "visits").drop("salt", "visits").mapInPandas(compared(threshold), "a long, b long")


def narrowed(big: DataFrame, small: DataFrame, on: str) -> DataFrame:
    """A semi join; the small side is broadcast only if it has few rows when counted."""
    few = small.limit(MOST_BROADCAST_ROWS + 1).count() <= MOST_BROADCAST_ROWS
    return big.join(F.broadcast(small) if few else small, on, "left_semi")


def listed_cells(threshold: float):
    """Of texts their cells, and how many of the rarest two similar texts can't both miss."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for node, cells in zip(pdf["node"].tolist(), cells_of(pdf["text"].tolist()), strict=True):
                prefix = len(cells) - int(np.ceil(threshold * len(cells) - 1e-9)) + 1
                yield pd.DataFrame({"node": node, "prefix": prefix, "cell": cells.view(np.int64)})

    return listed


def similar_links(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links between different texts: enough of them to connect each class.

    ``nodes``: node, text, bands.  In each round every bucket draws a leader, by an
    order of all nodes, so that buckets with the same texts draw the same; each text meets
    the leaders of other components that it shares most buckets with.  A group of copies
    is connected in few rounds, without pairs among its members.  Rounds go on while they
    finish some of the buckets.

    What is left are texts that share buckets but aren't similar to the leaders.  Those that
    buckets connect to a family of bounded size are compared there, each moved once or few
    times; others inside buckets of up to BUCKET_PART texts.  The texts of larger buckets are
    matched by rare shingles first: two similar texts must share one among a fifth of each one's cells, in
    order of how often a cell occurs there.  Texts of one template whose own words make up
    that fifth thus don't meet again.  Those that do visit the parts of bounded size that
    the cell's texts are cut into.
    """
    rows = nodes.select("node", F.posexplode("bands").alias("band", "hash")).select("node", F.xxhash64("band", "hash").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key")
    rows = written(rows.join(shared, "key"))
    texts = written(narrowed(nodes.select("node", "text"), materialize(rows.select("node").distinct()), "node"))
    nodes_left = texts.count()
    labels, left, turn = None, None, 0
    now = rows.count()
    while True:
        labelled = rooted(rows, labels)
        draw = F.struct(F.xxhash64(F.lit(turn), "node"), "node", "root")
        drawn = labelled.groupBy("key").agg(F.min(draw).alias("c"), F.min("root").alias("r1"), F.max("root").alias("r2"), F.count(F.lit(1)).alias("size")).filter("r1 != r2")
        # buckets of one component are done with
        labelled = written(joined_by_key(labelled, drawn.select("key", "size", F.col("c.node").alias("b"), F.col("c.root").alias("b_root")), "key", "size", rows=now))
        rows = labelled.select("node", "key")
        now = rows.count()
        apart = gathered(labelled.filter("root != b_root").groupBy(F.col("node").alias("a"), "b").agg(F.count(F.lit(1)).alias("n")), now)
        order = Window.partitionBy("a").orderBy(F.desc("n"), "b")  # a node has a leader a band at most
        ranked = apart.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= LEADERS).select("a", "b")
        if now == 0 or (left is not None and now > GOING_ON * left):
            break
        more = compact(verified(materialize(gathered(ranked, LEADERS * nodes_left)), texts, threshold))
        # written: a checkpoint would hand on the constraints of its plan, which double from round to round
        labels = written(components(more if labels is None else labels.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)))
        left, turn = now, turn + 1
    found = nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0) if labels is None else labels.select(F.col("node").alias("a"), F.col("root").alias("b"))
    if now:
        together, small, large = families(labelled, now)
        found = found.unionByName(links_inside(together, texts, threshold)).unionByName(links_inside(small, texts, threshold))
        if not large.isEmpty():
            found = found.unionByName(rare_links(large.select("node", "root").distinct(), texts, threshold))
    return compact(found)


def compact(links: DataFrame) -> DataFrame:
    """Links (a, b), computed once by all tasks, then in no more partitions than they fill."""
    links = materialize(links)
    return gathered(links, links.count())


def rooted(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``rows``, of which a node has as many as bands at most, with their nodes' roots."""
    if labels is None:
        return rows.withColumn("root", F.col("node"))
    return joined_by_key(rows, labels.withColumn("bands", F.lit(BANDS)), "node", "bands", "left").drop("bands").withColumn("root", F.coalesce("root", "node"))


def families(labelled: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of families, of other small buckets, of other large buckets), each key, node,
    root and size, from ``n`` rows (key, node, root, size, b) of open buckets with leaders b.

    A family is what buckets connect, if it has up to FAMILY_PARTS parts of texts.
    """
    of = components(labelled.select(F.col("node").alias("a"), "b")).select("node", F.col("root").alias("family"), F.lit(BANDS).alias("bands"))
    rows = joined_by_key(labelled.select("key", "node", "root", "size"), of, "node", "bands", "left").drop("bands")
    rows = written(rows.withColumn("family", F.coalesce("family", "node")))
    nodes = gathered(rows.select("family", "node", "root").distinct(), n)
    sizes = nodes.groupBy("family").agg(F.count(F.lit(1)).alias("nodes"))
    buckets = rows.groupBy("family").agg(F.count(F.lit(1)).alias("rows"))
    sizes = materialize(gathered(sizes.join(buckets, "family"), n))
    fits = sizes.filter(F.col("nodes") <= FAMILY_PARTS * BUCKET_PART)
    together = joined_by_key(nodes, fits.select("family", F.col("nodes").alias("size")), "family", "size").withColumnRenamed("family", "key")
    others = joined_by_key(rows.drop("size").join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "key"), sizes.filter(F.col("nodes") > FAMILY_PARTS * BUCKET_PART).select("family", "rows"), "family", "rows")
    others = others.select("key", "node", "root", "size")
    return together, others.filter(F.col("size") <= BUCKET_PART), others.filter(F.col("size") > BUCKET_PART)


def rare_links(left: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between nodes of different roots, ``left`` (node, root), enough to connect
    them: similar texts that share a rare cell."""
    left = materialize(left)
    cells = written(narrowed(texts.select("node", "text"), left.select("node"), "node").mapInPandas(listed_cells(threshold), "node long, prefix long, cell long"))
    often = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    rarest = Window.partitionBy("node").orderBy("size", "cell")
    rows = joined_by_key(cells, often, "cell", "size").withColumn("rank", F.row_number().over(rarest)).filter("rank <= prefix and size > 1").select(F.col("cell").alias("key"), "node", "size")
    return links_inside(written(rows.join(left, "node")), texts, threshold)


def links_inside(rows: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between nodes of different roots that share a key; ``rows`` has key, node,
    root and the key's size.  Nodes outside the key's largest root visit all its parts."""
    by_root = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = by_root.groupBy("key").agg(F.max(F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots"), F.sum("n").alias("size")).filter("roots > 1")
    mixed = joined_by_key(rows.drop("size"), mixed.select("key", F.col("main.root").alias("main"), "size"), "key", "size").withColumn("parts", F.ceil(F.col("size") / BUCKET_PART).cast("int"))
    mixed = mixed.withColumn("main", F.col("root") == F.col("main")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    members = mixed.select("key", F.col("own").alias("part"), F.lit(False).alias("visits"), "node", "root")
    visitors = mixed.filter(~F.col("main")).select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("visits"), "node", "root")
    placed = members.unionByName(visitors).join(texts, "node")
    placed = placed.repartition("key", "part").sortWithinPartitions("key", "part", "visits", "node")
    return materialize(placed.mapInPandas(compared_parts(threshold), "a long, b long").distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes with links; root is the smallest node of the component.

    Alternates large-star and small-star rounds, which keep the edges in number and bring
    every node next to its root in few of them.  Minima are combined before the shuffle,
    and hot nodes' rows stay where they are.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    state, n = None, edges.count()
    edges = gathered(edges, n)
    while True:  # neither star adds edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("size")).select("u", F.least("u", "m").alias("m"), "size")
        large = joined_by_key(both.filter("v > u"), least, "u", "size", rows=2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = gathered(large, n)
        least = gathered(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("size")), n)
        small = joined_by_key(large, least, "u", "size", rows=n).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(gathered(small, n))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state, n = now, now[0]


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """For each different text digest, class_id, class_size, first_digest (that of the
    class' first document) and copies.

    Copies of a text are one node from the start, however many there are.
    """
    rows = docs.select(quoted(id_col).alias("doc_id"), text_or_empty(quoted(text_col)).alias("text"))
    nodes = rows.groupBy(text_digest(F.col("text")).alias("digest"), "text").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes.select("digest", "text", "first_id", "copies", banded("text").alias("bands"), F.monotonically_increasing_id().alias("node")))
    roots = components(similar_links(nodes, threshold))
    placed = joined_by_key(nodes.select("node", "digest", "first_id", "copies"), roots.withColumn("rows", F.lit(1)), "node", "rows", "left").drop("rows")
    placed = materialize(placed.withColumn("root", F.coalesce("root", "node")))
    first = F.min(F.struct(F.col("first_id").isNull(), "first_id", "digest"))
    classes = placed.groupBy("root").agg(first.alias("first"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("size"))
    classes = joined_by_key(placed.select("digest", "root", "copies"), classes, "root", "size")
    return materialize(classes.select("digest", F.col("first.first_id").alias("class_id"), "class_size", F.col("first.digest").alias("first_digest"), "copies"))


def text_digest(text):
    return F.unhex(F.sha2(text, 256))


def near_dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (smallest id of the class), class_size, kept; a row per row.

    Null text counts as empty; texts without a word are alike, and those under five words
    are similar only if their words are equal.  A null id never names a class unless all
    its ids are null.  Repeated rows are members of one class.  No rows give none; other
    columns aren't read, whatever their names.
    """
    classes = near_classes(docs, id_col, text_col, threshold)
    rows = materialize(docs.select(quoted(id_col).alias("doc_id"), text_digest(text_or_empty(quoted(text_col))).alias("digest")))
    kept = F.col("doc_id").eqNullSafe(F.col("class_id"))
    return joined_by_key(rows, classes, "digest", "copies").select("doc_id", "class_id", "class_size", kept.alias("kept"))


def near_keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The first document of each class, with all columns.  Rows that repeat both its id
    and its text stay too; exact dedup, which comes first, leaves none."""
    classes = near_classes(docs, id_col, text_col, threshold).filter("class_size > 1")  # others are kept as they are
    keyed = docs.select(packed_row(docs).alias("row"), quoted(id_col).alias("id"), text_digest(text_or_empty(quoted(text_col))).alias("digest"))
    judged = joined_by_key(keyed, classes, "digest", "copies", how="left")
    kept = judged.filter(F.col("class_id").isNull() & F.col("first_digest").isNull() | (F.col("digest") == F.col("first_digest")) & F.col("id").eqNullSafe(F.col("class_id")))
    return unpacked_row(kept, docs.columns)
