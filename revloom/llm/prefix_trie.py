"""A trie of conversations, as a burst trie.

Conversations are paths of turn ids.  The trie keeps heads, nodes that are tables of their
own, and below them containers of unsorted suffixes.  A container of over ``LIMIT`` turns
bursts by its next turn id: its top becomes a head, and the suffixes fall into containers
by the turn that follows.  What lies below a node shrinks along every path, so the heads
that bursting ends with are just the nodes with over ``LIMIT`` turns below them, and one
count over all prefixes finds them, without a round per level.  Containers, each of
bounded size, are then dealt over shards, sorted and swept into nodes.

Equal conversations are one path with a weight.  Numbers of heads are sums over their paths:
every node is owned by its smallest member, so what a path owns below a node, summed over
the paths through the node, is what the node's subtree holds.  A conversation of any length
is numbered and hashed by parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revloom.llm.common import joined_by_key, quoted, text_or_empty, word_count, written
from revloom.operators.ordered import ranked, running

#: Turns in a container that doesn't burst; levels in a part of a path; ids written together.
LIMIT, PART, IDS = 256, 4096, 512
#: Turns that a conversation may take over, and how far apart those are that it takes them from.
TAKEN, APART = 4, 20
EMPTY = hashlib.sha256(b"").hexdigest()


def node(*, of: str = "") -> Column:
    """The name of a prefix: its length and two sums of hashes."""
    return F.struct(*[F.col(of + c).alias(c) for c in ("depth", "p1", "p2")])


def placed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), turn_id, words, by turn (null first), then by a digest."""
    role, text = text_or_empty(quoted("role").cast("string")), text_or_empty(quoted("text").cast("string"))
    turn_id = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    rows = conversations.select(quoted("conv_id").cast("long").alias("conv_id"), quoted("turn").cast("long").alias("turn"), turn_id.alias("turn_id"), word_count(text).alias("words"))
    rows = rows.filter(F.col("conv_id").isNotNull()).withColumn("tie", F.monotonically_increasing_id())
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("turn_id"), F.col("tie")]
    cut = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    return ranked(cut, ["conv_id"], "part", order[1:], "pos").select("conv_id", "pos", "turn_id", "words")


def rebuilt(own: DataFrame) -> DataFrame:
    """conv_id, depth, turn_id, words: each conversation after the turns that it takes over,
    and a row of depth 0 for each."""
    number = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % TAKEN
    base = F.col("conv_id") - F.col("conv_id") % APART
    first = own.filter(F.col("pos") < TAKEN).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "turn_id", "words")
    ids = own.groupBy("conv_id").agg(F.max("pos").alias("n")).select("conv_id", base.alias("base"), number.alias("h"))
    taken = written(ids.filter("h > 0").join(first, "base").filter("depth <= h").select("conv_id", "depth", "turn_id", "words"))
    short = ids.join(taken.groupBy("conv_id").agg(F.max("depth").alias("m")), "conv_id", "left").select("conv_id", (F.col("h") - F.coalesce("m", F.lit(0))).alias("less")).filter("less > 0")
    rest = own.filter(F.col("pos") > number).join(short, "conv_id", "left")
    rest = rest.select("conv_id", (F.col("pos") - F.coalesce("less", F.lit(0))).alias("depth"), "turn_id", "words")
    root = ids.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("turn_id"), F.lit(0).cast("long").alias("words"))
    return taken.unionByName(rest).unionByName(root)


def with_prefixes(rows: DataFrame, part: int = PART) -> DataFrame:
    """Adds p1 and p2, which with the depth name the prefix up to the row; (0, 0) at depth 0."""
    rows = rows.withColumn("part", F.floor(F.col("depth") / part))
    lanes = {f"t{i}": F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(i), "depth", "turn_id", F.lit(-i))) for i in (1, 2)}
    rows = rows.withColumns(lanes)
    inside = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "part").agg(*[F.bit_xor(f"t{i}").alias(f"s{i}") for i in (1, 2)])
    carried = sums.select("conv_id", "part", *[F.bit_xor(f"s{i}").over(before).alias(f"c{i}") for i in (1, 2)]).filter("part > 0")
    rows = rows.withColumns({f"p{i}": F.bit_xor(f"t{i}").over(inside) for i in (1, 2)}).drop("t1", "t2")
    later = rows.filter("part > 0").join(carried, ["conv_id", "part"])
    later = later.withColumns({f"p{i}": F.col(f"p{i}").bitwiseXOR(F.col(f"c{i}")) for i in (1, 2)}).drop("c1", "c2")
    return rows.filter("part = 0").unionByName(later).drop("part")


def paths(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of one conversation per distinct path, with its members' number n and its length;
    conv_id and path of every conversation).  A path is named by its smallest member."""
    last = written(rows.groupBy("conv_id").agg(F.max(node()).alias("whole")))
    groups = last.groupBy("whole").agg(F.min("conv_id").alias("path"), F.count(F.lit(1)).alias("n"))
    members = written(joined_by_key(last, groups, "whole", "n"))
    kept = members.filter("conv_id = path").select("conv_id", "path", "n", F.col("whole.depth").alias("length"))
    return rows.join(kept, "conv_id").drop("conv_id"), members.select("conv_id", "path")


def burst(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The rows of paths, with the head they are (head_conv, head_convs), if they are one."""
    below = rows.groupBy("depth", "p1", "p2").agg(F.sum(F.col("length") - F.col("depth")).alias("below"), F.min("path").alias("head_conv"), F.sum("n").alias("head_convs"), F.count(F.lit(1)).alias("on"))
    heads = below.filter((F.col("below") > limit) | (F.col("depth") == 0)).select(node().alias("node"), "head_conv", "head_convs", "on")
    return joined_by_key(rows.withColumn("node", node()), heads, "node", "on", "left").drop("on")


def swept(suffixes: list[tuple[list[str], list[int], int, int]], depth: int, above: int | None) -> list[list]:
    """Nodes of a container, its top at ``depth``, below a head whose smallest member is
    ``above``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    the path that ends there.

    ``suffixes``: turn ids, their words, members and path, all with the same first turn.
    """
    suffixes.sort(key=lambda s: s[0])
    nodes: list[list] = []  # conv, level, parent, convs, children, leaves, saved, ends, words
    open_nodes: list[int] = []

    def close(level: int) -> None:
        while len(open_nodes) > level:
            i = open_nodes.pop()
            x = nodes[i]
            x[5] += not x[4]
            x[6] += (x[3] - 1) * x[8]
            if open_nodes:
                p = nodes[open_nodes[-1]]
                p[0] = x[0] if p[0] is None else min(p[0], x[0])
                p[3], p[4], p[5], p[6] = p[3] + x[3], p[4] + 1, p[5] + x[5], p[6] + x[6]

    last: list[str] = []
    for turns, words, n, path in suffixes:
        shared = 0
        while shared < min(len(last), len(turns)) and last[shared] == turns[shared]:
            shared += 1
        close(shared)
        for level in range(shared, len(turns)):
            nodes.append([None, level, open_nodes[-1] if open_nodes else None, 0, 0, 0, 0, None, words[level]])
            open_nodes.append(len(nodes) - 1)
        end = nodes[open_nodes[-1]]
        end[0], end[3], end[7] = path if end[0] is None else min(end[0], path), end[3] + n, path
        last = turns
    close(0)
    return [[c, depth + level, above if parent is None else nodes[parent][0], *numbers, ends] for c, level, parent, *numbers, ends, _ in nodes]


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends long, is_top boolean"


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of suffixes, by container, path and depth, into the nodes of the containers."""
    names = [x.split()[0] for x in NODE.split(", ")]
    types = [pa.int64()] * 8 + [pa.bool_()]
    now, suffixes = None, []

    def ended() -> list[tuple]:
        return [(*x, x[1] == now[0]) for x in swept(suffixes, now[0], now[3])] if suffixes else []

    def made(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for batch in batches:
        out: list[tuple] = []
        for *container, path, turn_id, words, n in zip(*[batch.column(c).to_pylist() for c in ("c_depth", "c_p1", "c_p2", "above", "path", "turn_id", "words", "n")], strict=True):
            if container != now:
                out += ended()
                now, suffixes = container, []
            if not suffixes or suffixes[-1][3] != path:
                suffixes.append(([], [], n, path))
            suffixes[-1][0].append(turn_id)
            suffixes[-1][1].append(words)
        yield made(out)
    yield made(ended())


def container_nodes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes of all containers; node and parent of the containers' tops)."""
    here = F.struct(*[F.col(c) for c in ("depth", "p1", "p2", "head_conv")])
    is_head = F.col("head_conv").isNotNull()
    cuts = rows.groupBy("path").agg(F.max(F.when(is_head, here)).alias("above"), F.min(F.when(~is_head, node())).alias("c")).filter("c is not null")
    cuts = written(cuts.select("path", F.col("c.depth").alias("c_depth"), F.col("c.p1").alias("c_p1"), F.col("c.p2").alias("c_p2"), F.col("above.head_conv").alias("above"), node(of="above.").alias("parent")))
    suffixes = rows.filter(~is_head).select("path", "depth", "turn_id", "words", "n").join(cuts.drop("parent"), "path")
    key = ["c_depth", "c_p1", "c_p2"]
    dealt = suffixes.repartition(*key).sortWithinPartitions(*key, "path", "depth").select(*key, "above", "path", "turn_id", "words", "n")
    tops = cuts.groupBy(*key).agg(F.first("parent").alias("parent")).select("parent")
    return written(dealt.mapInArrow(sweep, NODE)), tops


def head_nodes(rows: DataFrame, containers: DataFrame, tops: DataFrame) -> DataFrame:
    """The heads as nodes, from the rows of paths on them and the containers below."""
    mine = rows.filter("head_conv is not null")
    owned = F.col("path") == F.col("head_conv")
    on = mine.select("path", "depth", "node", "head_conv", "head_convs", F.when(F.col("length") == F.col("depth"), F.col("path")).alias("ends"), F.lit(0).cast("long").alias("leaves"), F.when(owned, (F.col("head_convs") - 1) * F.col("words")).otherwise(0).alias("saved"))
    below = containers.filter("is_top").select(F.col("conv_id").alias("path"), "depth", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    both = on.unionByName(below, allowMissingColumns=True).withColumn("level", -F.col("depth")).withColumn("part", -F.floor(F.col("depth") / PART))
    summed = running(both, ["path"], "part", [F.col("level")], {"to_leaves": F.col("leaves"), "to_saved": F.col("saved")}).filter("node is not null")
    heads = summed.groupBy("node").agg(F.first("head_conv").alias("conv_id"), F.first("head_convs").alias("n_convs"), F.sum("to_leaves").alias("n_leaves"), F.sum("to_saved").alias("saved_tokens"), F.max("ends").alias("ends"))
    above = mine.select("path", (F.col("depth") + 1).alias("depth"), F.col("head_conv").alias("parent_conv_id"), F.col("node").alias("parent"))
    linked = mine.filter(owned & (F.col("depth") > 0)).select("path", "depth", "node").join(above, ["path", "depth"]).select("node", "parent_conv_id", "parent")
    children = tops.unionByName(linked.select("parent")).groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "node")
    found = heads.join(linked.drop("parent"), "node", "left").join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    # every head but a root of turnless conversations has children
    return found.select("conv_id", F.col("node.depth").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"), "saved_tokens", "ends")


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (path, conv_id) into rows of up to ``IDS`` ids of one path."""
    now, first, ids = None, None, []

    def made(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["path", "first", "ids"])

    for batch in batches:
        out = []
        for path, conv_id in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if path != now or len(ids) == IDS:
                if ids:
                    out.append((now, first, ",".join(ids)))
                now, first, ids = path, conv_id, []
            ids.append(str(conv_id))
        yield made(out)
    yield made([(now, first, ",".join(ids))] if ids else [])


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (path, first, ids) into the digest of all ids of a path."""
    now, digest = None, None

    def made(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string()), strict=True)], ["ends", "ends_sha256"])

    for batch in batches:
        out = []
        for path, ids in zip(batch.column("path").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if path != now:
                if digest:
                    out.append((now, digest.hexdigest()))
                now, digest = path, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield made(out)
    yield made([(now, digest.hexdigest())] if digest else [])


def ends(members: DataFrame) -> DataFrame:
    """ends (a path), ends_sha256: the digest of its members' ids, in order.

    Ranges of the sorted pairs are written into lists of bounded size, apart from each other,
    before a path's lists are read in a row.
    """
    pieces = members.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(listed, "path long, first long, ids string")
    return pieces.repartition("path").sortWithinPartitions("path", "first").select("path", "ids").mapInArrow(hashed, "ends long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    A null role or text is empty; null turns come first, turns of the same number go by a
    digest of role and text, and repeated rows are turns each.  Rows without a conv_id
    belong to no conversation and are left out.  Texts are reduced to digests and word counts
    where they are read; an empty table gives no nodes, not even a root; other columns
    are not read.
    """
    rows, members = paths(with_prefixes(rebuilt(written(placed_turns(conversations)))))
    rows = written(burst(written(rows), limit))
    containers, tops = container_nodes(rows)
    nodes = written(containers.drop("is_top").unionByName(head_nodes(rows, containers, tops)))
    ended = nodes.filter("ends is not null").join(ends(members), "ends").drop("ends")
    return ended.unionByName(nodes.filter("ends is null").drop("ends").withColumn("ends_sha256", F.lit(EMPTY)))
