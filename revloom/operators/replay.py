"""Rebuilding file contents from edit scripts.

A trunk's newest revision is stored whole, each older one as an edit of the next newer; a
branch's as edits of the revision before, from the one it grows from.  So a file is a few
chains of edits.  Edits compose: two in a row are one, in the same form.  A long chain is cut
into segments whose edits are composed apart from each other; the composed edits, one per
segment, give the text at which each segment starts, and then all segments are replayed at
once.  A task holds one text and one composed edit, and gives revisions out as they come.

Only deltas that a wanted revision depends on are replayed: those between it and its chain's
start, and so on for the chains that its own grows from.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revloom.functions import revnum
from revloom.operators.keywords import expanded
from revloom.operators.ordered import numbered, ranked, with_neighbour
from revloom.operators.shared import dealt, framed, materialize

COMMAND = re.compile(rb"([ad])(\d+) (\d+)\Z")
#: Deltas in a segment.
SEGMENT = 256


class CorruptDelta(ValueError):
    """An edit script that doesn't fit its text."""


def split_lines(text: bytes) -> list[bytes]:
    """Lines with their ends; the last one may lack it."""
    return text.splitlines(keepends=True) if b"\r" not in text and b"\x0b" not in text and b"\x0c" not in text else re.findall(rb"[^\n]*\n|[^\n]+", text)


def hunks(script: bytes) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first line, lines deleted, lines added) of a script; lines count from 0, before the edit."""
    commands, i, done = split_lines(script), 0, 0
    while i < len(commands):
        m = COMMAND.match(commands[i].rstrip(b"\n"))
        if not m:
            raise CorruptDelta(repr(commands[i][:40]))
        at, count = int(m[2]), int(m[3])
        i += 1
        if m[1] == b"d":
            at, deleted, added = at - 1, count, []
        else:
            if i + count > len(commands):
                raise CorruptDelta("an edit without its lines")
            deleted, added = 0, commands[i : i + count]
            i += count
        if at < done:
            raise CorruptDelta("an edit outside the text")
        done = at + deleted
        yield at, deleted, added


def apply_edit(lines: list[bytes], script: bytes) -> list[bytes]:
    """``lines`` after an edit script, whose numbers count the lines before the edit."""
    out, done = [], 0
    for at, deleted, added in hunks(script):
        if at + deleted > len(lines):
            raise CorruptDelta("an edit outside the text")
        out += lines[done:at]
        out += added
        done = at + deleted
    return out + lines[done:]


class Edit:
    """An edit of a text that isn't known yet: runs of its lines, and lines of its own.

    A run is (start, stop), the last one without a stop.  ``Edit.of_text`` needs no text.
    """

    def __init__(self, pieces: list):
        self.pieces = pieces

    @classmethod
    def nothing(cls) -> Edit:
        return cls([(0, None)])

    @classmethod
    def of_text(cls, text: bytes) -> Edit:
        return cls([split_lines(text)])

    def then(self, script: bytes) -> Edit:
        """This edit and after it another, as one."""
        rest, out = self.pieces[::-1], []

        def move(count: int | None, keep: bool) -> None:
            while rest and count != 0:
                piece = rest.pop()
                run = isinstance(piece, tuple)
                size = (None if piece[1] is None else piece[1] - piece[0]) if run else len(piece)
                if count is not None and (size is None or size > count):
                    cut = piece[0] + count if run else count
                    rest.append((cut, piece[1]) if run else piece[cut:])
                    piece, size = ((piece[0], cut) if run else piece[:cut]), count
                if keep and size != 0:
                    out.append(piece)
                count = None if count is None else count - size
            if count:
                raise CorruptDelta("an edit outside the text")

        done = 0
        for at, deleted, added in hunks(script):
            move(at - done, True)
            move(deleted, False)
            if added:
                out.append(added)
            done = at + deleted
        move(None, True)
        return Edit(out)

    def on(self, lines: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for piece in self.pieces:
            if isinstance(piece, tuple):
                if max(piece[0], piece[1] or 0) > len(lines):
                    raise CorruptDelta("an edit outside the text")
                out += lines[piece[0] : piece[1]]
            else:
                out += piece
        return out

    def packed(self) -> list[dict]:
        return [{"start": p[0], "stop": p[1], "added": None} if isinstance(p, tuple) else {"start": None, "stop": None, "added": b"".join(p)} for p in self.pieces]

    @classmethod
    def unpacked(cls, pieces: Iterable) -> Edit:
        return cls([split_lines(bytes(p["added"])) if p["added"] is not None else (int(p["start"]), None if p["stop"] is None else int(p["stop"])) for p in pieces])


PIECES = "array<struct<start:bigint,stop:bigint,added:binary>>"


def common_lines(old: list[bytes], new: list[bytes]) -> list[tuple[int, int]]:
    """Places of lines that stand once in both, in an order that both share: the longest such."""
    once = lambda x: {line: i for i, line in enumerate(x) if counts[line] == 1}
    counts: dict[bytes, int] = {}
    for line in old:
        counts[line] = counts.get(line, 0) + 1
    here = once(old)
    counts = {}
    for line in new:
        counts[line] = counts.get(line, 0) + 1
    pairs = [(here[line], j) for line, j in once(new).items() if line in here]
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (i, _) in enumerate(pairs):  # in order of new
        where = bisect_left(tops, i)
        before.append(at[where - 1] if where else -1)
        tops[where : where + 1], at[where : where + 1] = [i], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def make_edit(old: list[bytes], new: list[bytes]) -> bytes:
    """An edit script from ``old`` to ``new``: what differs between the lines that both have
    once, in an order that both share, is replaced."""
    out, i, j = [], 0, 0

    def replace(upto: int, to: int) -> None:
        a, b, c, d = i, upto, j, to
        while a < b and c < d and old[a] == new[c]:
            a, c = a + 1, c + 1
        while a < b and c < d and old[b - 1] == new[d - 1]:
            b, d = b - 1, d - 1
        if a < b:
            out.append(b"d%d %d\n" % (a + 1, b - a))
        if c < d:
            out.append(b"a%d %d\n" % (b, d - c))
            out.extend(new[c:d])

    for x, y in common_lines(old, new):
        replace(x, y)
        i, j = x + 1, y + 1
    replace(len(old), len(new))
    return b"".join(out)


# Chains


def chained(deltas: DataFrame) -> DataFrame:
    """Adds rev, chain (the number of a branch; empty for the trunk), level and place, by
    which a chain's deltas sort in the order of replay."""
    rows = deltas.withColumn("rev", revnum.parse("number"))
    trunk = F.size("rev") == 2
    chain = F.when(trunk, "").otherwise(F.array_join(F.slice("rev", 1, F.greatest(F.size("rev") - 1, F.lit(0))).cast("array<string>"), "."))
    place = F.when(trunk, F.transform("rev", lambda x: -x)).otherwise(F.slice("rev", -1, 1))
    return rows.withColumns({"chain": chain, "level": (F.size("rev") / 2 - 1).cast("int"), "place": place})


def needed(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The deltas, as chained, that the revisions in ``wanted`` (master_id, number) depend on.

    A number's own prefixes name the revisions that its chain and those below it grow from.
    """
    asked = wanted.select("master_id", revnum.parse("number").alias("rev"))
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.floor(F.size("rev") / 2), F.lit(1)).cast("int")), lambda i: F.slice("rev", 1, 2 * i))
    on_way = asked.select("master_id", F.explode(steps).alias("rev")).select("master_id", revnum.render("rev").alias("number"))
    last = chained(on_way).groupBy("master_id", "chain").agg(F.max("place").alias("__upto"))
    return rows.join(last, ["master_id", "chain"]).filter(F.col("place") <= F.col("__upto")).drop("__upto")


def segmented(keys: DataFrame, segment: int) -> tuple[DataFrame, bool, int]:
    """Adds seg, the number of a delta's segment in its chain; whether a chain has several; the
    deepest level.  ``keys`` are chained deltas without their texts."""
    sizes = materialize(keys.groupBy("master_id", "chain").agg(F.count(F.lit(1)).alias("n"), F.max("level").alias("level")))
    longest, deepest = sizes.agg(F.max("n"), F.max("level")).first()
    if (longest or 0) <= segment:
        return keys.withColumn("seg", F.lit(0).cast("long")), False, deepest or 0
    long = sizes.filter(F.col("n") > segment).select("master_id", "chain")
    places = numbered(keys.join(long, ["master_id", "chain"], "left_semi").select("master_id", "chain", "place", "number"), [F.col("place")], "rank", ["master_id", "chain"])
    places = places.select("master_id", "number", F.floor((F.col("rank") - 1) / segment).alias("seg"))
    return keys.join(places, ["master_id", "number"], "left").withColumn("seg", F.coalesce("seg", F.lit(0).cast("long"))), True, deepest or 0


GROUP = ["master_id", "chain", "seg"]


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple]:
    """(key, whether it is a new one, row) of rows sorted by key."""
    now = None
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            key = tuple(getattr(row, k) for k in keys)
            yield key, key != now, row
            now = key


def composer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def composed() -> Iterator[tuple[int, tuple]]:
        edit, now = None, None

        def made() -> tuple[int, tuple]:
            pieces = edit.packed()
            return sum(len(p["added"] or b"") for p in pieces), (*now, pieces)

        for key, new, row in groups(batches, GROUP):
            if new:
                if edit:
                    yield made()
                now, whole = key, key[1:] == ("", 0)  # a trunk begins with a whole text
                edit = Edit.of_text(row.edit_text) if whole else Edit.nothing().then(row.edit_text)
            else:
                edit = edit.then(row.edit_text)
        if edit:
            yield made()

    return framed(composed(), [*GROUP, "pieces"])


def walker(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts at which segments start, from the base of a chain and its composed edits."""

    def walked() -> Iterator[tuple[int, tuple]]:
        lines = None
        for (master, chain), new, row in groups(batches, ["master_id", "chain"]):
            if new:
                lines = None
            if row.base is not None:
                lines = split_lines(bytes(row.base))
                continue
            if row.seg:
                if lines is None:
                    continue
                text = b"".join(lines)
                yield len(text), (master, chain, row.seg, text)
            elif lines is None and chain:
                continue  # grows from a revision that isn't there
            lines = Edit.unpacked(row.pieces).on(lines or [])

    return framed(walked(), [*GROUP, "anchor"])


def replayer(keywords: bool):
    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, tuple]]:
        lines = None
        for key, new, row in groups(batches, GROUP):
            if new:
                lines = None
            if row.anchor is not None:
                lines = split_lines(bytes(row.anchor))
                continue
            if lines is None and key[1:] != ("", 0):
                continue  # nothing to grow from
            lines = split_lines(bytes(row.edit_text)) if lines is None else apply_edit(lines, bytes(row.edit_text))
            if row.wanted:
                content = b"".join(lines)
                content = expanded(content, row, row.mode) if keywords and row.mode != "b" else content
                yield len(content), (row.master_id, row.number, content)

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return framed(contents(batches), ["master_id", "number", "content"])

    return replay


def replayed(rows: DataFrame, anchors: DataFrame | None, keywords: bool) -> DataFrame:
    """(master_id, number, content) of the wanted rows; segments but a trunk's first need an anchor."""
    kind = rows.schema["master_id"].dataType.simpleString()
    rows = rows.withColumn("anchor", F.lit(None).cast("binary"))
    if anchors is not None:
        rows = rows.unionByName(anchors, allowMissingColumns=True)
    placed = dealt(rows, GROUP).sortWithinPartitions(*GROUP, F.col("anchor").isNull(), "place").drop("place", "rev", "level")
    return placed.mapInPandas(replayer(keywords), f"master_id {kind}, number string, content binary")


def level_anchors(rows: DataFrame, bases: DataFrame | None, several: bool) -> DataFrame | None:
    """(master_id, chain, seg, anchor) for chains of one level, whose ``bases`` (master_id,
    chain, base) are the texts that they grow from."""
    first = None if bases is None else bases.select("master_id", "chain", F.lit(0).cast("long").alias("seg"), F.col("base").alias("anchor"))
    if not several:
        return first
    kind = rows.schema["master_id"].dataType.simpleString()
    long = rows.filter("seg > 0").select("master_id", "chain").distinct()
    edits = dealt(rows.join(long, ["master_id", "chain"], "left_semi"), GROUP).sortWithinPartitions(*GROUP, "place").select(*GROUP, "edit_text")
    composed = edits.mapInPandas(composer, f"master_id {kind}, chain string, seg long, pieces {PIECES}")
    steps = composed.withColumn("base", F.lit(None).cast("binary"))
    if bases is not None:
        steps = steps.unionByName(bases.join(long, ["master_id", "chain"], "left_semi").withColumn("seg", F.lit(-1).cast("long")), allowMissingColumns=True)
    walked = dealt(steps, ["master_id", "chain"]).sortWithinPartitions("master_id", "chain", "seg").select(*GROUP, "pieces", "base")
    later = walked.mapInPandas(walker, f"master_id {kind}, chain string, seg long, anchor binary")
    return later if first is None else first.unionByName(later)


def snapshots(deltas: DataFrame, wanted: DataFrame | None = None, keywords: bool = True, segment: int = SEGMENT) -> DataFrame:
    """(master_id, number, content) of live revisions, or of those of them that are ``wanted``
    (master_id, number).

    ``deltas``: master_id, number, edit_text, dead, mode and, for keywords, name, path, t,
    author, state, log.  A branch that grows from a missing revision gives nothing.
    """
    # what is replayed and in which segments is found by the keys; the texts are joined to it once
    keys = chained(deltas.select("master_id", "number", "dead"))
    if wanted is None:
        keys = keys.withColumn("wanted", ~F.col("dead"))
    else:
        asked = materialize(wanted.select("master_id", "number").distinct())
        keys = needed(keys, asked).join(asked.withColumn("__asked", F.lit(True)), ["master_id", "number"], "left")
        keys = keys.withColumn("wanted", F.coalesce("__asked", F.lit(False)) & ~F.col("dead")).drop("__asked")
    keys, several, deepest = segmented(materialize(keys.drop("dead")), segment)
    if wanted is None and not several:
        rows = chained(deltas).withColumns({"wanted": ~F.col("dead"), "seg": F.lit(0).cast("long")})
    else:
        rows = deltas.drop(*set(keys.columns) - {"master_id", "number"}).join(keys, ["master_id", "number"])
    if deepest or several:
        rows = materialize(rows)
    bases, anchors = None, None
    for level in range(deepest + 1):  # nested branches, a few at most
        here = rows.filter(F.col("level") == level)
        found = level_anchors(here, bases, several)
        if several:
            found = materialize(found)  # composed once for the branches and for the revisions
        anchors = found if anchors is None else anchors if found is None else anchors.unionByName(found)
        if level == deepest:
            break
        grown = keys.filter(F.col("level") == level + 1).select("master_id", "chain").distinct()
        grown = grown.withColumn("number", F.regexp_replace("chain", "[.][^.]*$", ""))
        # segments without a revision that something grows from needn't be replayed
        asked = keys.filter(F.col("level") == level).join(grown.select("master_id", "number").distinct(), ["master_id", "number"], "left_semi")
        there = asked.groupBy(*GROUP).agg(F.collect_set("number").alias("__asked"))
        marked = here.drop("wanted").join(there, GROUP).withColumn("wanted", F.array_contains("__asked", F.col("number"))).drop("__asked")
        texts = replayed(marked, None if found is None else found.join(there, GROUP, "left_semi"), False)
        bases = materialize(texts.join(grown, ["master_id", "number"]).select("master_id", "chain", F.col("content").alias("base")))
    return replayed(rows, anchors, keywords)


def encoder(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        lines = lambda x: split_lines(x.encode("utf-8", "surrogatepass"))
        edits = [b.encode("utf-8", "surrogatepass") if n is None else make_edit(lines(n), lines(b)) for b, n in zip(pdf["body"], pdf["after"], strict=True)]
        yield pd.DataFrame({"master_id": pdf["master_id"], "number": pdf["number"], "place": pdf["place"], "edit_text": edits})


def scripts_between(versions: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """(master_id, number, place, edit_text): a trunk of reverse edits from versions of a text.

    Each version meets the next one only, so a key of any size is spread over tasks.
    """
    rows = versions.select(F.col(key).alias("master_id"), F.col(order).cast("long").alias("place"), F.coalesce(F.col(content), F.lit("")).alias("body")).withColumn("bucket", F.floor(F.col("place") / SEGMENT))
    by_place = [F.col("place")]
    rows = ranked(with_neighbour(rows, ["master_id"], "bucket", by_place, {"after": "body"}, following=True), ["master_id"], "bucket", by_place, "rank")
    rows = rows.select("master_id", F.concat(F.lit("1."), "rank").alias("number"), "place", "body", "after")
    return rows.mapInPandas(encoder, f"master_id {rows.schema['master_id'].dataType.simpleString()}, number string, place long, edit_text binary")
