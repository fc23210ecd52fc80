"""Grouping of file revisions into changesets.

The grouping is greedy and sequential: the newest revision that isn't taken leads, and
takes what matches it within the window.  Revisions further apart than the window never
meet, so gaps cut a history into epochs that are worked on in parallel.  Inside an epoch
rows stream through in time order; only those within one window of the leader are held.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revloom.operators.ordered import day_of, numbered, running, with_neighbour
from revloom.operators.shared import dealt, materialize

WINDOW = 300


def time_close(a: Column, b: Column, window: int = WINDOW) -> Column:
    return F.abs(a - b) < window


def matches(a: str, b: str, window: int = WINDOW) -> Column:
    """Whether two revisions can belong to one changeset, by the struct columns a and b.

    With two commit ids these decide; with one, they don't match; else author, log and time.
    """
    x, y = F.col(a), F.col(b)
    return (
        F.when(x["commitid"].isNotNull() & y["commitid"].isNotNull(), x["commitid"] == y["commitid"])
        .when(x["commitid"].isNotNull() | y["commitid"].isNotNull(), False)
        .otherwise(time_close(x["t"], y["t"], window) & (x["author"] == y["author"]) & (x["log"] == y["log"]))
    )


def epochs(rows: DataFrame, keys: list[str], gap: int, order: str = "event_id") -> DataFrame:
    """Adds ``epoch``: how many gaps of ``gap`` seconds or more lie before the row."""
    rows = rows.withColumn("__day", day_of("t"))
    by_time = [F.col("t"), F.col(order)]
    rows = with_neighbour(rows, keys, "__day", by_time, {"__before": "t"})
    cut = F.when(F.col("t") - F.col("__before") >= gap, 1).otherwise(0).cast("long")
    return running(rows, keys, "__day", by_time, {"epoch": cut}).drop("__day", "__before")


def _streamed(rows: DataFrame, keys: list[str], order: list[Column], fold, schema: str) -> DataFrame:
    """Rows of each (key, epoch), in order, through ``fold``, a batch at a time."""
    placed = dealt(rows, [*keys, "epoch"]).sortWithinPartitions(*keys, "epoch", *order)
    return placed.mapInPandas(fold, schema)


def anchored_changesets(rows: DataFrame, keys: list[str], window: int = WINDOW) -> DataFrame:
    """Leaders among rows of one key: the newest, then the newest at least ``window`` older.

    Returns the keys, leader_t, leader_id (of the rows at that second, the largest id) and
    members, the rows newer than the next leader.
    """
    cut = epochs(rows, keys, window)
    types = dict(rows.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "leader_t long", "leader_id long", "members long"])
    columns = [*keys, "epoch"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None  # group, leader's time and id, members so far
        for pdf in batches:
            out = []
            for row in zip(*[pdf[c] for c in columns], pdf["t"], pdf["event_id"], strict=True):
                group, t, event = row[:-2], row[-2], row[-1]
                if state and state[0] == group and state[1] - t < window:
                    state[3] += 1
                else:
                    if state:
                        out.append((*state[0][:-1], *state[1:]))
                    state = [group, t, event, 1]
            yield pd.DataFrame(out, columns=[*keys, "leader_t", "leader_id", "members"])
        if state:
            yield pd.DataFrame([(*state[0][:-1], *state[1:])], columns=[*keys, "leader_t", "leader_id", "members"])

    return _streamed(cut.select(*columns, "t", "event_id"), keys, [F.desc("t"), F.desc("event_id")], fold, schema)


class Revision:
    """A file revision as the frontier holds it."""

    __slots__ = ("event_id", "t", "path", "author", "log", "commitid", "keeps_alive", "taken")

    def __init__(self, event_id, t, path, author, log, commitid, keeps_alive):
        self.event_id, self.t, self.path, self.author, self.log, self.commitid, self.keeps_alive, self.taken = event_id, t, path, author, log, commitid, keeps_alive, False

    @property
    def key(self) -> tuple:
        """Equal for revisions that belong together if they are close in time."""
        return (self.author, self.log) if self.commitid is None else (self.commitid,)

    @property
    def place(self) -> tuple:
        return -self.t, self.path, -self.event_id


class Frontier:
    """One branch's revisions, fed newest first; gives out (leader, members).

    A file takes part with its newest revision only, so just those, one per path, are found by
    their key: a leader looks at its members and no others, however dense the history.  ``oldest_live`` is the place of the branch's oldest
    revision that keeps the branch alive; ``first``: no changeset has been made yet.
    """

    def __init__(self, window: int, oldest_live: tuple | None, first: bool, held: list[Revision] = ()):
        self.window, self.oldest_live, self.first = window, oldest_live, first
        self.order: deque[Revision] = deque()
        self.newest: dict[tuple, list[Revision]] = {}
        self.by_path: dict[str, deque[Revision]] = {}
        self.live, self.last = 0, None
        for r in held:
            self.hold(r)

    def hold(self, r: Revision) -> None:
        self.order.append(r)
        mine = self.by_path.get(r.path)
        if mine is None:
            self.by_path[r.path] = deque((r,))
            self.newest.setdefault(r.key, []).append(r)
        else:
            mine.append(r)
        self.live += r.keeps_alive
        self.last = r.place

    def head(self) -> Revision | None:
        while self.order and self.order[0].taken:
            self.order.popleft()
        return self.order[0] if self.order else None

    def held(self) -> list[Revision]:
        return [r for r in self.order if not r.taken]

    def feed(self, r: Revision) -> Iterator[tuple]:
        while (leader := self.head()) and leader.t - r.t >= self.window:
            yield from self.lead(leader)
        self.hold(r)

    def finish(self) -> Iterator[tuple]:
        while leader := self.head():
            yield from self.lead(leader)

    def take(self, r: Revision) -> None:
        """Takes the newest revision of a path; the next one is then its newest."""
        r.taken = True
        self.live -= r.keeps_alive
        mine = self.by_path[r.path]
        mine.popleft()
        if mine:
            self.newest.setdefault(mine[0].key, []).append(mine[0])
        else:
            del self.by_path[r.path]

    def lead(self, leader: Revision) -> Iterator[tuple]:
        """All held revisions are within the window of the oldest held one's leader."""
        alive = self.first or self.live or (self.oldest_live is not None and self.oldest_live > self.last)
        self.first = False
        key = leader.key
        members = self.newest.pop(key)
        if not alive:
            if rest := [r for r in members if r is not leader]:
                self.newest[key] = rest
            members = [leader]
        for r in members:
            self.take(r)
        if alive:
            yield leader, members


def surviving(rows: DataFrame) -> DataFrame:
    """Without dead first revisions that others follow: they make no changeset.

    Adds keeps_alive: false for a dead revision without a parent.
    """
    first = rows.groupBy("branch", "path").agg(F.min(F.struct("t", "event_id")).alias("__first"), F.count(F.lit(1)).alias("__n"))
    rows = rows.join(first, ["branch", "path"]).withColumn("__root", F.col("event_id") == F.col("__first.event_id"))
    rows = rows.filter(~(F.col("__root") & F.col("dead") & (F.col("__n") > 1)))
    return rows.withColumn("keeps_alive", ~(F.col("__root") & F.col("dead"))).drop("__first", "__n", "__root")


#: Revisions in a chunk, how many windows of those before it warm it up, and how many chunks
#: a dense epoch has at least.
CHUNK, WARM, PARTS = 20_000, 64, 16
#: What a chunk gives out: members of changesets, revisions it leaves to the next chunk, and
#: digests of what was held where it begins and ends.
MEMBER, LEFT, SEAM = range(3)
STREAMED = ["event_id", "t", "path", "author", "log", "commitid", "keeps_alive"]
ASKED = ["branch", "epoch", "unit", "chunk", "part", "last", "first", "oldest", *STREAMED]


def chunked(rows: DataFrame, size: int, window: int) -> DataFrame:
    """Adds ``chunk``, runs of ``size`` revisions of a branch's epoch, newest first, and whether
    it is the epoch's ``last`` one.  Rows aren't sorted if no epoch has more than that.

    In a dense epoch so few revisions span too little time for a guess; there chunks grow to
    what lies in half of WARM windows, but no further than leaves PARTS of them.
    """
    order = [F.desc("t"), F.col("path"), F.desc("event_id")]
    n, span = F.count(F.lit(1)), F.max("t") - F.min("t") + 1
    dense = F.least(F.ceil(n * (WARM // 2 * window) / span), F.ceil(n / PARTS))
    total = rows.groupBy("branch", "epoch").agg(n.alias("n"), F.greatest(F.lit(size).cast("long"), dense).alias("size"))
    total = materialize(total.select("branch", "epoch", "size", F.floor((F.col("n") - 1) / F.col("size")).alias("last_chunk")))
    if not total.agg(F.max("last_chunk")).first()[0]:
        return rows.withColumns({"chunk": F.lit(0).cast("long"), "last": F.lit(True)})
    cut = numbered(rows, order, "place", ["branch", "epoch"]).join(total, ["branch", "epoch"])
    cut = cut.withColumn("chunk", F.floor((F.col("place") - 1) / F.col("size")))
    return cut.withColumn("last", F.col("chunk") == F.col("last_chunk")).drop("place", "size", "last_chunk")


def fed(rows: DataFrame, window: int) -> DataFrame:
    """The revisions of chunks, each after those of the chunk before it that lie within WARM
    windows: with these it guesses what is held where it begins."""
    starts = rows.groupBy("branch", "epoch", "chunk").agg(F.max("t").alias("start_t"), F.max("last").alias("last_"))
    warm = rows.withColumn("chunk", F.col("chunk") + 1).join(starts, ["branch", "epoch", "chunk"]).filter(F.col("t") < F.col("start_t") + WARM * window)
    warm = warm.withColumn("last", F.col("last_")).drop("start_t", "last_").withColumn("part", F.lit("warm"))
    both = rows.withColumn("part", F.lit("own")).unionByName(warm)
    return both.withColumn("first", F.col("first") & (F.col("chunk") == 0))


def chunk_folder(window: int):
    """Rows of chunks, in order, through frontiers: warm or given ones first, then own ones."""
    import pyarrow as pa

    names = ["branch", "epoch", "chunk"]
    given = ["kind", *names, "leader_id", "leader_t", "leader_author", "leader_log", "leader_commitid", "path", "event_id", "member_t", "begins", "ends"]
    types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64(), pa.string(), pa.string()]

    def state(frontier: Frontier) -> str:
        return ("first " if frontier.first else "later ") + hashlib.sha256(repr([r.event_id for r in frontier.held()]).encode()).hexdigest()

    def fold(batches: Iterator) -> Iterator:
        unit, group, frontier, begins, last, out = None, None, None, None, False, []

        def put(found, wanted: bool) -> None:
            for leader, members in found:
                if wanted:
                    head = (MEMBER, *group, leader.event_id, leader.t, leader.author, leader.log, leader.commitid)
                    out.extend((*head, m.path, m.event_id, m.t, None, None) for m in members)

        def ended() -> None:
            """The end of a chunk; the frontier may go on with the next one."""
            if last:
                put(frontier.finish(), True)
            out.extend((LEFT, *group, *[None] * 6, r.event_id, None, None, None) for r in frontier.held())
            out.append((SEAM, *group, *[None] * 8, begins, state(frontier)))

        def flushed():
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], given)

        for batch in batches:
            oldest = batch.column("oldest")  # a struct, read where a frontier begins and nowhere else
            for i, (branch, epoch, start, chunk, part, is_last, first, *row) in enumerate(zip(*[batch.column(c).to_pylist() for c in ASKED if c != "oldest"], strict=True)):
                if group != (branch, epoch, chunk) or unit != start:
                    if frontier:
                        ended()
                    if unit != start or group[:2] != (branch, epoch):
                        place = oldest[i].as_py()
                        frontier = Frontier(window, place and tuple(place.values()), first)
                    unit, group, last, begins = start, (branch, epoch, chunk), is_last, None
                revision = Revision(*row)
                if part == "given":
                    frontier.hold(revision)
                    continue
                if part == "own" and begins is None:
                    # what the sequential fold does between two chunks it does when it is fed on
                    begins = state(frontier)
                put(frontier.feed(revision), part == "own")
            yield flushed()
        if frontier:
            ended()
        yield flushed()

    return fold


FOLDED = "kind int, branch string, epoch long, chunk long, leader_id long, leader_t long, leader_author string, leader_log string, leader_commitid string, path string, event_id long, member_t long, begins string, ends string"


def folded(rows: DataFrame, window: int) -> DataFrame:
    """What the units, runs of chunks of a branch's epoch, give out."""
    order = [F.col("part") == "own", F.desc("t"), F.col("path"), F.desc("event_id")]
    placed = dealt(rows, ["branch", "epoch", "unit"]).sortWithinPartitions("branch", "epoch", "unit", *order)
    return materialize(placed.select(*ASKED).mapInArrow(chunk_folder(window), FOLDED))


def frontier_changesets(rows: DataFrame, window: int = WINDOW, prepared: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Membership (branch, leader_id, t, author, log, commitid, path, event_id, member_t).

    ``rows``: branch, path, event_id, t, author, log, commitid, dead.  A file takes part
    with its newest revision that isn't taken.  Ties in time go by path, then the larger id.
    ``prepared`` rows have keeps_alive and lack what ``surviving`` leaves out.

    What a leader takes depends on what the ones before it left.  Epochs start with nothing
    left; a longer one is cut into chunks of ``chunk`` revisions that are folded at once, each
    after guessing, from the revisions before it, what is held where it begins.  A chunk
    whose guess isn't what the chunk before it left is folded again with that, and with
    twice as many of those behind it in every round, until all agree; then the result is
    that of the sequential fold.
    """
    rows = rows if prepared else surviving(rows)
    cut = materialize(epochs(rows, ["branch"], window))
    place = F.struct((-F.col("t")).alias("t"), F.col("path").alias("path"), (-F.col("event_id")).alias("id"))
    ends = cut.groupBy("branch").agg(F.max("epoch").alias("newest"), F.max(F.when(F.col("keeps_alive"), place)).alias("oldest"))
    cut = cut.join(ends, "branch").withColumn("first", F.col("epoch") == F.col("newest"))
    cut = materialize(chunked(materialize(cut.select("branch", "epoch", "first", "oldest", *STREAMED)), chunk, window))
    keys, units = ["branch", "epoch", "chunk"], ["branch", "epoch", "unit"]
    found = folded(fed(cut, window).withColumn("unit", F.col("chunk")), window)
    span = 1
    while True:
        seams = found.filter(F.col("kind") == SEAM).select(*keys, "begins", "ends")
        before = seams.select("branch", "epoch", (F.col("chunk") + 1).alias("chunk"), F.col("ends").alias("left_over"))
        wrong = seams.join(before, keys).filter("begins != left_over").withColumn("block", F.floor(F.col("chunk") / span))
        start = F.min(F.struct("chunk", F.col("left_over").startswith("first").alias("first"))).alias("s")
        wrong = materialize(wrong.groupBy("branch", "epoch", "block").agg(start).select("branch", "epoch", "block", F.col("s.chunk").alias("unit"), F.col("s.first").alias("first")))
        if wrong.isEmpty():
            break
        # from what the chunk before it left, as it stands, a wrong one is folded with those behind it
        own = cut.drop("first").withColumn("block", F.floor(F.col("chunk") / span)).join(wrong, ["branch", "epoch", "block"]).filter("chunk >= unit").withColumn("part", F.lit("own"))
        flags = own.filter("chunk = unit").groupBy(*units).agg(F.max("last").alias("last"), F.max("first").alias("first"))
        left = found.filter(F.col("kind") == LEFT).select("branch", "epoch", (F.col("chunk") + 1).alias("unit"), "event_id").join(flags, units)
        given = left.join(cut.drop("chunk", "last", "first"), ["branch", "epoch", "event_id"]).withColumns({"part": F.lit("given"), "chunk": F.col("unit")})
        again = folded(own.drop("block").unionByName(given), window)
        redone = own.select(*keys).distinct()
        found = materialize(found.join(redone, keys, "left_anti").unionByName(again))
        span *= 2
    members = found.filter(F.col("kind") == MEMBER)
    return members.select("branch", "leader_id", F.col("leader_t").alias("t"), F.col("leader_author").alias("author"), F.col("leader_log").alias("log"), F.col("leader_commitid").alias("commitid"), "path", "event_id", "member_t")


def changesets_of(membership: DataFrame) -> DataFrame:
    """One row per changeset: branch, leader_id, t, author, log, commitid, files."""
    return membership.groupBy("branch", "leader_id").agg(*[F.first(c).alias(c) for c in ("t", "author", "log", "commitid")], F.count(F.lit(1)).alias("files"))


def commitid_changesets(rows: DataFrame) -> DataFrame:
    """Changesets of revisions with commit ids, when ids alone decide."""
    named = rows.filter(F.col("commitid").isNotNull())
    return named.groupBy("commitid").agg(F.count(F.lit(1)).alias("revisions"), F.countDistinct("path").alias("files"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
