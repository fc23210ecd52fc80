"""From parsed masters to changesets, branches, trees, tags and file operations."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revloom.functions import paths, revnum, text
from revloom.operators import branches, changesets, filetrees, forest, replay, tags
from revloom.operators.shared import materialize
from revloom.sources.masters import Masters

TAGGER = "revloom"


@dataclass(frozen=True)
class Options:
    """What a conversion may be told."""

    window: int = 300
    keywords: str | None = None  # kv, kvl, k, v, o or b for all files
    force_dates: bool = False
    newer_than: int | None = None  # Unix seconds: only what comes later is reported
    remote: str | None = None
    fast: bool = False  # branch by branch instead of by date
    embed_ids: bool = False
    properties: bool = False
    tagger: str = TAGGER
    root: str | None = None  # the folder that the masters' paths start from, for keywords with whole paths

    def __post_init__(self):
        if self.embed_ids and self.properties:
            raise ValueError("ids can be embedded or given as properties, not both")


class History:
    """A converted collection of masters, as lazy tables.

    revisions   file revisions with branch, parent and repaired date
    heads       each file's entry on each branch
    branches    ref_name, parent_ref, depth, branch_ord
    membership  branch, leader_id, event_id (a revision), its changeset
    changesets  cs_id, branch, seq, parent_cs, t, author, log, commitid
    intervals   branch, master_id, rev, from_seq, to_seq (exclusive)
    fileops     cs_id, op, master_id, path, rev
    tags        name, cs_id, synthetic
    phases      seconds that each phase took
    """

    def __init__(self, masters: Masters, options: Options | None = None):
        # every table is computed once and read by several others: each is a checkpoint
        self.masters, self.options = masters, options or Options()
        self.phases: dict[str, float] = {}  # seconds
        with self._phase("file trees"):
            self.revisions = materialize(filetrees.file_revisions(masters.deltas, masters.symbols)).withColumn("event_id", F.xxhash64("master_id", revnum.render("rev")))
            self.heads = materialize(filetrees.branch_heads(self.revisions, masters.symbols))
            self.branches = materialize(self._branches())
        with self._phase("changesets"):
            self.membership = materialize(self._membership())
            self._own = materialize(self._numbered())
        with self._phase("joins"):
            self._place()
            self.changesets = materialize(self._joined())
        with self._phase("trees"):
            self.intervals = materialize(self._intervals())
            self.fileops = materialize(self._fileops())
        with self._phase("tags"):
            self.tags, self.branchlets = self._tags()

    @contextmanager
    def _phase(self, name: str) -> Iterator[None]:
        began = time.monotonic()
        yield
        self.phases[name] = time.monotonic() - began

    def _branches(self) -> DataFrame:
        parents = branches.parents_over_masters(self.heads.filter(F.col("parent_ref") != F.col("ref_name"))).withColumnRenamed("parent_ref", "p")
        names = self.heads.select("ref_name").distinct().join(parents, "ref_name", "left")
        known = names.select(F.col("ref_name").alias("p")).withColumn("is_known", F.lit(True))
        names = names.join(known, "p", "left").select("ref_name", F.when(F.col("is_known"), F.col("p")).alias("parent_ref"))
        depth = forest.depths(names.select(F.col("ref_name").alias("node"), F.col("parent_ref").alias("parent"))).withColumnRenamed("node", "ref_name")
        placed = names.join(depth, "ref_name")
        return placed.withColumn("branch_ord", F.row_number().over(Window.orderBy("depth", F.col("ref_name") != "master", "ref_name")))

    def _membership(self) -> DataFrame:
        r = self.revisions
        first = r.groupBy("branch", "master_id").agg(F.min("rev").alias("first_rev"), F.count(F.lit(1)).alias("n"))
        r = r.join(first, ["branch", "master_id"]).withColumn("is_first", F.col("rev") == F.col("first_rev"))
        orphan = F.col("parent_rev").isNull()
        placeholder = F.col("is_first") & F.col("dead") & (F.col("n") > 1) & (orphan | (F.col("t") == F.col("parent_t")))
        self._placeholders = materialize(r.filter(placeholder).select("event_id"))
        rows = r.join(self._placeholders, "event_id", "left_anti").withColumn("keeps_alive", ~(F.col("dead") & orphan)).withColumn("path", paths.deep_key("fileop_path"))
        return changesets.frontier_changesets(rows.select("branch", "path", "event_id", "t", "author", "log", "commitid", "dead", "keeps_alive"), self.options.window, prepared=True)

    def _numbered(self) -> DataFrame:
        """Changesets with their place on their branch, oldest first."""
        own = changesets.changesets_of(self.membership)
        order = Window.partitionBy("branch").orderBy("t", "leader_id")
        return own.withColumn("seq", (F.row_number().over(order) - 1).cast("long")).withColumn("cs_id", F.xxhash64("branch", "leader_id"))

    def _place(self) -> None:
        """Revisions with their changesets, and what each branch takes over where it begins."""
        placed = self.membership.select("branch", "leader_id", "event_id").join(self._own.select("branch", "leader_id", "seq", "cs_id"), ["branch", "leader_id"])
        self._placed = materialize(placed.join(self.revisions.select("event_id", "master_id", "rev", "dead", F.col("t").alias("rev_t")), "event_id"))
        birth = self._own.groupBy(F.col("branch")).agg(F.min("t").alias("birth"), F.max("seq").alias("last_seq"))
        # a dead placeholder stands for a file that the branch's point doesn't have
        grown = self.revisions.filter("root and parent_rev is not null").join(self._placeholders, "event_id", "left_anti").select("branch", "master_id", F.col("parent_rev").alias("rev"))
        idle = self.heads.filter("not own").select(F.col("ref_name").alias("branch"), "master_id", "rev")
        base = self.revisions.select("master_id", "rev", F.col("dead").alias("base_dead"), F.col("t").alias("base_t"), F.col("branch").alias("base_branch"), F.col("author").alias("base_author"), F.col("log").alias("base_log"), F.col("commitid").alias("base_commitid"), F.col("event_id").alias("base_event"))
        inherited = grown.unionByName(idle).join(base, ["master_id", "rev"]).filter(~F.col("base_dead")).join(birth, "branch", "left")
        self._inherited = materialize(inherited.filter(F.col("birth").isNull() | (F.col("base_t") <= F.col("birth"))))

    def _intervals(self) -> DataFrame:
        chain = Window.partitionBy("branch", "master_id").orderBy("seq")
        own = self._placed.withColumn("to_seq", F.lead("seq").over(chain))
        first = self._placed.groupBy("branch", "master_id").agg(F.min("seq").alias("first_seq"))
        begins = self.changesets.groupBy("branch").agg(F.min("seq").alias("from_seq"))
        inherited = self._inherited.join(begins, "branch").join(first, ["branch", "master_id"], "left").filter(F.coalesce(F.col("first_seq") > F.col("from_seq"), F.lit(True)))
        inherited = inherited.select("branch", "master_id", "rev", "from_seq", F.col("first_seq").alias("to_seq"))
        own = own.filter(~F.col("dead")).select("branch", "master_id", "rev", F.col("seq").alias("from_seq"), "to_seq")
        return own.unionByName(inherited)

    def _join_points(self) -> DataFrame:
        """branch, join_cs, how: where branches that take something over join others.

        The newest revision taken over decides: its branch joins the newest changeset of the
        parent branch that matches it (``match``); else the one that holds it, if that is on a
        branch further up (``holder``); else the parent's newest one of its date or before
        (``date``); and if there is none either, the branch gets a root of its own (``root``).
        """
        newest = F.max(F.struct("base_t", "rev", "base_event", "base_branch", "base_author", "base_log", "base_commitid"))
        above = forest.climbed(self.branches.select(F.col("ref_name").alias("node"), F.col("parent_ref").alias("parent")), {"above": (F.array("node"), lambda near, far: F.concat(near, far))})
        asked = self._inherited.groupBy("branch").agg(newest.alias("b"))
        asked = asked.join(self.branches.select(F.col("ref_name").alias("branch"), "parent_ref"), "branch").select("branch", "parent_ref", "b.*")
        asked = materialize(asked.join(above.withColumnRenamed("node", "branch"), "branch"))
        on_parent = self._own.select(F.col("branch").alias("parent_ref"), "t", "seq", "author", "log", "commitid", F.col("cs_id").alias("p_cs"))
        by_id = asked.join(on_parent, (asked.parent_ref == on_parent.parent_ref) & (asked.base_commitid == on_parent.commitid)).groupBy("branch").agg(F.max_by("p_cs", "seq").alias("match_cs"))
        bare = asked.filter("base_commitid is null").select("branch", "parent_ref", F.col("base_author").alias("author"), F.col("base_log").alias("log"), F.col("base_t").alias("t"))
        by_log = branches.newest_match(bare, on_parent.filter("commitid is null"), ["parent_ref", "author", "log"], self.options.window, "branch", "p_cs").select("branch", F.col("found_id").alias("match_cs"))
        held = self._placed.select(F.col("event_id").alias("base_event"), F.col("branch").alias("base_branch"), F.col("cs_id").alias("holder_cs"))
        dated = branches.as_of_backward(asked.select("branch", "parent_ref", F.col("base_t").alias("t"), F.lit(0).cast("long").alias("seq")), on_parent, ["parent_ref"], ["p_cs"], "seq").select("branch", F.col("p_cs").alias("date_cs"))
        found = asked.join(by_id.unionByName(by_log), "branch", "left").join(held, ["base_event", "base_branch"], "left").join(dated, "branch", "left")
        holder = F.when(F.array_contains("above", F.col("base_branch")) & (F.col("base_branch") != F.col("branch")), F.col("holder_cs"))
        how = F.when(F.col("match_cs").isNotNull(), "match").when(holder.isNotNull(), "holder").when(F.col("date_cs").isNotNull(), "date").otherwise("root")
        root = F.xxhash64(F.lit("root"), "branch")
        columns = [F.coalesce("match_cs", holder, "date_cs", root).alias("join_cs"), how.alias("how"), *[F.col(f"base_{c}").alias(c) for c in ("t", "author", "log", "commitid")]]
        return found.select("branch", *columns)

    def _joined(self) -> DataFrame:
        """Changesets with parents: before them on their branch, or where the branch joins; a
        branch's own root, which adopts the files it takes over, stands at -1."""
        self.joins = joins = materialize(self._join_points())
        chain = Window.partitionBy("branch").orderBy("seq")
        own = self._own.withColumn("before", F.lag("cs_id").over(chain)).join(joins.select("branch", "join_cs"), "branch", "left")
        own = own.select("cs_id", "branch", "seq", F.when(F.col("seq") > 0, F.col("before")).otherwise(F.col("join_cs")).alias("parent_cs"), "t", "author", "log", "commitid")
        # a root of a branch without changesets has nothing to be the root of
        rooted = joins.filter("how = 'root'").join(self._own.select("branch").distinct(), "branch", "left_semi")
        return own.unionByName(rooted.select(F.col("join_cs").alias("cs_id"), "branch", F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("long").alias("parent_cs"), "t", "author", "log", "commitid"))

    def tree(self, changeset: DataFrame) -> DataFrame:
        """(cs_id, master_id, rev) for ``changeset`` (cs_id, branch, seq)."""
        i = self.intervals
        return changeset.join(i, "branch").filter((F.col("from_seq") <= F.col("seq")) & (F.col("to_seq").isNull() | (F.col("seq") < F.col("to_seq")))).select("cs_id", "master_id", "rev")

    def _fileops(self) -> DataFrame:
        """Interval starts and ends; a branch's first tree against the tree it joins."""
        first = self.changesets.groupBy("branch").agg(F.min("seq").alias("first"))
        every = materialize(self.changesets.join(first, "branch").withColumn("is_first", F.col("seq") == F.col("first")))
        at = every.filter("not is_first").select("branch", "seq", "cs_id")
        starts = self.intervals.select("branch", F.col("from_seq").alias("seq"), "master_id", "rev", F.lit("M").alias("op"))
        again = self.intervals.select("branch", F.col("from_seq").alias("seq"), "master_id")
        ends = self.intervals.filter("to_seq is not null").select("branch", F.col("to_seq").alias("seq"), "master_id").join(again, ["branch", "seq", "master_id"], "left_anti")
        ends = ends.withColumn("rev", F.lit(None).cast("array<int>")).withColumn("op", F.lit("D"))
        later = starts.unionByName(ends).join(at, ["branch", "seq"]).select("cs_id", "master_id", "rev", "op")
        roots = every.filter("is_first").select("cs_id", "parent_cs")
        new = self.tree(every.filter("is_first").select("cs_id", "branch", "seq"))
        below = roots.join(self.changesets.select(F.col("cs_id").alias("parent_cs"), "branch", "seq"), "parent_cs")
        old = self.tree(below.select("cs_id", "branch", "seq")).withColumnRenamed("rev", "old_rev")
        both = new.join(old, ["cs_id", "master_id"], "full_outer").filter(~F.col("rev").eqNullSafe(F.col("old_rev")))
        first = both.select("cs_id", "master_id", "rev", F.when(F.col("rev").isNull(), "D").otherwise("M").alias("op"))
        files = self.masters.files.select("master_id", F.col("fileop_path").alias("path"), "executable")
        return later.unionByName(first).join(files, "master_id").select("cs_id", "op", text.mode("executable").alias("mode"), "path", "master_id", "rev")

    def _tags(self) -> tuple[DataFrame, DataFrame]:
        """Tags on trees that equal them, and one-changeset branches for the others."""
        members = filetrees.file_tags(self.revisions, self.masters.symbols)
        live = members.filter("not dead")
        newest = live.groupBy("name").agg(F.max(F.struct("t", F.col("rev"), F.col("master_id").alias("m"))).alias("c"))
        newest = newest.select("name", F.col("c.m").alias("master_id"), F.col("c.rev").alias("rev"), F.col("c.t").alias("c_t"))
        at = self._placed.select("master_id", "rev", "cs_id", F.col("branch").alias("g_branch"), F.col("seq").alias("g_seq"))
        newest = newest.join(at, ["master_id", "rev"]).select("name", "c_t", F.col("cs_id").alias("g_cs"), "g_branch", "g_seq")
        label = F.concat_ws(":", F.col("master_id").cast("string"), revnum.render(tags.normalised_revision(F.col("rev"))))
        wanted = tags.set_prints(members.withColumn("member", label), "name", "member")
        # the trees of a branch change by their file operations: running sums of member hashes are their prints
        member = F.struct(F.xxhash64(label).alias("x"), F.xxhash64(F.lit(7), label).cast("decimal(38,0)").alias("y"))
        marks = self.intervals.withColumn("h", member)
        plus = marks.select("branch", F.col("from_seq").alias("seq"), F.lit(1).alias("n"), F.col("h.x").alias("x"), F.col("h.y").alias("y"))
        minus = marks.filter("to_seq is not null").select("branch", F.col("to_seq").alias("seq"), F.lit(-1).alias("n"), F.col("h.x").alias("x"), (-F.col("h.y")).alias("y"))
        steps = plus.unionByName(minus).groupBy("branch", "seq").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("y").alias("y"))
        every = self.changesets.select("branch", "seq", "cs_id", "t").join(steps, ["branch", "seq"], "left")
        upto = Window.partitionBy("branch").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        prints = every.select("branch", "seq", "cs_id", "t", F.sum("n").over(upto).alias("size"), F.bit_xor("x").over(upto).alias("f1"), F.sum("y").over(upto).cast("decimal(38,0)").alias("f2"))
        found = newest.join(wanted.withColumn("f2", F.col("f2").cast("decimal(38,0)")), "name").join(prints, ["size", "f1", "f2"])
        found = found.join(self.branches.select(F.col("ref_name").alias("branch"), "branch_ord"), "branch")
        at_g = F.col("cs_id") == F.col("g_cs")
        later = (F.col("t") >= F.col("c_t")) & ~((F.col("branch") == F.col("g_branch")) & (F.col("seq") < F.col("g_seq")))
        best = F.min(F.struct((~at_g).alias("far"), F.col("branch_ord"), (-F.col("seq")).alias("s"), F.col("cs_id").alias("cs_id"))).alias("b")
        placed = materialize(found.filter(at_g | later).groupBy("name").agg(best).select("name", F.col("b.cs_id").alias("cs_id")))
        lost = newest.join(placed, "name", "left_anti")
        log = F.concat(F.lit("Synthetic commit for tag "), "name")
        lets = lost.select("name", F.xxhash64(F.lit("tag"), "name").alias("cs_id"), F.col("g_cs").alias("parent_cs"), F.col("c_t").alias("t"), F.lit(self.options.tagger).alias("author"), log.alias("log"))
        lets = materialize(lets)
        self.branchlet_trees = lets.select("name", "cs_id").join(live, "name").select("cs_id", "master_id", "rev")
        return placed.withColumn("synthetic", F.lit(False)), lets

    def blobs(self, wanted: DataFrame | None = None) -> DataFrame:
        """(master_id, number, content) of all live revisions, or of those that are ``wanted``."""
        files = self.masters.files.select("master_id", text.resolved_mode("expand", self.options.keywords).alias("mode"), paths.absolute("path", self.options.root).alias("path") if self.options.root is not None else F.col("path"))
        texts = self.masters.deltas.select("master_id", "rev", "edit_text")
        rows = self.revisions.join(texts, ["master_id", "rev"]).select("master_id", revnum.render("rev").alias("number"), "edit_text", "dead", "t", "author", "state", "log")
        return replay.snapshots(rows.join(files, "master_id"), wanted)

    def authors(self) -> DataFrame:
        """author and place, in order of first changeset."""
        first = self.changesets.groupBy("author").agg(F.min(F.struct("t", "cs_id")).alias("f"))
        return first.select("author", F.row_number().over(Window.orderBy("f")).alias("place"))
