"""Rendering a history: import stream, graph, revision map, author list.

Every renderer returns lines with their place, so a sink may sort and write them; nothing
passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revloom.functions import paths, revnum, text
from revloom.operators import forest
from revloom.operators.ordered import numbered
from revloom.operators.shared import materialize
from revloom.plans.history import History


def emission_order(history: History) -> DataFrame:
    """Changesets with ``place``, parents before children.

    By date, unless some parent is newer than its child or the options ask for speed;
    then branch by branch.
    """
    cs = history.changesets.join(history.branches.select(F.col("ref_name").alias("branch"), "branch_ord", "depth"), "branch")
    parents = cs.select(F.col("cs_id").alias("parent_cs"), F.col("t").alias("parent_t"))
    inverted = not cs.join(parents, "parent_cs").filter("parent_t > t").isEmpty()
    by_branch = ["branch_ord", "seq"]
    order = by_branch if history.options.fast or inverted else ["t", "depth", *by_branch]
    lets = history.branchlets.withColumn("branch", F.col("name")).withColumn("seq", F.lit(0).cast("long"))
    lets = lets.select("cs_id", "branch", "seq", "parent_cs", "t", "author", "log", F.lit(None).cast("string").alias("commitid"), F.lit(2**30).alias("branch_ord"), F.lit(2**30).alias("depth"))
    # a tag's own branch comes after everything that it could grow from
    both = cs.select("cs_id", "branch", "seq", "parent_cs", "t", "author", "log", "commitid", "branch_ord", "depth", F.lit(0).alias("late")).unionByName(lets.withColumn("late", F.lit(1)))
    return numbered(both, [F.col(c) for c in ("late", *order, "cs_id")], "place")


def operations(history: History) -> DataFrame:
    """File operations of all changesets, those of the tags' own branches included."""
    files = history.masters.files.select("master_id", F.col("fileop_path").alias("path"), "executable")
    at = history.branchlets.join(history.changesets.select(F.col("cs_id").alias("parent_cs"), "branch", "seq"), "parent_cs").select("cs_id", "branch", "seq")
    old = history.tree(at).withColumnRenamed("rev", "old_rev")
    both = history.branchlet_trees.join(old, ["cs_id", "master_id"], "full_outer").filter(~F.col("rev").eqNullSafe(F.col("old_rev")))
    both = both.withColumn("op", F.when(F.col("rev").isNull(), "D").otherwise("M")).join(files, "master_id")
    return history.fileops.unionByName(both.select("cs_id", "op", text.mode("executable").alias("mode"), "path", "master_id", "rev"))


def marked(history: History) -> tuple[DataFrame, DataFrame]:
    """(changesets with place and mark, blobs with master_id, number, place, sub and mark).

    A blob's mark comes just before the changeset that first uses it; with ``fast`` all
    blobs come first.
    """
    order = materialize(emission_order(history))
    ops = operations(history)
    uses = ops.filter("op = 'M'").join(order.select("cs_id", "place"), "cs_id").withColumn("sort", paths.deep_key("path"))
    first = uses.groupBy("master_id", revnum.render("rev").alias("number")).agg(F.min(F.struct("place", "sort")).alias("f"))
    place = F.lit(0) if history.options.fast else F.col("f.place")
    blobs = first.select("master_id", "number", place.alias("place"), F.lit(0).alias("kind"), F.struct("f.place", "f.sort", "number").alias("sub"))
    commits = order.select("cs_id", "place", F.lit(1).alias("kind"))
    every = numbered(blobs.unionByName(commits, allowMissingColumns=True), [F.col("place"), F.col("kind"), F.col("sub")], "mark")
    every = materialize(every)
    marks = every.filter("kind = 1").select("cs_id", "mark")
    return materialize(order.join(marks, "cs_id")), every.filter("kind = 0").select("master_id", "number", "place", "sub", "mark")


def author_columns(commits: DataFrame, authors: DataFrame | None) -> DataFrame:
    if authors is None:
        return commits.withColumn("full", F.col("author")).withColumn("email", F.col("author")).withColumn("zone", F.lit("UTC"))
    known = authors.select(F.col("name").alias("author"), F.col("full").alias("f"), F.col("email").alias("e"), F.col("zone").alias("z"))
    joined = commits.join(known, "author", "left")  # AQE broadcasts the map if it is small
    return joined.withColumn("full", F.coalesce("f", "author")).withColumn("email", F.coalesce("e", "author")).withColumn("zone", F.coalesce("z", F.lit("UTC"))).drop("f", "e", "z")


def sized(content: Column) -> Column:
    return F.concat(F.lit("data "), F.octet_length(content), F.lit("\n"), content)


#: What stands behind all commits.
LAST_PLACE = 2**31 - 1


def reported(history: History, commits: DataFrame) -> DataFrame:
    """``commits`` with their own and their parents' dates, those that the options ask for."""
    o = history.options
    marks = commits.select(F.col("cs_id").alias("parent_cs"), F.col("mark").alias("parent_mark"), F.col("t").alias("parent_t"))
    commits = commits.join(marks, "parent_cs", "left")
    seconds = text.forced_seconds("mark", o.window) if o.force_dates else F.col("t")
    parent_seconds = text.forced_seconds("parent_mark", o.window) if o.force_dates else F.col("parent_t")
    commits = commits.withColumn("seconds", seconds).withColumn("parent_seconds", parent_seconds)
    new = F.lit(True) if o.newer_than is None else F.col("seconds") > o.newer_than
    return commits.filter(new)


def references(history: History, commits: DataFrame) -> DataFrame:
    """The stream's lines that say where tags (kind 2) and branches (kind 3) are, by the marks
    of ``commits``; no text is replayed for them."""
    commits, remote = reported(history, commits), history.options.remote
    tags = history.tags.join(commits.select("cs_id", "place", "mark"), "cs_id")
    tag_rows = tags.select("place", F.lit(2).alias("kind"), F.row_number().over(Window.partitionBy("cs_id").orderBy("name")).alias("sub"), F.concat(F.lit("reset refs/tags/"), "name", F.lit("\nfrom :"), "mark", F.lit("\n\n")).cast("binary").alias("chunk"))
    tips = head_marks(history, commits)
    head_rows = tips.select(F.lit(LAST_PLACE).alias("place"), F.lit(3).alias("kind"), F.col("branch_ord").alias("sub"), F.concat(F.lit("reset "), text.branch_ref("ref_name", remote), F.lit("\nfrom :"), "mark", F.lit("\n\n")).cast("binary").alias("chunk"))
    return tag_rows.unionByName(head_rows)


def stream(history: History, authors: DataFrame | None = None) -> DataFrame:
    """The import stream as (place, sub, chunk), ``chunk`` being bytes; to be written in
    the order of place and sub."""
    o = history.options
    commits, blobs = marked(history)
    resets = references(history, commits)
    commits = reported(history, author_columns(commits, authors))
    blob_marks = blobs.select("master_id", "number", F.col("mark").alias("blob_mark"))
    ops = operations(history).withColumn("number", revnum.render("rev")).join(blob_marks, ["master_id", "number"], "left")
    line = F.when(F.col("op") == "M", F.concat(F.lit("M "), "mode", F.lit(" :"), "blob_mark", F.lit(" "), "path")).otherwise(F.concat(F.lit("D "), "path"))
    pair = F.when(F.col("op") == "M", F.concat("path", F.lit(" "), "number", F.lit("\n")))
    ops = ops.select("cs_id", F.struct(paths.deep_key("path").alias("k"), line.alias("line"), pair.alias("pair"), "path").alias("o"))
    listed = ops.groupBy("cs_id").agg(F.sort_array(F.collect_list("o")).alias("ops"))
    commits = commits.join(listed, "cs_id", "left").withColumn("ops", F.coalesce("ops", F.array().cast(listed.schema["ops"].dataType)))
    first = F.col("place") == F.lit(commits.agg(F.min("place")).first()[0])
    ignores = F.when(first & ~F.exists("ops", lambda x: x["path"] == ".gitignore"), F.concat(F.lit("M 100644 inline .gitignore\n"), sized(F.lit(text.DEFAULT_IGNORES)), F.lit("\n")))
    pairs = F.array_join(F.transform(F.filter("ops", lambda x: x["pair"].isNotNull()), lambda x: x["pair"]), "")
    log = F.col("log")
    if o.embed_ids:
        log = F.concat("log", F.lit("\n"), F.array_join(F.transform(F.filter("ops", lambda x: x["pair"].isNotNull()), lambda x: F.concat(F.lit("CVS-ID: "), x["pair"])), ""))
    branch = text.branch_ref("branch", o.remote)
    origin = F.when(F.col("parent_mark").isNotNull(), F.concat(F.lit("from :"), "parent_mark", F.lit("\n")))
    restart = F.lit(None).cast("string")
    if o.newer_than is not None:
        again = F.row_number().over(Window.partitionBy("branch").orderBy("place")) == 1
        restart = F.when(again & (F.col("parent_seconds") <= o.newer_than), F.concat(F.lit("from "), branch, F.lit("^0\n\n")))
    who = F.concat(F.lit("committer "), "full", F.lit(" <"), "email", F.lit("> "), text.author_stamp(F.timestamp_seconds("seconds"), F.col("zone")), F.lit("\n"))
    changes = F.array_join(F.transform("ops", lambda x: F.concat(x["line"], F.lit("\n"))), "")
    prop = F.when((F.lit(o.properties)) & (pairs != ""), F.concat(F.lit("property cvs-revision "), F.octet_length(pairs), F.lit(" "), pairs))
    body = F.concat(F.coalesce(restart, F.lit("")), F.lit("commit "), branch, F.lit("\nmark :"), "mark", F.lit("\n"), who, sized(log), F.lit("\n"), F.coalesce(origin, F.lit("")), changes, F.coalesce(ignores, F.lit("")), F.coalesce(prop, F.lit("")), F.lit("\n"))
    commit_rows = commits.select("place", F.lit(1).alias("kind"), F.col("mark").alias("sub"), body.cast("binary").alias("chunk"))
    used, wanted = blobs, None
    if o.newer_than is not None:  # only what later commits use is replayed
        used = materialize(blobs.join(commits.select(F.col("place").alias("p")), F.col("p") == F.col("sub.place"), "left_semi"))
        wanted = used.select("master_id", "number")
    content = used.join(history.blobs(wanted), ["master_id", "number"])
    root_ignore = history.masters.files.filter("fileop_path = '.gitignore'").select("master_id", F.lit(True).alias("is_root_ignore"))
    content = content.join(root_ignore, "master_id", "left")
    data = F.when(F.col("is_root_ignore"), F.concat(F.lit(text.DEFAULT_IGNORES).cast("binary"), F.col("content"))).otherwise(F.col("content"))
    blob = F.concat(F.concat(F.lit("blob\nmark :"), "mark", F.lit("\ndata "), F.octet_length(data), F.lit("\n")).cast("binary"), data, F.lit("\n").cast("binary"))
    blob_rows = content.select("place", F.lit(0).alias("kind"), F.col("mark").alias("sub"), blob.alias("chunk"))
    end = F.lit(LAST_PLACE)
    done = history.branches.sparkSession.range(1).select(end.alias("place"), F.lit(4).alias("kind"), F.lit(0).alias("sub"), F.lit("done\n").cast("binary").alias("chunk"))
    rows = [x.select("place", "kind", F.col("sub").cast("long").alias("sub"), "chunk") for x in (blob_rows, commit_rows, resets, done)]
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    return out


def head_marks(history: History, commits: DataFrame) -> DataFrame:
    """ref_name, branch_ord, mark: where each branch ends; one without changesets ends where
    it joins its parent."""
    last = commits.groupBy(F.col("branch").alias("ref_name")).agg(F.max_by("mark", "seq").alias("mark"))
    joined = history.joins.join(commits.select(F.col("cs_id").alias("join_cs"), F.col("mark").alias("join_mark")), "join_cs").select(F.col("branch").alias("ref_name"), "join_mark")
    refs = history.branches.select("ref_name", F.col("branch_ord").cast("long").alias("branch_ord")).unionByName(history.branchlets.select(F.col("name").alias("ref_name"), F.lit(2**30).cast("long").alias("branch_ord")))
    found = refs.join(last, "ref_name", "left").join(joined, "ref_name", "left")
    return found.select("ref_name", "branch_ord", F.coalesce("mark", "join_mark").alias("mark")).filter("mark is not null")


def write_stream(chunks: DataFrame, folder: str) -> None:
    """Write a stream as files whose names sort in stream order; joined, they are the stream.

    A range sort, so no task holds the whole; each task writes one file of raw bytes.
    """
    ordered = chunks.orderBy("place", "kind", "sub")
    # every chunk ends a line, and the writer ends lines; the cast keeps the bytes as they are
    ordered.select(F.substring("chunk", F.lit(1), F.octet_length("chunk") - 1).cast("string").alias("value")).write.text(folder)


def revision_map(history: History) -> DataFrame:
    """``file revision :mark`` lines."""
    commits, _ = marked(history)
    ops = operations(history).filter("op = 'M'").join(commits.select("cs_id", "mark"), "cs_id")
    return ops.select("mark", "path", F.concat(revnum.label("path", "rev"), F.lit(" :"), "mark").alias("line"))


def graph(history: History, title: str | None = None) -> DataFrame:
    """(sub, line) of a DOT digraph of changesets, branches and tags."""
    cs = history.changesets
    label = F.concat_ws("\\n", "branch", text.rfc3339(F.timestamp_seconds("t")), text.log_label("log"), F.hex("cs_id"))
    nodes = cs.select("cs_id", F.concat(F.lit('"'), label, F.lit('"')).alias("node"), "branch", "seq", "parent_cs")
    above = nodes.select(F.col("cs_id").alias("parent_cs"), F.col("node").alias("parent_node"))
    weight = F.when(F.col("seq") > 0, " [weight=10];").otherwise("")
    edges = nodes.join(above, "parent_cs").select(F.lit(3).alias("part"), F.concat(F.lit("\t"), "node", F.lit(" -> "), "parent_node", weight).alias("line"))
    head = f"{title}\\n" if title else ""
    last = cs.groupBy("branch").agg(F.max_by("cs_id", "seq").alias("cs_id")).join(nodes.select("cs_id", "node"), "cs_id")
    named = forest.path_names(history.branches.select(F.col("ref_name").alias("node"), F.col("parent_ref").alias("parent")), F.col("node"))
    last = last.join(named.withColumnRenamed("node", "branch"), "branch")
    refs = last.select(F.concat(F.lit(f'\t"{head}'), "label", F.lit('"')).alias("ref"), "node", F.lit("ellipse").alias("shape"), F.lit(" [weight=100];").alias("w"))
    named = history.tags.groupBy("cs_id").agg(F.array_join(F.sort_array(F.collect_list("name")), "\\n").alias("names")).join(nodes.select("cs_id", "node"), "cs_id")
    tags = named.select(F.concat(F.lit(f'\t"{head}'), "names", F.lit('"')).alias("ref"), "node", F.lit("diamond").alias("shape"), F.lit(" [weight=3];").alias("w"))
    both = refs.unionByName(tags)
    shapes = both.select(F.lit(1).alias("part"), F.concat("ref", F.lit(" [fontsize=6,fixedsize=false,shape="), "shape", F.lit("];")).alias("line"))
    links = both.select(F.lit(2).alias("part"), F.concat("ref", F.lit(" -> "), "node", "w").alias("line"))
    spark = cs.sparkSession
    frame = spark.createDataFrame([(0, "digraph G {\nnodesep=0.1;\nranksep=0.1;\nedge [dir=none];\nnode [shape=box,fontsize=6];"), (4, "}")], "part int, line string")
    return frame.unionByName(shapes).unionByName(links).unionByName(edges)


def problems(history: History) -> DataFrame:
    """(kind, subject, detail): what a conversion warns of."""
    r = history.revisions
    m = history.masters
    skew = m.deltas.join(r.select("master_id", "rev", F.col("t").alias("new_t")), ["master_id", "rev"]).filter("t != new_t")
    out = m.problems.select(F.lit("unreadable").alias("kind"), F.col("path").alias("subject"), F.col("problem").alias("detail"))
    out = out.unionByName(skew.select(F.lit("date repaired"), "fileop_path", revnum.render("rev")).toDF("kind", "subject", "detail"))
    odd = m.symbols.filter(F.size("rev") % 2 == 1).select(F.lit("symbol names no branch by itself"), "name", revnum.render("rev")).toDF("kind", "subject", "detail")
    kept = r.select("master_id", "rev")
    gone = m.deltas.join(kept, ["master_id", "rev"], "left_anti").select(F.lit("dead unnamed branch left out"), "fileop_path", revnum.render("rev")).toDF("kind", "subject", "detail")
    lets = history.branchlets.select(F.lit("tag is on no tree"), "name", F.lit("it got a branch of its own")).toDF("kind", "subject", "detail")
    depth = m.deltas.filter(F.size("rev") % 2 == 1).select(F.lit("revision number of odd depth"), "fileop_path", revnum.render("rev")).toDF("kind", "subject", "detail")
    cs = history.changesets
    older = cs.join(cs.select(F.col("cs_id").alias("parent_cs"), F.col("t").alias("parent_t")), "parent_cs").filter("t < parent_t")
    older = older.select(F.lit("changeset older than its parent"), "branch", F.col("seq").cast("string")).toDF("kind", "subject", "detail")
    for rows in (odd, gone, lets, depth, older):
        out = out.unionByName(rows)
    return out


def statistics(history: History) -> DataFrame:
    """(name, value): sizes of a conversion, and the seconds that each of its phases took."""
    m, spark = history.masters, history.branches.sparkSession
    counted = {"files": m.files, "deltas": m.deltas, "revisions": history.revisions, "changesets": history.changesets, "branches": history.branches, "tags": history.tags, "synthetic branches": history.branchlets, "file operations": history.fileops}
    took = spark.createDataFrame([(f"seconds: {k}", v) for k, v in history.phases.items()], "name string, value double")
    for name, rows in counted.items():
        took = took.unionByName(rows.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(name).alias("name"), "value"))
    return took
