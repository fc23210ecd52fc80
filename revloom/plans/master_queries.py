"""Queries through the whole conversion: conversations written as masters, then read, grouped
into changesets, and rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revloom.functions import revnum, text
from revloom.operators import filetrees, orders, replay
from revloom.plans import emit
from revloom.plans.catalogue import query
from revloom.plans.history import History
from revloom.sources import reduction
from revloom.sources.masters import Masters
from revloom.sources.revision_log import table

#: The revisions in SQL: four conversations at a time are worked on together, a turn each on
#: the trunk; every other one has a branch from its first turn.
REVISIONS = """
n AS (SELECT conv_id, conv_id // 4 AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, role, replace(coalesce(text, ''), ' ', chr(10)) || chr(10) AS body FROM conversations),
revs AS (SELECT 'c' || conv_id || '.txt' AS path, '1.' || k AS number, 'master' AS branch, 1000000000 + g * 40000 + k * 400 + conv_id % 4 * 20 AS t, 'a' || g % 7 AS author, coalesce(role, '') || chr(10) AS log,
    k % 5 <> 0 AS live, CASE WHEN conv_id % 3 = 0 THEN 'id' || g || 'x' || k END AS commitid, body, g, k FROM n
  UNION ALL SELECT 'c' || conv_id || '.txt', '1.1.2.1', 'BR', 1000000000 + g * 40000 + 20000 + conv_id % 4 * 20, 'b', 'on branch' || chr(10), true, NULL, body || 'branched' || chr(10), g, 0 FROM n WHERE k = 1 AND conv_id % 2 = 0),
sets AS (SELECT *, max({'t': t, 'log': log}) OVER (PARTITION BY branch, g, k, coalesce(commitid, log)) AS lead FROM revs)"""


def conversation_masters(spark: SparkSession, sf_dir: str, symbols: Column | None = None) -> DataFrame:
    """(path, content): a master per conversation, its turns as trunk revisions, a word to a line.

    ``symbols`` adds to each file's symbols: an expression over conv_id, group and tip, its
    newest trunk revision.
    """
    turns = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("k", F.row_number().over(turns))
    body = F.concat(F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit("\n")), F.lit("\n"))
    rows = rows.withColumn("body", body).withColumn("lines", F.length("body") - F.length(F.replace("body", F.lit("\n"), F.lit(""))))
    rows = rows.withColumn("above", F.lead("lines").over(turns)).withColumn("g", F.floor(F.col("conv_id") / 4))
    rows = rows.withColumn("base", 1_000_000_000 + F.col("g") * 40_000 + F.col("conv_id") % 4 * 20).withColumn("grows", F.col("conv_id") % 2 == 0)

    def header(number, seconds, author, state, branches, after, commitid):
        date = F.date_format(F.timestamp_seconds(seconds), "yyyy.MM.dd.HH.mm.ss")
        return F.concat(number, F.lit("\ndate\t"), date, F.lit(";\tauthor "), author, F.lit(";\tstate "), state, F.lit(";\nbranches"), branches, F.lit(";\nnext\t"), after, F.lit(";\n"), commitid, F.lit("\n"))

    def body_of(number, log, edit):
        return F.concat(F.lit("\n"), number, F.lit("\nlog\n@"), text.at_escaped(log), F.lit("\n@\ntext\n@"), text.at_escaped(edit), F.lit("@\n"))

    number = F.concat(F.lit("1."), "k")
    commitid = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("commitid\tid"), "g", F.lit("x"), "k", F.lit(";\n"))).otherwise("")
    head = header(number, F.col("base") + F.col("k") * 400, F.concat(F.lit("a"), F.col("g") % 7), F.when(F.col("k") % 5 == 0, "dead").otherwise("Exp"), F.when((F.col("k") == 1) & F.col("grows"), "\n\t1.1.2.1").otherwise(""), F.when(F.col("k") > 1, F.concat(F.lit("1."), F.col("k") - 1)).otherwise(""), commitid)
    # a version replaces all lines of the next one
    edit = F.when(F.col("above").isNull(), F.col("body")).otherwise(F.concat(F.lit("d1 "), "above", F.lit("\na"), "above", F.lit(" "), "lines", F.lit("\n"), "body"))
    rows = rows.select("conv_id", "k", "grows", head.alias("head"), body_of(number, F.coalesce("role", F.lit("")), edit).alias("tail"), header(F.lit("1.1.2.1"), F.col("base") + 20_000, F.lit("b"), F.lit("Exp"), F.lit(""), F.lit(""), F.lit("")).alias("branch_head"), body_of(F.lit("1.1.2.1"), F.lit("on branch"), F.concat(F.lit("a"), "lines", F.lit(" 1\nbranched\n"))).alias("branch_tail"))
    rows = rows.withColumns({c: F.when(F.col("grows"), F.col(c)).otherwise("") for c in ("branch_head", "branch_tail")})
    files = rows.groupBy("conv_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("k", "head", "tail", "branch_head", "branch_tail")))).alias("r"))
    files = files.withColumns({"group": F.floor(F.col("conv_id") / 4), "tip": F.size("r")})
    first = F.element_at("r", -1)
    joined = lambda field: F.array_join(F.transform("r", lambda x: x[field]), "")
    admin = F.concat(F.lit("head\t1."), F.size("r"), F.lit(";\naccess;\nsymbols"), F.when(F.col("conv_id") % 2 == 0, "\n\tBR:1.1.0.2").otherwise(""), F.lit("") if symbols is None else symbols, F.lit(";\nlocks; strict;\ncomment\t@# @;\n\n\n"))
    content = F.concat(admin, joined("head"), first["branch_head"], F.lit("\n\ndesc\n@@\n"), joined("tail"), first["branch_tail"])
    return files.select(F.concat(F.lit("m/c"), "conv_id", F.lit(".txt,v")).alias("path"), F.encode(content, "UTF-8").alias("content"))


def masters_of(spark: SparkSession, sf_dir: str) -> Masters:
    return Masters(conversation_masters(spark, sf_dir), "m/")


@query(f"WITH {REVISIONS} SELECT path, number, t, author, NOT live AS dead, commitid, log FROM revs")
def master_deltas(spark, sf_dir):
    """What the reader finds in the masters."""
    return masters_of(spark, sf_dir).deltas.select(F.col("fileop_path").alias("path"), revnum.render("rev").alias("number"), "t", "author", "dead", "commitid", "log")


@query(f"WITH {REVISIONS} SELECT path, number, md5(body) AS content FROM revs WHERE live")
def master_contents(spark, sf_dir):
    """Contents of all live revisions, those on the branch included, by replay of the deltas."""
    masters = masters_of(spark, sf_dir)
    rows = masters.deltas.select("master_id", revnum.render("rev").alias("number"), "edit_text", "dead", F.lit("b").alias("mode"))
    return replay.snapshots(rows).join(masters.files.select("master_id", F.col("fileop_path").alias("path")), "master_id").select("path", "number", F.md5("content").alias("content"))


#: Files whose revisions are later than this are wanted by an incremental conversion.
CUTOFF = 1_000_081_300
NEEDED = f"""w AS (SELECT * FROM revs WHERE live AND t > {CUTOFF}),
lowest AS (SELECT path, min(CASE WHEN branch = 'BR' THEN 1 ELSE k END) AS low FROM w GROUP BY path)"""


def wanted(deltas: DataFrame) -> DataFrame:
    return deltas.filter((F.col("t") > CUTOFF) & ~F.col("dead")).select("master_id", revnum.render("rev").alias("number"))


@query(f"WITH {REVISIONS}, {NEEDED} SELECT path, number FROM revs JOIN lowest USING (path) WHERE branch = 'master' AND k >= low UNION ALL SELECT path, number FROM w WHERE branch = 'BR'")
def needed_deltas(spark, sf_dir):
    """The deltas that revisions after a cutoff depend on; no others are replayed for them."""
    masters = masters_of(spark, sf_dir)
    rows = replay.chained(masters.deltas.select("master_id", F.col("fileop_path").alias("path"), revnum.render("rev").alias("number")))
    return replay.needed(rows, wanted(masters.deltas)).select("path", "number")


@query(f"WITH {REVISIONS} SELECT path, number, md5(body) AS content FROM revs WHERE live AND t > {CUTOFF}")
def contents_since(spark, sf_dir):
    """Contents of the revisions after a cutoff, replayed from the deltas that they need."""
    masters = masters_of(spark, sf_dir)
    rows = masters.deltas.select("master_id", revnum.render("rev").alias("number"), "edit_text", "dead", F.lit("b").alias("mode"))
    found = replay.snapshots(rows, wanted(masters.deltas), segment=4)
    return found.join(masters.files.select("master_id", F.col("fileop_path").alias("path")), "master_id").select("path", "number", F.md5("content").alias("content"))


@query(f"""WITH {REVISIONS}, c AS (SELECT branch, lead.t AS t, row_number() OVER (PARTITION BY branch ORDER BY lead.t) - 1 AS seq FROM sets GROUP BY branch, lead.t)
SELECT branch, seq, lead.t AS t, author, lead.log AS log, CASE WHEN live THEN 'M' ELSE 'D' END AS op, path, CASE WHEN live THEN number END AS number FROM sets JOIN c USING (branch) WHERE c.t = lead.t
UNION ALL SELECT 'BR', 0, (SELECT min(lead.t) FROM sets WHERE branch = 'BR'), 'b', 'on branch' || chr(10), 'D', path, NULL FROM sets
  WHERE path NOT IN (SELECT path FROM sets WHERE branch = 'BR') AND lead.t <= (SELECT arg_max(lead.t, t) FROM sets WHERE branch = 'master' AND k = 1 AND g = 0 AND path IN (SELECT path FROM sets WHERE branch = 'BR'))""")
def master_history(spark, sf_dir):
    """Changesets, several files in one, and their file operations: what the branch's first
    tree lacks of the one that it grows from is deleted there."""
    history = History(masters_of(spark, sf_dir))
    ops = history.fileops.select("cs_id", "op", "path", revnum.render("rev").alias("number"))
    return history.changesets.join(ops, "cs_id").select("branch", "seq", "t", "author", "log", "op", "path", "number")


@query(f"""WITH {REVISIONS}, c AS (SELECT branch, lead.t AS t, sum(count(*) FILTER (live) + 1) OVER (ORDER BY lead.t)::BIGINT AS mark FROM sets GROUP BY branch, lead.t)
SELECT mark, path || ' ' || number || ' :' || mark AS line FROM sets JOIN c USING (branch) WHERE c.t = lead.t AND live""")
def master_revision_map(spark, sf_dir):
    """The map of revisions to marks: each commit's mark comes after those of its blobs."""
    return emit.revision_map(History(masters_of(spark, sf_dir))).select("mark", "line")


@query(f"""WITH {REVISIONS} SELECT path, number, md5(log) || chr(10) AS log,
  md5(CASE WHEN branch = 'BR' OR k < max(k) OVER (PARTITION BY path) THEN 'd1 1' || chr(10) || 'a1 1' || chr(10) ELSE '' END || 'm/' || path || ',v content for ' || number || chr(10)) AS edit FROM revs""")
def reduced_masters(spark, sf_dir):
    """The masters reduced to their shape, written as files and read again."""
    nested = reduction.parsed_files(conversation_masters(spark, sf_dir))
    masters = Masters(reduction.rendered(reduction.reduced(nested)), "m/")
    return masters.deltas.select(F.col("fileop_path").alias("path"), revnum.render("rev").alias("number"), "log", F.md5("edit_text").alias("edit"))


RELEASES = 21  # the i-th names the tips of the first 2**i groups


def tagged_masters(spark: SparkSession, sf_dir: str) -> Masters:
    """The masters with releases that equal trees, and a tag that equals none."""
    names = F.transform(F.sequence(F.lit(0), F.lit(RELEASES - 1)), lambda i: F.when((F.col("group") < F.pow(F.lit(2.0), i)) & (F.col("tip") % 5 != 0), F.concat(F.lit("\n\tR"), i, F.lit(":1."), "tip")).otherwise(""))
    return Masters(conversation_masters(spark, sf_dir, F.concat(F.array_join(names, ""), F.lit("\n\tLOST:1.1"))), "m/")


@query(f"""WITH {REVISIONS}, c AS (SELECT branch, lead.t AS t, min(g) AS g, sum(count(*) FILTER (live) + 1) OVER (ORDER BY lead.t)::BIGINT AS mark FROM sets GROUP BY branch, lead.t),
r AS (SELECT 'R' || i AS name, max(mark) AS mark FROM range({RELEASES}) AS x(i) JOIN c ON branch = 'master' AND g < 1 << i GROUP BY i)
SELECT 'reset refs/tags/' || name || chr(10) || 'from :' || mark || chr(10) || chr(10) AS chunk FROM r
UNION ALL SELECT 'reset refs/heads/' || branch || chr(10) || 'from :' || max(mark) || chr(10) || chr(10) FROM c GROUP BY branch
UNION ALL SELECT 'reset refs/heads/LOST' || chr(10) || 'from :' || max(mark) + 1 || chr(10) || chr(10) FROM c""")
def tagged_stream(spark, sf_dir):
    """Where the stream says that tags and branches are: a tag that equals trees is on the newest
    of them, one that equals none has a branch of its own, behind all others."""
    history = History(tagged_masters(spark, sf_dir))
    commits, _ = emit.marked(history)
    return emit.references(history, commits).select(F.col("chunk").cast("string").alias("chunk"))


@query("""WITH n AS (SELECT conv_id, 'm/c' || conv_id || '.txt,v' AS path FROM conversations GROUP BY conv_id)
SELECT 'unreadable' AS kind, path AS subject, 'bad reference name: a..b' AS detail FROM n WHERE conv_id % 5 = 0
UNION ALL SELECT 'unreadable', path, 'bad reference name: ~^' FROM n WHERE conv_id % 7 = 0
UNION ALL SELECT 'symbol names no branch by itself', 'ODD', '1.1.1' FROM n WHERE conv_id % 6 = 0""")
def conversion_problems(spark, sf_dir):
    """What a conversion of masters with bad symbols warns of."""
    pick = lambda by, line: F.when(F.col("conv_id") % by == 0, F.lit("\n\t" + line)).otherwise("")
    bad = F.concat(pick(5, "a..b:1.1"), pick(7, "~^:1.1"), pick(6, "ODD:1.1.1"))
    return emit.problems(History(Masters(conversation_masters(spark, sf_dir, bad), "m/")))


@query(f"""WITH {REVISIONS} SELECT 'files' AS name, count(DISTINCT path)::DOUBLE AS value FROM revs UNION ALL SELECT 'deltas', count(*) FROM revs UNION ALL SELECT 'revisions', count(*) FROM revs
UNION ALL SELECT 'changesets', count(DISTINCT (branch, lead.t)) FROM sets UNION ALL SELECT 'branches', 2 UNION ALL SELECT 'tags', 0 UNION ALL SELECT 'synthetic branches', 0""")
def conversion_statistics(spark, sf_dir):
    """Sizes of a conversion; the seconds of its phases are left out, as they differ from run to run."""
    found = emit.statistics(History(masters_of(spark, sf_dir)))
    return found.filter(~F.col("name").startswith("seconds: ") & (F.col("name") != "file operations"))


@query("""WITH n AS (SELECT conv_id, count(*) AS tip FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id, 'BR' AS name, [1, 1, 0, 2] AS number FROM n WHERE conv_id % 2 = 0
  UNION ALL SELECT conv_id, 'A', [1, 1, 0, 10] FROM n UNION ALL SELECT conv_id, 'Z', [1, 1, 0, 4] FROM n UNION ALL SELECT conv_id, 'T', [1, tip, 0, 2] FROM n WHERE conv_id % 3 = 0 UNION ALL SELECT conv_id, 'master', NULL FROM n)
SELECT 'c' || conv_id || '.txt' AS path, name AS ref_name, array_to_string(number, '.') AS number, row_number() OVER (PARTITION BY conv_id ORDER BY number NULLS FIRST, name) AS place FROM s""")
def head_order(spark, sf_dir):
    """The branch heads of each file in the order of their symbols' numbers, the trunk first."""
    more = F.concat(F.lit("\n\tA:1.1.0.10\n\tZ:1.1.0.4"), F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("\n\tT:1."), "tip", F.lit(".0.2"))).otherwise(""))
    masters = Masters(conversation_masters(spark, sf_dir, more), "m/")
    heads = filetrees.branch_heads(filetrees.file_revisions(masters.deltas, masters.symbols), masters.symbols)
    placed = orders.placed_heads(heads.select("master_id", "ref_name"), masters.symbols)
    return placed.join(masters.files.select("master_id", F.col("fileop_path").alias("path")), "master_id").select("path", "ref_name", revnum.render("number").alias("number"), "place")


IGNORES = "'" + text.DEFAULT_IGNORES.replace("'", "''") + "'"


@query(f"""WITH {REVISIONS},
c AS (SELECT branch, lead.t AS t, any_value(author) AS author, any_value(lead.log) AS log, count(*) FILTER (live) AS n, sum(count(*) FILTER (live) + 1) OVER (ORDER BY lead.t)::BIGINT AS mark FROM sets GROUP BY branch, lead.t),
joined AS (SELECT mark FROM c WHERE branch = 'master' AND t = (SELECT arg_max(lead.t, t) FROM sets WHERE branch = 'master' AND k = 1 AND g = 0 AND path IN (SELECT path FROM sets WHERE branch = 'BR'))),
b AS (SELECT sets.branch, lead.t AS t, path, body, c.mark - c.n - 1 + row_number() OVER (PARTITION BY sets.branch, lead.t ORDER BY path) AS mark FROM sets JOIN c ON c.branch = sets.branch AND c.t = lead.t WHERE live),
ops AS (SELECT branch, t, path, 'M 100644 :' || mark || ' ' || path || chr(10) AS line FROM b UNION ALL SELECT branch, lead.t, path, 'D ' || path || chr(10) FROM sets WHERE NOT live
  UNION ALL SELECT 'BR', (SELECT min(lead.t) FROM sets WHERE branch = 'BR'), path, 'D ' || path || chr(10) FROM sets JOIN c ON c.branch = 'master' AND c.t = lead.t
    WHERE path NOT IN (SELECT path FROM sets WHERE branch = 'BR') AND c.mark <= (SELECT mark FROM joined)),
changes AS (SELECT branch, t, string_agg(line, '' ORDER BY path) AS lines FROM ops GROUP BY ALL),
p AS (SELECT c.*, lines, CASE WHEN branch = 'BR' THEN coalesce(lag(mark) OVER w, (SELECT mark FROM joined)) ELSE lag(mark) OVER w END AS parent FROM c JOIN changes USING (branch, t) WINDOW w AS (PARTITION BY branch ORDER BY t)),
lines AS (SELECT 0 AS kind, mark AS sub, 'blob' || chr(10) || 'mark :' || mark || chr(10) || 'data ' || octet_length(encode(body)) || chr(10) || body || chr(10) AS chunk FROM b
  UNION ALL SELECT 1, mark, 'commit refs/heads/' || branch || chr(10) || 'mark :' || mark || chr(10) || 'committer ' || author || ' <' || author || '> ' || t || ' +0000' || chr(10) || 'data ' || octet_length(encode(log)) || chr(10) || log || chr(10)
    || coalesce('from :' || parent || chr(10), '') || lines || CASE WHEN t = (SELECT min(t) FROM c) THEN 'M 100644 inline .gitignore' || chr(10) || 'data ' || octet_length(encode({IGNORES})) || chr(10) || {IGNORES} || chr(10) ELSE '' END || chr(10) FROM p
  UNION ALL SELECT 3, CASE branch WHEN 'master' THEN 1 ELSE 2 END, 'reset refs/heads/' || branch || chr(10) || 'from :' || max(mark) || chr(10) || chr(10) FROM c GROUP BY branch
  UNION ALL SELECT 4, 0, 'done' || chr(10))
SELECT kind, sub, md5(chunk) AS chunk FROM lines""")
def import_stream(spark, sf_dir):
    """The whole import stream: blobs, commits with their files, the default ignores, where the
    branches end."""
    stream = emit.stream(History(masters_of(spark, sf_dir)))
    return stream.select("kind", "sub", F.md5("chunk").alias("chunk"))
