"""The queries over the supplied tables, each next to the SQL it must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revloom.functions import paths, revnum, text
from revloom.operators import branches, changesets, forest, keywords, ordered, orders, repair, replay, shared, tags, trees, verify
from revloom.plans import emit
from revloom.sources.masters import author_map
from revloom.sources.revision_log import revision_log, table, unnumbered_log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The revision log in SQL.
RL = """
rl0 AS (SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS t, concat('src/', event_type, '/u', user_id % 40, '.c') AS path,
  concat('a', user_id % 7) AS author, event_type AS log, event_id % 10 = 0 AS dead, CASE WHEN event_id % 3 = 0 THEN props END AS commitid FROM events),
rl AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY t, event_id) AS rn FROM rl0)"""

#: Instants of the sample history (Unix seconds): its tenth and twentieth day.
DAY_10, DAY_20 = 1_704_844_800, 1_705_708_800
FIVE_DAYS = 432_000
CHANGESET_WINDOW = 3600


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# Revision numbers


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different revision numbers built from ``lineitem``: trunk, branch, magic and odd ones."""
    a, b, c = F.col("l_orderkey") % 5 + 1, F.col("l_linenumber"), F.col("l_partkey") % 4
    first = F.when(F.col("l_suppkey") % 3 == 0, "1.1.").otherwise(F.concat(F.lit("1."), a, F.lit(".")))
    number = F.when(c == 0, F.concat(F.lit("1."), a)).when(c == 1, F.concat(first, b, F.lit("."), a)).when(c == 2, F.concat(first, F.lit("0."), b * 2)).otherwise(F.concat(first, b))
    rows = table(spark, sf_dir, "lineitem").select(number.alias("number"))
    return rows.groupBy("number").agg(F.count(F.lit(1)).alias("uses")).withColumn("rev", revnum.parse("number"))


NUMBERS = """
n0 AS (SELECT l_orderkey % 5 + 1 AS a, l_linenumber AS b, l_partkey % 4 AS c, CASE WHEN l_suppkey % 3 = 0 THEN '1.1.' ELSE '1.' || (l_orderkey % 5 + 1) || '.' END AS f FROM lineitem),
n1 AS (SELECT CASE c WHEN 0 THEN '1.' || a WHEN 1 THEN f || b || '.' || a WHEN 2 THEN f || '0.' || (b * 2) ELSE f || b END AS number FROM n0),
n AS (SELECT number, count(*) AS uses, list_transform(string_split(number, '.'), lambda x: x::INTEGER) AS rev FROM n1 GROUP BY number),
k AS (SELECT *, len(rev) > 2 AND len(rev) % 2 = 0 AND rev[len(rev) - 1] = 0 AS magic FROM n),
nk AS (SELECT *, CASE WHEN len(rev) <= 2 THEN rev[1:0] WHEN magic THEN rev[1:len(rev) - 2] || [rev[len(rev)]] WHEN len(rev) % 2 = 1 THEN rev ELSE rev[1:len(rev) - 1] END AS key FROM k)"""


@query(f"WITH {NUMBERS} SELECT number, uses, row_number() OVER (ORDER BY rev) AS place FROM n")
def revnum_order(spark, sf_dir):
    rows = numbers(spark, sf_dir).withColumn("all", F.lit(0)).withColumn("first", F.get("rev", 1))
    return ordered.ranked(rows, ["all"], "first", [F.col("rev")], "place").select("number", "uses", "place")


@query(f"""WITH {NUMBERS} SELECT number, array_to_string(key, '.') AS branch, magic, len(rev) = 2 AS trunk,
  coalesce(len(rev) = 4 AND rev[1] = 1 AND rev[2] = 1 AND rev[3] % 2 = 1, false) AS vendor,
  len(rev) - CASE WHEN len(rev) >= 4 AND rev[1] = 1 AND rev[2] = 1 AND rev[3] % 2 = 1 THEN 1 ELSE 0 END AS degree FROM nk""")
def revnum_branch_key(spark, sf_dir):
    n = numbers(spark, sf_dir)
    vendor = F.coalesce(revnum.is_vendor("rev"), F.lit(False))
    return n.select("number", revnum.render(revnum.branch_key("rev")).alias("branch"), F.coalesce(revnum.is_magic("rev"), F.lit(False)).alias("magic"), revnum.is_trunk("rev").alias("trunk"), vendor.alias("vendor"), revnum.degree("rev").cast("long").alias("degree"))


@query(f"WITH {NUMBERS} SELECT a.number AS a, b.number AS b FROM nk a JOIN nk b ON a.key = b.key AND a.number < b.number")
def same_branch_pairs(spark, sf_dir):
    n = numbers(spark, sf_dir).select("number", revnum.branch_key("rev").alias("key"))
    pairs = n.alias("a").join(n.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.number") < F.col("b.number")))
    return pairs.select(F.col("a.number").alias("a"), F.col("b.number").alias("b"))


@query(f"""WITH {NUMBERS}, heads AS (SELECT DISTINCT key AS head FROM nk WHERE len(key) = 0 OR uses % 2 = 0),
  tried AS (SELECT DISTINCT number, key[1:CASE WHEN len(key) - 2 * i <= 1 THEN 0 ELSE len(key) - 2 * i END] AS head FROM nk, range(0, 4) r(i) WHERE 2 * i <= len(key))
  SELECT number, array_to_string(arg_max(head, len(head)), '.') AS branch FROM tried JOIN heads USING (head) GROUP BY number""")
def longest_prefix_branch(spark, sf_dir):
    n = numbers(spark, sf_dir).withColumn("key", revnum.branch_key("rev"))
    heads = n.filter((F.size("key") == 0) | (F.col("uses") % 2 == 0)).select(F.col("key").alias("head"))
    return n.join(branches.deepest_branch(n, heads), "key").select("number", revnum.render("head").alias("branch"))


# Paths


PAGE_PATHS = """pp AS (SELECT page_id, 'repo' || CASE page_id % 4 WHEN 0 THEN '/Attic' WHEN 1 THEN '/RCS' ELSE '' END
  || regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) || ',v' AS path FROM pages)"""


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.when(F.col("page_id") % 4 == 0, "/Attic").when(F.col("page_id") % 4 == 1, "/RCS").otherwise("")
    path = F.concat(F.lit("repo"), folder, F.regexp_extract("url", "^[a-z]+://[^/]+([^?#]*)", 1), F.lit(",v"))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), "url")


@query(f"""WITH {PAGE_PATHS}, r AS (SELECT page_id, array_to_string(list_filter(string_split(substr(path, 6), '/'), lambda x: x NOT IN ('Attic', 'RCS')), '/') AS p FROM pp)
  SELECT page_id, CASE WHEN p LIKE '%,v' AND p NOT LIKE '%/,v' THEN left(p, length(p) - 2) ELSE p END AS rectified FROM r""")
def path_rectify(spark, sf_dir):
    return page_paths(spark, sf_dir).select("page_id", paths.rectified("path", "repo/").alias("rectified"))


@query(f"""WITH {RL}, x AS (SELECT DISTINCT CASE WHEN author = 'a0' THEN path || '/.cvsignore' ELSE path END AS path FROM rl)
  SELECT path, regexp_replace(path, '[.]cvsignore$', '.gitignore') AS renamed, regexp_extract(path, '^(.*)/', 1) AS folder, regexp_extract(path, '[^/]*$') AS name FROM x""")
def ignore_rename(spark, sf_dir):
    rows = unnumbered_log(spark, sf_dir).select(F.when(F.col("author") == "a0", F.concat("path", F.lit("/.cvsignore"))).otherwise(F.col("path")).alias("path")).distinct()
    return rows.select("path", paths.ignore_renamed("path").alias("renamed"), paths.directory("path").alias("folder"), paths.base_name("path").alias("name"))


@query(f"""WITH {PAGE_PATHS} SELECT page_id, row_number() OVER (ORDER BY regexp_extract(path, '^(.*/)?', 0) || chr(1114111) || regexp_extract(path, '[^/]*$'), page_id) AS place FROM pp""")
def deep_path_sort(spark, sf_dir):
    rows = page_paths(spark, sf_dir).withColumn("key", paths.deep_key("path")).withColumn("all", F.lit(0))
    # a prefix of the key is in the key's order, and cuts it into buckets
    rows = rows.withColumn("start", F.substring("key", 1, 14))
    return ordered.ranked(rows, ["all"], "start", [F.col("key"), F.col("page_id")], "place").select("page_id", "place")


@query("""WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS path FROM pages),
  a AS (SELECT DISTINCT host, array_to_string(string_split(path, '/')[1:i], '/') || '/' AS prefix FROM p, range(1, 12) r(i) WHERE i < len(string_split(path, '/'))),
  s AS (SELECT host, prefix FROM a WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.host = a.host AND NOT starts_with(p.path, a.prefix)))
  SELECT h.host, coalesce(arg_max(prefix, length(prefix)), '') AS prefix FROM (SELECT DISTINCT host FROM p) h LEFT JOIN s USING (host) GROUP BY h.host""")
def common_prefix(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/]+([^?#]*)", 1).alias("path"))
    return paths.common_folder(rows, "path", ["host"])


@query("""WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path FROM pages),
  f AS (SELECT regexp_extract(path, '^(.*)/', 1) AS folder FROM p),
  a AS (SELECT array_to_string(string_split(folder, '/')[1:i], '/') AS folder FROM f, range(1, 20) r(i) WHERE folder <> '' AND i <= len(string_split(folder, '/')))
  SELECT folder, count(*) AS files FROM a GROUP BY folder""")
def folder_ancestry(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(paths.directory(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1)).alias("folder"))
    return rows.select(F.explode(paths.ancestors("folder")).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("files"))


# Contents


@query("""WITH n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, text FROM conversations)
  SELECT conv_id, '1.' || k AS number, md5(replace(coalesce(text, ''), ' ', chr(10))) AS content FROM n""")
def edit_script_apply(spark, sf_dir):
    """Turns as versions of one file, a word to a line: written as edits, then replayed."""
    versions = table(spark, sf_dir, "conversations").withColumn("body", F.replace("text", F.lit(" "), F.lit("\n")))
    scripts = replay.scripts_between(versions, "conv_id", "turn", "body")
    rows = scripts.select("master_id", "number", "edit_text", F.lit(False).alias("dead"), F.lit("b").alias("mode"))
    return replay.snapshots(rows).select(F.col("master_id").alias("conv_id"), "number", F.md5("content").alias("content"))


# Names, dates and logs


@query(r"""WITH n AS (SELECT p_partkey, p_name || '~' || p_brand || '^' || p_type || CASE WHEN p_partkey % 5 = 0 THEN '..' WHEN p_partkey % 5 = 1 THEN '@{' ELSE '' END AS name FROM part),
  c AS (SELECT p_partkey, regexp_replace(name, '[^\x21-\x7e]|[~^\\*?]', '', 'g') AS clean FROM n)
  SELECT p_partkey, clean, clean = '' OR contains(clean, '..') OR contains(clean, '@{') AS bad FROM c""")
def sanitize_refs(spark, sf_dir):
    odd = F.when(F.col("p_partkey") % 5 == 0, "..").when(F.col("p_partkey") % 5 == 1, "@{").otherwise("")
    name = F.concat("p_name", F.lit("~"), "p_brand", F.lit("^"), "p_type", odd)
    return table(spark, sf_dir, "part").select("p_partkey", text.sanitised(name).alias("clean"), text.bad_ref(name).alias("bad"))


@query("SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS seconds, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS rfc3339 FROM orders")
def rcs_date_parse(spark, sf_dir):
    at = F.col("o_orderdate").cast("timestamp")
    year = F.when(F.year(at) < 2000, F.year(at) - 1900).otherwise(F.year(at))
    dotted = F.concat_ws(".", year.cast("string"), F.date_format(at, "MM.dd.HH.mm.ss"))
    parsed = text.rcs_timestamp(F.col("dotted"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dotted.alias("dotted")).select("o_orderkey", F.unix_timestamp(parsed).alias("seconds"), text.rfc3339(parsed).alias("rfc3339"))


#: Zones of the sample authors.
ZONES = ("UTC", "America/Chicago", "Europe/Berlin", "Asia/Kolkata", "+0530", "-0800", "America/St_Johns")


@query(f"""WITH {RL}, z AS (SELECT event_id, t, (ARRAY{list(ZONES)!r})[substr(author, 2)::INTEGER + 1] AS zone FROM rl),
  m AS (SELECT *, CASE WHEN zone IN ('+0530', '-0800') THEN NULL ELSE epoch(timezone(zone, to_timestamp(t)))::BIGINT - t END AS off FROM z)
  SELECT event_id, t || ' ' || coalesce(CASE WHEN off < 0 THEN '-' ELSE '+' END || printf('%02d%02d', abs(off) // 3600, abs(off) // 60 % 60), zone) AS stamp FROM m""")
def tz_render(spark, sf_dir):
    zone = F.element_at(F.array(*[F.lit(z) for z in ZONES]), F.substring("author", 2, 2).cast("int") + 1)
    return unnumbered_log(spark, sf_dir).select("event_id", text.author_stamp(F.timestamp_seconds("t"), zone).alias("stamp"))


@query(f"""WITH {RL}, m AS (SELECT 'a' || c_custkey AS name, c_name AS "full", lower(c_mktsegment) || '@example.org' AS email FROM customer)
  SELECT author, coalesce("full", author) AS full_name, coalesce(email, author) AS email, count(*) AS revisions FROM rl LEFT JOIN m ON author = name GROUP BY ALL""")
def author_map_join(spark, sf_dir):
    known = table(spark, sf_dir, "customer").select(F.concat(F.lit("a"), F.col("c_custkey").cast("string")).alias("author"), F.col("c_name").alias("full"), F.concat(F.lower("c_mktsegment"), F.lit("@example.org")).alias("mail"))
    counted = unnumbered_log(spark, sf_dir).groupBy("author").agg(F.count(F.lit(1)).alias("revisions"))
    return counted.join(known, "author", "left").select("author", F.coalesce("full", "author").alias("full_name"), F.coalesce("mail", "author").alias("email"), "revisions")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN source WHEN doc_id % 2 = 0 THEN lang ELSE '*** empty log message ***' || chr(10) END AS log FROM documents""")
def default_logs(spark, sf_dir):
    log = F.when(F.col("doc_id") % 3 == 0, text.INITIAL_LOG).otherwise(F.col("source"))
    description = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", text.default_log(log, description).alias("log"))


@query("""WITH m AS (SELECT p_partkey, (['kv', 'kvl', 'k', 'v', 'o', 'b', 'x', ''])[p_size % 8 + 1] AS own FROM part)
  SELECT p_partkey, CASE WHEN own = 'b' THEN 'b' ELSE 'kv' END AS forced, CASE WHEN own IN ('kv', 'kvl', 'k', 'v', 'o') THEN own ELSE 'b' END AS plain FROM m""")
def expand_modes(spark, sf_dir):
    own = F.element_at(F.array(*[F.lit(x) for x in ("kv", "kvl", "k", "v", "o", "b", "x", "")]), F.col("p_size") % 8 + 1)
    return table(spark, sf_dir, "part").select("p_partkey", text.resolved_mode(own, "kv").alias("forced"), text.resolved_mode(own).alias("plain"))


@query(r"""SELECT page_id, 'anon@' || regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, 'm' || page_id % 5 AS module,
  page_id % 3 = 0 OR page_id % 3 = 1 AS junk FROM pages""")
def repository_urls(spark, sf_dir):
    made = F.concat(F.lit("cvs://me@"), F.lit("anon%40"), F.regexp_extract("url", "://([^/?#]*)", 1), F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), F.lit("#m"), (F.col("page_id") % 5).cast("string"))
    branch = F.when(F.col("page_id") % 3 == 0, text.vendor_branch_name(F.array(F.lit(1), F.lit(1), F.lit(3), F.lit(2)))).when(F.col("page_id") % 3 == 1, text.unnamed_branch_name(F.lit("master"), F.lit(None).cast("string"))).otherwise("release")
    rows = table(spark, sf_dir, "pages").select("page_id", text.repository_url(made).alias("u"), text.is_junk_branch(branch).alias("junk"))
    return rows.select("page_id", F.replace("u.host", F.lit("%40"), F.lit("@")).alias("host"), "u.path", "u.module", "junk")


@query("""WITH h AS (SELECT doc_id, substr(text, 1, 48) AS x FROM documents),
  a AS (SELECT doc_id, CASE WHEN instr(substr(x, 7), chr(10)) > 0 THEN substr(x, 1, 5 + instr(substr(x, 7), chr(10))) ELSE x END AS x FROM h),
  b AS (SELECT doc_id, regexp_replace(x, '(?s)^(.*?[.])[ \\t\\n\\x0b\\f\\r].*$', '\\1') AS x FROM a)
  SELECT doc_id, replace(regexp_replace(x, '[^\\x20-\\x7f]|[()\\[\\]{}]', '', 'g'), '"', '\\"') AS label FROM b""".replace("\\\\", "\\"))
def dot_log_label(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.log_label("text").alias("label"))


@query("""SELECT doc_id, md5(replace(text, 'a', '$Revision: 1.' || doc_id || ' $')) AS expanded FROM documents""")
def keyword_expand_simple(spark, sf_dir):
    unexpanded = F.replace("text", F.lit("a"), F.when(F.col("doc_id") % 2 == 0, "$Revision$").otherwise("$Revision: 0.9 $"))
    value = F.concat(F.lit("1."), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.keyword_expanded(unexpanded, "Revision", value)).alias("expanded"))


#: The modes of expansion.
MODES = ("kv", "kvl", "k", "v", "o", "b")
KEYWORD_NAMES = tuple(k.decode() for k in keywords.KEYWORDS)


@query(rf"""WITH d AS (SELECT doc_id, text, ({list(KEYWORD_NAMES)!r})[doc_id % 11 + 1] AS k, ({list(MODES)!r})[doc_id // 11 % 6 + 1] AS mode, '1.' || doc_id AS number, 'a' || doc_id % 7 AS author,
    strftime(make_timestamp((978307200 + doc_id * 61) * 1000000), '%Y/%m/%d %H:%M:%S') AS moment, 'f\040' || doc_id || '.c,v' AS name, coalesce(source, '') AS folder FROM documents),
  v AS (SELECT *, CASE k WHEN 'Author' THEN author WHEN 'Date' THEN moment WHEN 'State' THEN 'Exp' WHEN 'Revision' THEN number WHEN 'RCSfile' THEN name WHEN 'Log' THEN name WHEN 'Source' THEN '/repo/' || folder || '/' || name
    WHEN 'Id' THEN concat_ws(' ', name, number, moment, author, 'Exp') WHEN 'Header' THEN concat_ws(' ', '/repo/' || folder || '/' || name, number, moment, author, 'Exp') ELSE '' END AS value FROM d),
  w AS (SELECT *, CASE WHEN mode IN ('kv', 'kvl') THEN '$' || k || ': ' || value || ' $' WHEN mode = 'v' THEN value ELSE '$' || k || '$' END AS found,
    CASE WHEN mode IN ('kv', 'kvl') THEN chr(10) || ' * Revision ' || number || '  ' || moment || '  ' || author || chr(10) || ' * why' || chr(10) || ' *' || chr(10) || ' * so' || chr(10) || ' *' ELSE '' END AS entry FROM v)
  SELECT doc_id, md5(CASE WHEN k = 'Log' THEN '/* ' || found || entry || chr(10) || ' */' || text ELSE replace(text, 'e', found) END) AS expanded FROM w""")
def keyword_modes(spark, sf_dir):
    """Every keyword in every mode, in whole texts: a keyword for each e, or a log at the start."""
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (i + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").withColumns({"k": pick(KEYWORD_NAMES, F.col("doc_id") % 11), "mode": pick(MODES, F.floor(F.col("doc_id") / 11) % 6)})
    raw = F.when(F.col("k") == "Log", F.concat(F.lit("/* $Log$\n */"), "text")).otherwise(F.replace("text", F.lit("e"), F.concat(F.lit("$"), "k", F.lit("$"))))
    path = paths.absolute(F.concat(F.lit("./"), F.coalesce("source", F.lit("")), F.lit("/f "), "doc_id", F.lit(".c,v")), "/repo/")
    rows = rows.select("doc_id", F.encode(raw, "UTF-8").alias("content"), "mode", path.alias("path"), F.concat(F.lit("1."), "doc_id").alias("number"), (978_307_200 + F.col("doc_id") * 61).alias("t"), F.concat(F.lit("a"), F.col("doc_id") % 7).alias("author"), F.lit("Exp").alias("state"), F.lit("why\n\nso\n").alias("log"))
    return keywords.expanded_contents(rows, "doc_id").select("doc_id", F.md5("content").alias("expanded"))


@query("""WITH e AS (SELECT doc_id, replace(text, 'e', '@') AS raw FROM documents)
  SELECT doc_id, length(raw) + length(raw) - length(replace(raw, '@', '')) AS escaped_length, md5(raw) AS back FROM e""")
def rcs_escape_roundtrip(spark, sf_dir):
    escaped = text.at_escaped(F.replace("text", F.lit("e"), F.lit("@")))
    return table(spark, sf_dir, "documents").select("doc_id", escaped.alias("escaped")).select("doc_id", F.length("escaped").cast("long").alias("escaped_length"), F.md5(text.at_unescaped("escaped")).alias("back"))


@query(r"""WITH e AS (SELECT doc_id, replace(replace(replace(replace(replace(text, '\', '\\'), chr(9), '\t'), chr(10), '\n'), ' ', '\040'), '$', '\044') AS value FROM documents)
  SELECT doc_id, length(value)::BIGINT AS length, md5(value) AS digest FROM e""")
def keyword_value_escapes(spark, sf_dir):
    """Every document, from its first character to its last."""
    value = text.value_escaped("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(value).cast("long").alias("length"), F.md5(value).alias("digest"))


# Revisions and changesets


@query(f"WITH {RL}, d AS (SELECT *, row_number() OVER (PARTITION BY path, t // 600 ORDER BY t, event_id) AS k FROM rl) SELECT event_id, path, t FROM d WHERE k = 1")
def dup_delta_filter(spark, sf_dir):
    rows = unnumbered_log(spark, sf_dir).groupBy("path", F.floor(F.col("t") / 600).alias("number")).agg(F.min(F.struct("t", "event_id")).alias("first"))
    return rows.select("first.event_id", "path", "first.t")


@query(f"""WITH RECURSIVE {RL}, s AS (SELECT path, rn, event_id, t + CASE WHEN event_id % 11 = 0 THEN 90000 ELSE 0 END AS t FROM rl),
  w AS (SELECT path, rn, cur, NULL::BIGINT AS grand, NULL::BIGINT AS done FROM (SELECT path, rn, t AS cur, max(rn) OVER (PARTITION BY path) AS top FROM s) WHERE rn = top
    UNION ALL
    SELECT w.path, s.rn, CASE WHEN s.t > w.cur AND NOT coalesce(s.t <= w.grand, false) THEN w.cur ELSE s.t END,
      CASE WHEN s.t > w.cur AND coalesce(s.t <= w.grand, false) THEN s.t ELSE w.cur END,
      CASE WHEN s.t > w.cur AND coalesce(s.t <= w.grand, false) THEN s.t ELSE w.cur END
    FROM w JOIN s ON s.path = w.path AND s.rn = w.rn - 1),
  f AS (SELECT path, rn + 1 AS rn, done AS repaired FROM w WHERE done IS NOT NULL UNION ALL SELECT path, rn, cur FROM w WHERE rn = 1)
  SELECT s.event_id, f.repaired FROM f JOIN s USING (path, rn)""")
def date_repair(spark, sf_dir):
    rows = revision_log(spark, sf_dir).withColumn("t", F.col("t") + F.when(F.col("event_id") % 11 == 0, 90000).otherwise(0))
    done = repair.repaired_dates(rows.select("path", "rn", "t"), ["path"], "rn")
    return rows.select("path", "rn", "event_id").join(done, ["path", "rn"]).select("event_id", "repaired")


@query(f"""WITH RECURSIVE {RL}, s AS (SELECT author, log, t, max(event_id) AS id, count(*) AS n FROM rl GROUP BY ALL),
  nx AS (SELECT a.author, a.log, a.t, b.t AS next FROM (SELECT *, t - {CHANGESET_WINDOW} AS lim FROM s) a ASOF LEFT JOIN s b ON a.author = b.author AND a.log = b.log AND a.lim >= b.t),
  c AS (SELECT author, log, max(t) AS t FROM s GROUP BY ALL UNION ALL SELECT c.author, c.log, nx.next FROM c JOIN nx USING (author, log, t) WHERE nx.next IS NOT NULL),
  l AS (SELECT c.*, nx.next FROM c JOIN nx USING (author, log, t))
  SELECT l.author, l.log, l.t AS leader_t, max(s.id) FILTER (s.t = l.t) AS leader_id, sum(s.n)::BIGINT AS members
  FROM l JOIN s ON s.author = l.author AND s.log = l.log AND s.t <= l.t AND s.t > coalesce(l.next, -1) GROUP BY ALL""")
def anchored_changesets(spark, sf_dir):
    return changesets.anchored_changesets(unnumbered_log(spark, sf_dir), ["author", "log"], CHANGESET_WINDOW)


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changesets.frontier_changesets(unnumbered_log(spark, sf_dir).withColumn("branch", F.lit("master")), CHANGESET_WINDOW)


#: Each step of the recursion is a changeset: every file's newest revision that isn't taken,
#: the leader among them, and what it takes.
FRONTIER = f"""WITH RECURSIVE {RL},
s AS (SELECT *, count(*) OVER (PARTITION BY path) AS n FROM rl),
c AS MATERIALIZED (SELECT path, row_number() OVER (PARTITION BY path ORDER BY t, event_id) AS k, event_id, t, author, log, commitid, NOT (rn = 1 AND dead) AS alive,
  coalesce('c' || commitid, 'a' || author || chr(1) || log) AS key FROM s WHERE NOT (rn = 1 AND dead AND n > 1)),
f AS (SELECT 0 AS step, path, max(k) AS k, NULL::BIGINT AS leader_id, NULL::BIGINT AS event_id FROM c GROUP BY path
  UNION ALL
  SELECT step + 1, path, CASE WHEN m THEN k - 1 ELSE k END, -lead.i, CASE WHEN m THEN event_id END
  FROM (SELECT *, key = lead.key AND -lead.t - t < {CHANGESET_WINDOW} AS m FROM (
    SELECT step, path, k, c.event_id, t, key, min({{'t': -t, 'p': path, 'i': -c.event_id, 'key': key}}) OVER () AS lead, bool_or(alive) OVER () AS any_alive FROM f JOIN c USING (path, k)))
  WHERE step = 0 OR any_alive),
taken AS (SELECT leader_id, event_id, path FROM f WHERE event_id IS NOT NULL)"""


@query(f"{FRONTIER}, g AS (SELECT leader_id, count(*) AS files FROM taken GROUP BY leader_id) SELECT 'master' AS branch, leader_id, t, author, log, commitid, files FROM g JOIN c ON c.event_id = leader_id")
def frontier_changesets(spark, sf_dir):
    return changesets.changesets_of(membership(spark, sf_dir))


@query(f"{FRONTIER} SELECT 'master' AS branch, leader_id, event_id, path FROM taken")
def frontier_membership(spark, sf_dir):
    return membership(spark, sf_dir).select("branch", "leader_id", "event_id", "path")


@query(f"WITH {RL} SELECT commitid, count(*) AS revisions, count(DISTINCT path) AS files, min(t) AS first_t, max(t) AS last_t FROM rl WHERE commitid IS NOT NULL GROUP BY commitid")
def commitid_changesets(spark, sf_dir):
    return changesets.commitid_changesets(unnumbered_log(spark, sf_dir))


@query(f"""WITH {RL}, g AS (SELECT event_id, t, CASE WHEN t - lag(t) OVER (ORDER BY t, event_id) >= 300 THEN 1 ELSE 0 END AS cut FROM rl)
  SELECT event_id, sum(cut) OVER (ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS epoch FROM g""")
def gap_epochs(spark, sf_dir):
    rows = unnumbered_log(spark, sf_dir).withColumn("branch", F.lit("master"))
    return changesets.epochs(rows, ["branch"], 300).select("event_id", "epoch")


# Trees


@query(f"""WITH {RL}, i AS (SELECT DISTINCT (t // {FIVE_DAYS} + 1) * {FIVE_DAYS} AS instant FROM rl),
  h AS (SELECT i.instant, path, max({{'t': t, 'event_id': event_id, 'rn': rn, 'dead': dead}}) AS m FROM i JOIN rl ON rl.t <= i.instant GROUP BY ALL)
  SELECT instant, path, m.rn AS rn FROM h WHERE NOT m.dead""")
def tree_at(spark, sf_dir):
    rows = revision_log(spark, sf_dir)
    instants = rows.select(((F.floor(F.col("t") / FIVE_DAYS) + 1) * FIVE_DAYS).alias("instant")).distinct()
    return trees.trees_at(rows, instants)


@query(f"""WITH {RL}, x AS (SELECT *, lead(t) OVER (PARTITION BY path ORDER BY t, event_id) AS nt FROM rl)
  SELECT path, rn, event_id, t AS from_t, coalesce(nt, {trees.FOREVER}) AS to_t FROM x WHERE NOT dead AND t < coalesce(nt, {trees.FOREVER})""")
def tree_intervals(spark, sf_dir):
    return trees.tree_intervals(revision_log(spark, sf_dir))


FILE_OPS = """o AS (SELECT event_id, t, path, rn, CASE WHEN NOT dead THEN 'M' WHEN NOT coalesce(lag(dead) OVER (PARTITION BY path ORDER BY t, event_id), true) THEN 'D' END AS op FROM rl),
ops AS (SELECT * FROM o WHERE op IS NOT NULL)"""


@query(f"WITH {RL}, {FILE_OPS} SELECT event_id, t, path, rn, op FROM ops")
def fileops(spark, sf_dir):
    return trees.file_operations(revision_log(spark, sf_dir))


@query(f"""WITH {RL}, h AS (SELECT instant, path, max({{'t': t, 'event_id': event_id, 'rn': rn, 'dead': dead}}) AS m FROM rl JOIN (VALUES ({DAY_10}), ({DAY_20})) v(instant) ON rl.t <= v.instant GROUP BY ALL),
  a AS (SELECT path, m.rn AS old_rn FROM h WHERE instant = {DAY_10} AND NOT m.dead), b AS (SELECT path, m.rn AS new_rn FROM h WHERE instant = {DAY_20} AND NOT m.dead),
  j AS (SELECT *, CASE WHEN old_rn IS NULL THEN 'added' WHEN new_rn IS NULL THEN 'removed' WHEN old_rn <> new_rn THEN 'changed' END AS change FROM a FULL OUTER JOIN b USING (path))
  SELECT path, old_rn, new_rn, change FROM j WHERE change IS NOT NULL""")
def tree_diff(spark, sf_dir):
    rows = revision_log(spark, sf_dir)
    return trees.tree_difference(trees.latest_at(rows, DAY_10), trees.latest_at(rows, DAY_20))


@query(f"""WITH {RL}, x AS (SELECT *, lead(t) OVER (PARTITION BY path ORDER BY t, event_id) AS nt FROM rl),
  s AS (SELECT t, 1 AS d FROM x WHERE NOT dead AND t < coalesce(nt, {trees.FOREVER}) UNION ALL SELECT nt, -1 FROM x WHERE NOT dead AND t < nt),
  c AS (SELECT t, sum(d) AS d FROM s GROUP BY t) SELECT t, sum(d) OVER (ORDER BY t)::BIGINT AS files FROM c""")
def files_per_tree(spark, sf_dir):
    return trees.files_per_tree(trees.tree_intervals(revision_log(spark, sf_dir)))


# Branches and tags


@query(f"""WITH {RL}, b AS (SELECT * FROM rl WHERE log = 'signup'), v AS (SELECT * FROM rl WHERE log = 'view')
  SELECT b.event_id, max({{'t': v.t, 'e': v.event_id}}).e AS trunk_id, max({{'t': v.t, 'e': v.event_id}}).t AS trunk_t FROM b LEFT JOIN v ON v.author = b.author AND v.t <= b.t GROUP BY b.event_id""")
def branch_point_asof(spark, sf_dir):
    rows = unnumbered_log(spark, sf_dir)
    trunk = rows.filter("log = 'view'").select("author", "t", "event_id", F.col("event_id").alias("trunk_id"), F.col("t").alias("trunk_t"))
    found = branches.as_of_backward(rows.filter("log = 'signup'").select("author", "t", "event_id"), trunk, ["author"], ["trunk_id", "trunk_t"])
    return found.select("event_id", "trunk_id", "trunk_t")


@query(f"""WITH {RL} SELECT b.event_id, max({{'t': v.t, 'e': v.event_id}}).t AS found_t, max({{'t': v.t, 'e': v.event_id}}).e AS found_id
  FROM rl b JOIN rl v ON v.event_id <> b.event_id AND v.author = b.author AND v.log = b.log AND abs(v.t - b.t) < 1800 GROUP BY b.event_id""")
def branch_point_by_meta(spark, sf_dir):
    """Every revision meets every other one."""
    rows = unnumbered_log(spark, sf_dir).select("event_id", "author", "log", "t")
    return branches.newest_match(rows, rows, ["author", "log"], 1800, "event_id", "event_id", others=True)


def part_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as branches: each grows from the part with half its number."""
    parent = F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 2))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), parent.alias("parent"))


PART_TREE = """anc AS (SELECT p_partkey AS node, p_partkey AS a, 0 AS d FROM part UNION ALL SELECT node, a // 2, d + 1 FROM anc WHERE a > 0)"""


@query(f"WITH RECURSIVE {PART_TREE} SELECT node, max(d)::BIGINT AS depth FROM anc GROUP BY node")
def branch_depth(spark, sf_dir):
    return forest.depths(part_tree(spark, sf_dir))


@query(f"WITH RECURSIVE {PART_TREE}, d AS (SELECT node, max(d) AS depth FROM anc GROUP BY node) SELECT node, row_number() OVER (ORDER BY depth, node) AS place FROM d")
def branch_toposort(spark, sf_dir):
    rows = forest.depths(part_tree(spark, sf_dir)).withColumn("all", F.lit(0))
    return ordered.ranked(rows, ["all"], "depth", [F.col("node")], "place").select("node", "place")


@query(f"WITH RECURSIVE {PART_TREE} SELECT a AS node, count(*) AS refs, min(node) AS owner FROM anc GROUP BY a")
def ancestor_refcount(spark, sf_dir):
    """Every node is a head."""
    tree = part_tree(spark, sf_dir)
    return forest.reference_counts(tree, tree.select(F.col("node").alias("head")))


@query(f"""WITH RECURSIVE {PART_TREE}, h AS (SELECT a, min({{'p': p_size, 'h': node}}).h AS owner FROM anc JOIN part ON p_partkey = node GROUP BY a)
  SELECT h.a AS node, h.owner, coalesce(up.owner <> h.owner, false) AS tail FROM h LEFT JOIN h up ON h.a > 0 AND up.a = h.a // 2""")
def tail_bits(spark, sf_dir):
    """Every part heads a branch; branches are walked in order of size."""
    heads = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("head"), F.struct("p_size", "p_partkey").alias("place"))
    return forest.tail_bits(part_tree(spark, sf_dir), heads)


@query("""WITH RECURSIVE l AS (SELECT p_partkey AS node, p_brand || '.' || p_partkey AS label FROM part WHERE p_partkey = 0
  UNION ALL SELECT p_partkey, label || ' > ' || p_brand || '.' || p_partkey FROM part JOIN l ON p_partkey > 0 AND p_partkey // 2 = node) SELECT node, label FROM l""")
def qualified_labels(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.concat("p_brand", F.lit("."), F.col("p_partkey").cast("string")).alias("name"))
    return forest.path_names(part_tree(spark, sf_dir).join(names, "node"), F.col("name"))


def file_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions as nodes, each below the one before it in its file, dated by the day."""
    rows = revision_log(spark, sf_dir)
    above = rows.select("path", (F.col("rn") + 1).alias("rn"), F.col("event_id").alias("parent"))
    day = F.floor(F.col("t") / ordered.DAY)
    return rows.join(above, ["path", "rn"], "left").select(F.col("event_id").alias("node"), "parent", day.alias("t"), "author", "log", F.col("t").alias("seconds"))


@query(f"WITH {RL} SELECT event_id AS node, first_value(t) OVER (PARTITION BY path ORDER BY rn) AS first FROM rl")
def first_of_history(spark, sf_dir):
    return forest.first_of_history(file_chains(spark, sf_dir), F.col("seconds"))


@query(f"""WITH RECURSIVE {RL}, d AS (SELECT path, rn, event_id, t // 86400 AS t, author, log FROM rl),
  k AS (SELECT path, rn, event_id, t, 0 AS step, [{{'t': t, 's': 0, 'a': author, 'l': log}}] AS key FROM d WHERE rn = 1
    UNION ALL SELECT d.path, d.rn, d.event_id, d.t, CASE WHEN d.t = k.t THEN step + 1 ELSE 0 END, [{{'t': d.t, 's': CASE WHEN d.t = k.t THEN step + 1 ELSE 0 END, 'a': d.author, 'l': d.log}}] || key FROM k JOIN d ON d.path = k.path AND d.rn = k.rn + 1)
  SELECT event_id AS node, dense_rank() OVER (ORDER BY key) - 1 AS rank FROM k""")
def commit_order_by_parents(spark, sf_dir):
    """Commits of a day by author and log; ties among those go by their ancestors."""
    return forest.ordered_commits(file_chains(spark, sf_dir).select("node", "parent", "t", "author", "log"))


@query("""WITH l AS (SELECT n_regionkey, s_nationkey, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)
  SELECT s_nationkey AS ref_name, max({'d': n, 'p': n_regionkey}).p AS parent_ref FROM l GROUP BY s_nationkey""")
def branch_parents(spark, sf_dir):
    joined = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("depth")).join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return branches.parents_over_masters(joined.select(F.col("s_nationkey").alias("ref_name"), F.col("n_regionkey").alias("parent_ref"), "depth"))


def tagged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tree"), F.concat("l_returnflag", F.lit("."), "l_linenumber").alias("member"))
    orders = table(spark, sf_dir, "orders").select(F.concat(F.col("o_custkey").cast("string"), F.lit("-"), "o_orderpriority").alias("tag"), F.col("o_orderkey").alias("tree"))
    return orders.join(lines, "tree").select("tag", "member"), lines


TAGGED = """ln AS (SELECT l_orderkey AS tree, l_returnflag || '.' || l_linenumber AS member FROM lineitem),
tg AS (SELECT o_custkey || '-' || o_orderpriority AS tag, member FROM orders JOIN ln ON tree = o_orderkey)"""


@query(f"WITH {TAGGED} SELECT tag, count(*) AS uses, count(DISTINCT member) AS members, md5(array_to_string(list_sort(list_distinct(list(member))), ',')) AS digest FROM tg GROUP BY tag")
def tag_members(spark, sf_dir):
    rows, _ = tagged(spark, sf_dir)
    listed = rows.groupBy("tag", "member").agg(F.count(F.lit(1)).alias("n")).groupBy("tag").agg(F.sum("n").alias("uses"), F.count(F.lit(1)).alias("members"), F.sort_array(F.collect_list("member")).alias("all"))
    return listed.select("tag", "uses", "members", F.md5(F.array_join("all", ",")).alias("digest"))


@query(f"""WITH {TAGGED}, ts AS (SELECT tag, list_sort(list_distinct(list(member))) AS s FROM tg GROUP BY tag), os AS (SELECT tree, list_sort(list_distinct(list(member))) AS s FROM ln GROUP BY tree)
  SELECT tag, any_value(len(ts.s))::BIGINT AS members, count(tree) AS n_trees, min(tree) AS first_tree FROM ts LEFT JOIN os USING (s) GROUP BY tag""")
def tag_match(spark, sf_dir):
    rows, lines = tagged(spark, sf_dir)
    return tags.matching_trees(rows, lines, "tag", "tree", "member")


# Emission


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions as commits of their own, with marks: a changed file's blob comes first."""
    ops = trees.file_operations(revision_log(spark, sf_dir))
    rows = ops.join(unnumbered_log(spark, sf_dir).select("event_id", "author", "log"), "event_id")
    rows = rows.withColumn("all", F.lit(0)).withColumn("day", ordered.day_of("t"))
    step = F.when(F.col("op") == "M", 2).otherwise(1).cast("long")
    rows = ordered.running(rows, ["all"], "day", [F.col("t"), F.col("event_id")], {"mark": step})
    return rows.withColumn("blob_mark", F.when(F.col("op") == "M", F.col("mark") - 1)).drop("all", "day")


MARKED = f"""{RL}, {FILE_OPS},
mk AS (SELECT ops.*, author, log, sum(CASE WHEN op = 'M' THEN 2 ELSE 1 END) OVER (ORDER BY ops.t, event_id)::BIGINT AS mark FROM ops JOIN (SELECT event_id, author, log FROM rl) r USING (event_id)),
marked AS (SELECT *, CASE WHEN op = 'M' THEN mark - 1 END AS blob_mark FROM mk)"""


@query(f"WITH {MARKED} SELECT event_id, mark, blob_mark FROM marked")
def mark_numbering(spark, sf_dir):
    return marked(spark, sf_dir).select("event_id", "mark", "blob_mark")


@query(f"WITH {MARKED} SELECT event_id, 100000 + mark * 600 AS seconds FROM marked")
def forced_dates(spark, sf_dir):
    return marked(spark, sf_dir).select("event_id", text.forced_seconds("mark").alias("seconds"))


@query(f"WITH {RL} SELECT event_id, row_number() OVER (ORDER BY t, author, log, event_id) AS place FROM rl")
def commit_total_order(spark, sf_dir):
    rows = unnumbered_log(spark, sf_dir).withColumn("all", F.lit(0)).withColumn("day", ordered.day_of("t"))
    return ordered.ranked(rows, ["all"], "day", [F.col(c) for c in ("t", "author", "log", "event_id")], "place").select("event_id", "place")


@query(f"""WITH {MARKED}, x AS (SELECT *, lag(t) OVER w AS pt, lag(mark) OVER w AS pm FROM marked WINDOW w AS (PARTITION BY log ORDER BY t, event_id)),
  f AS (SELECT *, row_number() OVER (PARTITION BY log ORDER BY t, event_id) AS k FROM x WHERE t > {DAY_20})
  SELECT event_id, mark, CASE WHEN k = 1 AND pt <= {DAY_20} THEN 'from refs/heads/' || log || '^0' ELSE 'from :' || pm END AS parent FROM f""")
def incremental_filter(spark, sf_dir):
    rows = marked(spark, sf_dir).withColumn("day", ordered.day_of("t"))
    rows = ordered.with_neighbour(rows, ["log"], "day", [F.col("t"), F.col("event_id")], {"pt": "t", "pm": "mark"})
    parent = F.when(F.col("pt") <= DAY_20, F.concat(F.lit("from "), text.branch_ref("log"), F.lit("^0"))).otherwise(F.concat(F.lit("from :"), F.col("pm")))
    return rows.filter(F.col("t") > DAY_20).select("event_id", "mark", parent.alias("parent"))


@query(f"""WITH {MARKED} SELECT event_id, 'commit refs/heads/master' || chr(10) || 'mark :' || mark || chr(10) || 'committer ' || author || ' <' || author || '> ' || t || ' +0000' || chr(10)
  || 'data ' || octet_length(encode(log)) || chr(10) || log || chr(10) || CASE op WHEN 'M' THEN 'M 100644 :' || blob_mark || ' ' || path ELSE 'D ' || path END || chr(10) AS lines FROM marked""")
def stream_commit_lines(spark, sf_dir):
    op = F.when(F.col("op") == "M", F.concat(F.lit("M 100644 :"), "blob_mark", F.lit(" "), "path")).otherwise(F.concat(F.lit("D "), "path"))
    pieces = [text.branch_ref(F.lit("master")), F.concat(F.lit("mark :"), "mark"), F.concat(F.lit("committer "), "author", F.lit(" <"), "author", F.lit("> "), text.author_stamp(F.timestamp_seconds("t"), F.lit("UTC"))), F.concat(F.lit("data "), F.octet_length("log")), F.col("log"), op]
    return marked(spark, sf_dir).select("event_id", F.concat(F.lit("commit "), F.array_join(F.array(*pieces), "\n"), F.lit("\n")).alias("lines"))


@query(f"WITH {MARKED} SELECT event_id, path || ' 1.' || rn || ' :' || mark AS line FROM marked WHERE op = 'M'")
def revision_map(spark, sf_dir):
    rev = F.array(F.lit(1), F.col("rn").cast("int"))
    return marked(spark, sf_dir).filter("op = 'M'").select("event_id", F.concat(revnum.label("path", rev), F.lit(" :"), "mark").alias("line"))


@query(f"""WITH {MARKED}, p AS (SELECT log, author, t // 3600 AS h, string_agg(path || ' 1.' || rn || chr(10), '' ORDER BY path, rn) AS pairs FROM marked WHERE op = 'M' GROUP BY ALL)
  SELECT log, author, h AS hour, 'property cvs-revision ' || octet_length(encode(pairs)) || ' ' || pairs AS property FROM p""")
def revision_property(spark, sf_dir):
    rows = marked(spark, sf_dir).filter("op = 'M'").withColumn("pair", F.concat(revnum.label("path", F.array(F.lit(1), F.col("rn").cast("int"))), F.lit("\n")))
    grouped = rows.groupBy("log", "author", F.floor(F.col("t") / 3600).alias("hour")).agg(F.sort_array(F.collect_list(F.struct("path", "rn", "pair"))).alias("all"))
    grouped = grouped.withColumn("pairs", F.array_join(F.transform("all", lambda x: x["pair"]), ""))
    return grouped.select("log", "author", "hour", F.concat(F.lit("property cvs-revision "), F.octet_length("pairs"), F.lit(" "), "pairs").alias("property"))


@query(f"WITH {MARKED} SELECT 'reset refs/heads/' || log || chr(10) || 'from :' || max(mark) || chr(10) AS lines FROM marked GROUP BY log")
def branch_resets(spark, sf_dir):
    heads = marked(spark, sf_dir).groupBy("log").agg(F.max("mark").alias("mark"))
    return heads.select(F.concat(F.lit("reset "), text.branch_ref("log"), F.lit("\nfrom :"), "mark", F.lit("\n")).alias("lines"))


@query(f"""WITH {MARKED}, x AS (SELECT *, lag(mark) OVER (PARTITION BY log ORDER BY t, event_id) AS pm FROM marked)
  SELECT mark, strftime(make_timestamp(t * 1000000), '%Y-%m-%dT%H:%M:%SZ') || ' ' || log || ' ' || path || ' 1.' || rn AS label, CASE WHEN pm IS NOT NULL THEN '"' || mark || '" -> "' || pm || '" [weight=10];' END AS edge FROM x""")
def dot_nodes_edges(spark, sf_dir):
    rows = marked(spark, sf_dir).withColumn("day", ordered.day_of("t"))
    rows = ordered.with_neighbour(rows, ["log"], "day", [F.col("t"), F.col("event_id")], {"pm": "mark"})
    label = F.concat_ws(" ", text.rfc3339(F.timestamp_seconds("t")), text.log_label("log"), revnum.label("path", F.array(F.lit(1), F.col("rn").cast("int"))))
    edge = F.concat(F.lit('"'), "mark", F.lit('" -> "'), "pm", F.lit('" [weight=10];'))
    return rows.select("mark", label.alias("label"), edge.alias("edge"))


@query(f"WITH {RL}, f AS (SELECT author, min({{'t': t, 'e': event_id}}) AS f, count(*) AS revisions FROM rl GROUP BY author) SELECT author, row_number() OVER (ORDER BY f) AS place, revisions FROM f")
def author_list(spark, sf_dir):
    seen = unnumbered_log(spark, sf_dir).groupBy("author").agg(F.min(F.struct("t", "event_id")).alias("first"), F.count(F.lit(1)).alias("revisions"))
    return seen.select("author", F.row_number().over(Window.orderBy("first")).cast("long").alias("place"), "revisions")


# Checks and figures


@query(f"WITH {RL} SELECT path, max(t) FILTER (commitid IS NULL) AS vulnerable_until, count(*) FILTER (commitid IS NULL) AS without_id FROM rl GROUP BY path")
def skew_vulnerable(spark, sf_dir):
    bare = F.col("commitid").isNull()
    return unnumbered_log(spark, sf_dir).groupBy("path").agg(F.max(F.when(bare, F.col("t"))).alias("vulnerable_until"), F.count(F.when(bare, 1)).alias("without_id"))


@query("SELECT doc_id, md5(text) AS log, 'content for ' || source || ' 1.' || doc_id || chr(10) AS stub FROM documents")
def reduce_logs(spark, sf_dir):
    """Every document is reduced."""
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.md5("text").alias("log"), F.concat(F.lit("content for "), "source", F.lit(" 1."), F.col("doc_id").cast("string"), F.lit("\n")).alias("stub"))


COPIES = """l AS (SELECT doc_id, text FROM documents WHERE doc_id % 7 <> 0), r AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN text || '.' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0),
c AS (SELECT doc_id, CASE WHEN r.doc_id IS NULL THEN 'left_only' WHEN l.doc_id IS NULL THEN 'right_only' WHEN l.text IS DISTINCT FROM r.text THEN 'differs' END AS status FROM l FULL OUTER JOIN r USING (doc_id))"""


def two_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    right = docs.filter("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    return verify.compared(docs.filter("doc_id % 7 <> 0"), right, "doc_id", "text")


@query(f"WITH {COPIES} SELECT doc_id, status FROM c WHERE status IS NOT NULL")
def verify_content(spark, sf_dir):
    return two_copies(spark, sf_dir)


@query(f"""WITH {RL}, refs AS (SELECT DISTINCT (t // 86400 + 1) * 86400 AS t FROM rl), b AS (SELECT * FROM rl WHERE event_id % 13 <> 0),
  ha AS (SELECT refs.t AS moment, path, max({{'t': rl.t, 'e': event_id, 'dead': dead}}) AS m FROM refs JOIN rl ON rl.t <= refs.t GROUP BY ALL), hb AS (SELECT refs.t AS moment, path, max({{'t': b.t, 'e': event_id, 'dead': dead}}) AS m FROM refs JOIN b ON b.t <= refs.t GROUP BY ALL),
  ta AS (SELECT moment, path, m.e AS a FROM ha WHERE NOT m.dead), tb AS (SELECT moment, path, m.e AS b FROM hb WHERE NOT m.dead),
  j AS (SELECT moment, path, CASE WHEN a IS NULL THEN 'right_only' WHEN b IS NULL THEN 'left_only' WHEN a <> b THEN 'differs' END AS status FROM ta FULL JOIN tb USING (moment, path))
  SELECT 'day-' || moment AS ref, path, status FROM j WHERE status IS NOT NULL AND NOT regexp_matches(path, '/u7[.]c$')""")
def verify_all_refs(spark, sf_dir):
    """A history against a copy that has lost revisions, at the end of every day."""
    rows = revision_log(spark, sf_dir)
    refs = rows.select(((F.floor(F.col("t") / ordered.DAY) + 1) * ordered.DAY).alias("t")).distinct().select(F.concat(F.lit("day-"), F.col("t").cast("string")).alias("ref"), "t")
    copies = [trees.tree_intervals(x).select("path", F.col("event_id").alias("content"), "from_t", "to_t") for x in (rows, rows.filter("event_id % 13 <> 0"))]
    return verify.compared_refs(*copies, refs, ignore=("u7.c",))


@query(f"WITH {COPIES} SELECT status, count(*) AS files FROM c WHERE status IS NOT NULL GROUP BY status")
def verify_manifest(spark, sf_dir):
    return verify.summary(two_copies(spark, sf_dir))


@query("SELECT source, count(*) AS files, sum(octet_length(encode(text)))::BIGINT AS bytes, max(length(text)) AS longest FROM documents GROUP BY source")
def run_stats(spark, sf_dir):
    size = F.octet_length("text")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"), F.max(F.length("text")).cast("long").alias("longest"))


# Orders, sources


@query(f"WITH {NUMBERS} SELECT number, row_number() OVER (ORDER BY len(rev), rev) AS place FROM n")
def node_order(spark, sf_dir):
    """Revision numbers by their length, then by their components."""
    return ordered.numbered(numbers(spark, sf_dir), [orders.node_key(F.col("rev"))], "place").select("number", "place")


@query(f"""WITH {RL}, e AS (SELECT author, path, max(CASE WHEN NOT dead THEN t END) AS t, bool_or(commitid IS NOT NULL) AS tailed FROM rl GROUP BY ALL)
  SELECT author, path, t, tailed, row_number() OVER (PARTITION BY author ORDER BY t IS NULL, tailed, t DESC, path) AS place FROM e""")
def join_order(spark, sf_dir):
    """Each author's files as a branch join takes them: those without a live revision last, then
    those on a shared tail, the newest first; ties by path."""
    rows = unnumbered_log(spark, sf_dir).groupBy("author", "path").agg(F.max(F.when(~F.col("dead"), F.col("t"))).alias("t"), F.bool_or(F.col("commitid").isNotNull()).alias("tailed"))
    key = orders.join_key(F.col("t"), F.col("tailed"))
    return ordered.numbered(rows, [key, F.col("path")], "place", ["author"])


@query(r"""WITH p AS (SELECT page_id, (['cvs.sourceforge.net', 'p.cvs.sourceforge.net', 'cvs.berlios.de', 'sourceware.org', 'cvs.savannah.gnu.org', 'example.org'])[page_id % 6 + 1] AS host,
    CASE page_id % 4 WHEN 0 THEN '/cvsroot' WHEN 1 THEN '/sources' ELSE '' END || '/' || split_part(url, '/', 3) || CASE WHEN page_id % 5 = 0 THEN '/p' ELSE '' END AS path, 'm' || page_id % 7 AS module FROM pages),
  r AS (SELECT *, CASE WHEN path LIKE '/cvsroot%' THEN path ELSE '/cvsroot' || path END AS root FROM p)
  SELECT page_id, CASE page_id % 6 WHEN 2 THEN 'cvs.berlios.de::' || module || '_cvs' WHEN 3 THEN 'sourceware.org::' || split_part(path, '/', 3) || '-cvs/' || module || '/'
    WHEN 4 THEN 'rsync://vcs.savannah.gnu.org' || CASE WHEN path LIKE '/sources%' THEN path ELSE '/sources' || path END || '/' || module || '/' WHEN 5 THEN host || ':' || path || '/' || module || '/'
    ELSE CASE WHEN starts_with(host, string_split(root, '/')[-1] || '.') THEN '' ELSE string_split(root, '/')[-1] || '.' END || host || '::' || root[2:] || '/' || module || '/' END AS source FROM r""")
def mirror_sources(spark, sf_dir):
    """Where modules are mirrored from, by the kind of their host."""
    hosts = ("cvs.sourceforge.net", "p.cvs.sourceforge.net", "cvs.berlios.de", "sourceware.org", "cvs.savannah.gnu.org", "example.org")
    at = F.col("page_id")
    host = F.get(F.array(*[F.lit(h) for h in hosts]), (at % 6).cast("int"))
    path = F.concat(F.when(at % 4 == 0, "/cvsroot").when(at % 4 == 1, "/sources").otherwise(""), F.lit("/"), F.split_part("url", F.lit("/"), F.lit(3)), F.when(at % 5 == 0, "/p").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", text.mirror_source(host, path, F.concat(F.lit("m"), (at % 7).cast("string"))).alias("source"))


@query(f"""WITH {RL}, m AS (SELECT 'a' || c_custkey AS name, c_name AS "full", lower(c_mktsegment) || '@example.org' AS email, CASE WHEN c_custkey % 2 = 0 THEN '+0' || c_nationkey % 10 || '00' END AS zone FROM customer WHERE c_custkey % 3 <> 0)
  SELECT author, coalesce("full", author) AS full_name, coalesce(email, author) AS email, coalesce(zone, 'UTC') AS zone, count(*) AS revisions FROM rl LEFT JOIN m ON author = name GROUP BY ALL""")
def author_map_file(spark, sf_dir):
    """Authors by a map that is written as a file and read again, comments and lines of another
    form among it."""
    name, third = F.concat(F.lit("a"), F.col("c_custkey").cast("string")), F.col("c_custkey") % 3
    zone = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" +0"), (F.col("c_nationkey") % 10).cast("string"), F.lit("00"))).otherwise("")
    line = F.concat(F.when(third == 0, "# ").otherwise(""), name, F.when(third == 1, "=").otherwise(" = "), "c_name", F.lit(" <"), F.lower("c_mktsegment"), F.lit("@example.org>"), zone)
    lines = table(spark, sf_dir, "customer").select(F.explode(F.array(line, F.when(third == 1, F.concat(name, F.lit(" has no mail"))).otherwise(""))).alias("value"))
    folder = f"{shared.shared_root(spark)}/author-map-{uuid.uuid4().hex}"
    lines.write.text(folder)
    counted = unnumbered_log(spark, sf_dir).groupBy("author").agg(F.count(F.lit(1)).alias("revisions"))
    return emit.author_columns(counted, author_map(spark, folder)).select("author", F.col("full").alias("full_name"), "email", "zone", "revisions")
