"""Secret scans over an incremental blob ledger.

Every version of a path is addressed by the digest of its content.  A blob is scanned by
a rule version once, ever: pairs found in the ledger are left out, and what the scan
finds (also when it is nothing) goes into the ledger.  Findings then join back to every
path that holds the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revloom.llm.common import fresh_folder, materialize, quoted, salted_join, text_or_empty


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches, leftmost and non-overlapping; those whose group
    ``group`` (0: the whole match) has under ``least`` characters are dropped."""

    kind: str
    version: str
    pattern: str
    least: int = 0
    group: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed values.  A run of hex digits, or of capitals and digits after AKIA, is matched
#: whole or not at all, so its least length may stand in the pattern; the assigned value's
#: may not, as a shorter one would let the search resume inside the dropped match.
RULES = (
    Rule("assign", "1", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", "1", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", "1", r"[0-9a-f]{32,}"),
)

FINDINGS = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def matches(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule's matches, in code points, end exclusive.

    The pieces between matches and the matches themselves alternate, so their running
    lengths are the positions.  Spans are appended to the list of a run of matches, and these
    lists to one another; as many runs as a run has matches keep the copying low in a text
    with any number of matches.
    """
    pieces, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    triples = F.arrays_zip(pieces.alias("p"), found.alias("f"), values.alias("v"))
    none = F.array().cast(FINDINGS)

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["p"])
        end = begin + F.coalesce(F.length(x["f"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        good = x["f"].isNotNull() & (F.length(x["v"]) >= rule.least)
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def run(acc: Column, some: Column) -> Column:
        begin = F.struct(acc["at"].alias("at"), none.alias("out"))
        return F.aggregate(some, begin, step, lambda a: F.struct(a["at"].alias("at"), F.concat(acc["runs"], F.array(a["out"])).alias("runs")))

    def spans(found: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(found))).cast("int")
        runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size(found) / size).cast("int") - 1), lambda i: F.slice(found, i * size + 1, size))
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{FINDINGS}>").alias("runs"))
        return F.aggregate(runs, start, run, lambda a: F.flatten(a["runs"]))

    # a lambda's variable is computed once, an expression inside one for every element
    return F.when(text.rlike(rule.pattern), F.get(F.transform(F.array(triples), spans), 0)).otherwise(none)


class Ledger:
    """What was found in which blob by which rule version, as Parquet files in a folder.

    A scan appends its rows in one commit; a scan that is run again, or two at once, may
    append a pair twice with the same findings.
    """

    SCHEMA = f"blob string, rule string, findings {FINDINGS}"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        none = spark.range(0)
        self.append(none.select(*[F.lit(None).cast(t).alias(n) for n, t in (("blob", "string"), ("rule", "string"), ("findings", FINDINGS))]))

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.folder)

    def read(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder).filter(F.col("rule").isin([r.key for r in rules]))


def scan_blobs(blobs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, rule, findings) for the pairs of blob and rule version that
    ``ledger`` lacks.  ``blobs`` has distinct (blob, content)."""
    done = ledger.groupBy("blob").agg(F.collect_set("rule").alias("done"))
    todo = blobs.join(done, "blob", "left").withColumn("done", F.coalesce("done", F.array().cast("array<string>")))
    per_rule = F.array(*[F.when(~F.array_contains("done", r.key), F.struct(F.lit(r.key).alias("rule"), matches(F.col("content"), r, i).alias("findings"))) for i, r in enumerate(rules)])
    return todo.select("blob", F.inline(F.filter(per_rule, lambda x: x.isNotNull())))


def versions_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    content = text_or_empty(quoted(text_col))
    return docs.select(quoted(id_col).alias("doc_id"), content.alias("content")).withColumn("blob", F.sha2("content", 256))


def scan_versions(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Scan what ``ledger`` doesn't know of the versions in ``docs`` and add it.

    A blob is reduced to one row by its address before it is shuffled, and only then met
    with the ledger.
    """
    blobs = versions_of(docs, id_col, text_col).groupBy("blob").agg(F.first("content").alias("content"))
    ledger.append(scan_blobs(blobs, ledger.read(rules), rules))


def findings(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, blob and spans, an array in order of start, then of the rules: what the ledger
    has of each row of ``docs``.

    Null text counts as empty and has no findings; repeated ids and texts give a row each;
    an empty table gives none.  Only the id and text columns are read.  Paths that share
    a hot blob are dealt over salts.
    """
    paths = materialize(versions_of(docs, id_col, text_col).select("doc_id", "blob"))
    found = ledger.read(rules).filter(F.size("findings") > 0).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_set("findings"))).alias("spans"))
    joined = salted_join(paths, found, "blob", F.xxhash64("doc_id"))
    return joined.select("doc_id", "blob", F.coalesce("spans", F.array().cast(FINDINGS)).alias("spans"))


def arrivals_of(docs: DataFrame, arrivals: int, id_col: str = "doc_id") -> list[DataFrame]:
    """All rows of ``docs``, dealt over so many arrivals by a hash of the id."""
    turn = F.pmod(F.xxhash64(quoted(id_col)), F.lit(arrivals))
    return [docs.filter(turn == k) for k in range(arrivals)]


def rendered(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: Ledger | None = None, arrivals: int = 2) -> DataFrame:
    """Counts and span digests per row of ``docs``, which come in so many arrivals: each is
    scanned for what the ledger doesn't know yet, and the findings join all rows.

    A null text counts as empty; texts without a finding have zeros, the digest of nothing
    and empty spans; repeated ids and texts give a row each, an empty table none; texts of
    any length are read whole, and columns besides doc_id and text aren't read.
    """
    spark = docs.sparkSession
    ledger = ledger or Ledger(spark, fresh_folder(spark, "ledger"))
    for part in arrivals_of(docs, arrivals):
        scan_versions(part, ledger, rules)
    found = findings(docs, ledger, rules)
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(rendered(base), 256).alias("base_sha256"), rendered(F.col("spans")).alias("spans"))
