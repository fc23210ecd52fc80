"""Queries that leave nothing out, against models over all rows."""

import hashlib

from revloom.plans import catalogue
from revloom.sources.revision_log import table, unnumbered_log

SF = "/root/testdata/sf0.001"


def test_keyword_value_escapes(spark, tmp_path):
    texts = {1: "a b\t$\\\n" * 100, 2: "x" * 200 + " tail $", 3: None, 4: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    escape = str.maketrans({"\\": "\\\\", "\t": "\\t", "\n": "\\n", " ": "\\040", "$": "\\044"})
    values = {k: x and x.translate(escape) for k, x in texts.items()}
    want = {k: (None, None) if v is None else (len(v), hashlib.md5(v.encode()).hexdigest()) for k, v in values.items()}
    got = catalogue.QUERIES["keyword_value_escapes"](spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.length, r.digest) for r in got} == want


def test_reduce_logs(spark):
    want = {r.doc_id: r.text and hashlib.md5(r.text.encode()).hexdigest() for r in table(spark, SF, "documents").collect()}
    assert {r.doc_id: r.log for r in catalogue.QUERIES["reduce_logs"](spark, SF).collect()} == want


def test_ancestor_refcount(spark):
    want = {}
    for node in sorted(r.p_partkey for r in table(spark, SF, "part").collect()):
        at = node
        while True:
            want.setdefault(at, []).append(node)
            if not at:
                break
            at //= 2
    got = catalogue.QUERIES["ancestor_refcount"](spark, SF).collect()
    assert {r.node: (r.refs, r.owner) for r in got} == {k: (len(v), v[0]) for k, v in want.items()}


def test_author_map_join(spark):
    names = {f"a{r.c_custkey}": r.c_name for r in table(spark, SF, "customer").collect()}
    got = {r.author: r.full_name for r in catalogue.QUERIES["author_map_join"](spark, SF).collect()}
    assert got == {a: names.get(a, a) for a in got} and got["a6"] != "a6"


def test_branch_point_by_meta(spark):
    rows = unnumbered_log(spark, SF).select("event_id", "author", "log", "t").collect()
    found = {b.event_id: max(((v.t, v.event_id) for v in rows if v.event_id != b.event_id and (v.author, v.log) == (b.author, b.log) and abs(v.t - b.t) < 1800), default=None) for b in rows}
    got = catalogue.QUERIES["branch_point_by_meta"](spark, SF).collect()
    assert {r.event_id: (r.found_t, r.found_id) for r in got} == {k: v for k, v in found.items() if v}
    assert {b % 2 for b in found if found[b]} == {0, 1}
