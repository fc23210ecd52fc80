"""Sort keys against the orders they stand for, with ties, nulls and gaps."""

import functools
import random

import pytest
from pyspark.sql import functions as F

from masters import master
from revloom.functions import revnum, text
from revloom.operators import orders
from revloom.plans import emit
from revloom.plans.history import History
from revloom.sources.masters import MasterError, Masters


def test_number_keys(spark):
    draw = random.Random(3)
    numbers = {tuple(draw.choice((0, 1, 2, 10, 255, 256, 70_000)) for _ in range(draw.choice((1, 2, 4, 6)))) for _ in range(300)} | {(-1,), (1, -1)}
    rows = spark.createDataFrame([(list(n),) for n in numbers], "rev array<int>")
    got = [tuple(r.rev) for r in rows.orderBy(orders.node_key(F.col("rev"))).collect()]
    assert got == sorted(numbers, key=lambda n: (len(n), n))
    got = [tuple(r.rev) for r in rows.orderBy(orders.component_key(F.col("rev"))).collect()]
    assert got == sorted(numbers)


def test_entries_where_branches_join(spark):
    entries = [(1, 50, False), (2, None, True), (3, 50, True), (4, 60, None), (5, None, False), (6, 50, False), (7, 40, False)]

    def compare(a, b):
        if (a[1] is None) != (b[1] is None):
            return 1 if a[1] is None else -1
        if bool(a[2]) != bool(b[2]):
            return 1 if a[2] else -1
        return ((b[1] or 0) - (a[1] or 0)) or a[0] - b[0]

    rows = spark.createDataFrame(entries, "id int, t long, tailed boolean")
    got = [r.id for r in rows.orderBy(orders.join_key(F.col("t"), F.col("tailed")), "id").collect()]
    assert got == [e[0] for e in sorted(entries, key=functools.cmp_to_key(compare))] == [4, 1, 6, 7, 3, 5, 2]


def test_heads_of_files(spark):
    heads = spark.createDataFrame([(1, "B"), (1, "A"), (1, "master"), (1, "x-UNNAMED"), (2, "A"), (3, "V")], "master_id long, ref_name string")
    named = [(1, "B", [1, 1, 0, 2], 0), (1, "A", [1, 1, 0, 10], 1), (2, "A", [1, 4], 0), (3, "V", [1, 1, 1], 0)]
    symbols = spark.createDataFrame(named, "master_id long, name string, rev array<int>, pos int")
    got = {(r.master_id, r.ref_name): r.place for r in orders.placed_heads(heads, symbols).collect()}
    assert got == {(1, "master"): 1, (1, "x-UNNAMED"): 2, (1, "B"): 3, (1, "A"): 4, (2, "A"): 1, (3, "V"): 1}
    assert orders.placed_heads(heads.limit(0), symbols).count() == 0


@pytest.mark.parametrize(
    ("host", "path", "want"),
    [
        ("cvs.sourceforge.net", "/p", "p.cvs.sourceforge.net::cvsroot/p/m/"),
        ("p.cvs.sourceforge.net", "/cvsroot/p", "p.cvs.sourceforge.net::cvsroot/p/m/"),
        ("cvs.berlios.de", "/any", "cvs.berlios.de::m_cvs"),
        ("sourceware.org", "/cvs/gdb", "sourceware.org::gdb-cvs/m/"),
        ("sourceware.org", "/cvs", "sourceware.org::-cvs/m/"),
        ("cvs.savannah.gnu.org", "/p", "rsync://vcs.savannah.gnu.org/sources/p/m/"),
        ("example.org", "/a/b", "example.org:/a/b/m/"),
        (None, "/a", None),
    ],
)
def test_mirror_sources(spark, host, path, want):
    rows = spark.createDataFrame([(host, path, "m")], "h string, p string, m string")
    assert rows.select(text.mirror_source("h", "p", "m").alias("s")).first().s == want


def test_bad_names_and_odd_numbers_are_reported(spark):
    deltas = [{"number": "1.2", "date": "2020.01.02.00.00.00", "text": "b\n", "next": "1.1"}, {"number": "1.1", "date": "2020.01.03.00.00.00", "text": "d1 1\na1 1\na\n", "author": "an..n"}]
    files = spark.createDataFrame([("f,v", bytearray(master(deltas, {"ok": "1.1", "a..b": "1.1"})))], "path string, content binary")
    masters = Masters(files)
    assert {r.problem for r in masters.problems.collect()} == {"bad reference name: a..b", "bad author or state: an..n"}
    assert [r.name for r in masters.symbols.collect()] == ["ok"]
    with pytest.raises(MasterError, match="bad"):
        Masters(files, strict=True)
    history = History(masters)
    assert {r.kind for r in emit.problems(history).collect()} >= {"unreadable", "date repaired"}
    found = {r.name: r.value for r in emit.statistics(history).collect()}
    assert found["files"] == 1 and found["revisions"] == 2 and found["changesets"] == 2 and all(found[f"seconds: {p}"] > 0 for p in history.phases) and len(history.phases) == 5
