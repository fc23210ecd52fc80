"""Two histories at all their refs, against a look at each."""

import random

from pyspark.sql import functions as F

from revloom.operators import verify

SCHEMA = "path string, content string, from_t long, to_t long"


def histories(rng):
    out = []
    for _ in range(2):
        rows = []
        for d in range(4):
            for f in range(6):
                t = rng.randint(0, 50) if d else 7 * f
                while t < 400:
                    end = t + (rng.randint(1, 120) if d else 60)
                    rows.append((f"d{d}/f{f}", f"v{rng.randint(0, 3)}" if d else f"v{t}", t, end))
                    t = end + (rng.choice([0, 0, 15]) if d else 0)
        out.append(rows)
    return out


def test_compared_refs(spark):
    left, right = histories(random.Random(2))
    hidden = [("d1/.gitignore", "x", 0, 500), ("CVS/Root", "y", 0, 500)]
    refs = [(f"r{t}", t) for t in range(-5, 500, 9)] + [("same time", 4)]
    want = set()
    at = lambda rows, t: {p: c for p, c, a, b in rows if a <= t < b}
    for ref, t in refs:
        a, b = at(left, t), at(right, t)
        for p in a.keys() | b.keys():
            if a.get(p) != b.get(p):
                want.add((ref, p, "right_only" if p not in a else "left_only" if p not in b else "differs"))
    a, b = spark.createDataFrame(left + hidden, SCHEMA), spark.createDataFrame(right, SCHEMA)
    got = verify.compared_refs(a, b, spark.createDataFrame(refs, "ref string, t long"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "d0" not in {r.folder for r in verify.changing_folders(a.filter("path like 'd%'"), b).collect()}
    assert verify.compared_refs(a, a, spark.createDataFrame(refs, "ref string, t long")).count() == 0


def test_visible(spark):
    rows = spark.createDataFrame([("a/b.c",), ("a/.cvsignore",), (".gitignore",), ("a/CVS/Root",), ("CVSROOT/x",)], "p string")
    assert {r.p for r in rows.filter(verify.visible(F.col("p"))).collect()} == {"a/b.c", "CVSROOT/x"}
