"""Operators against plain models."""

import random

import pytest
from pyspark.sql import functions as F

from revloom.functions import paths, revnum, text
from revloom.operators import branches, changesets, ordered, repair, replay
from revloom.operators.keywords import expanded


def greedy(rows, window):
    """The grouping, step by step over whole files."""
    files = {}
    for r in sorted(rows, key=lambda r: (r["t"], r["event_id"])):
        files.setdefault(r["path"], []).append(r)
    for path, revs in files.items():
        if len(revs) > 1 and revs[0]["dead"]:
            files[path] = revs[1:]
            revs = files[path]
        for i, r in enumerate(revs):
            r["alive"] = not r["dead"] or i > 0 or r is not min((x for x in rows if x["path"] == path), key=lambda x: (x["t"], x["event_id"]))
    out, first = [], True
    while True:
        front = {p: revs[-1] for p, revs in files.items() if revs}
        if not front or not (first or any(r["alive"] for r in front.values())):
            return out
        first = False
        lead = min(front.values(), key=lambda r: (-r["t"], r["path"], -r["event_id"]))
        same = lambda r: (r["commitid"] == lead["commitid"]) if r["commitid"] is not None and lead["commitid"] is not None else r["commitid"] is None and lead["commitid"] is None and r["author"] == lead["author"] and r["log"] == lead["log"]
        members = [r for r in front.values() if lead["t"] - r["t"] < window and same(r)]
        for r in members:
            files[r["path"]].pop()
        out.append((lead["event_id"], sorted(r["event_id"] for r in members)))


@pytest.mark.parametrize(("seed", "chunk"), [(0, changesets.CHUNK), (1, 5), (2, 2)])
def test_frontier_changesets_like_the_model(spark, seed, chunk):
    rng = random.Random(seed)
    rows, want, event = [], set(), 0
    for branch in range(60):
        own, t = [], 0
        for _ in range(rng.randint(1, 18)):
            t += rng.choice([0, 20, 100, 200, 290, 300, 500, 900])
            own.append(dict(branch=f"b{branch}", path=f"p{rng.randint(0, 3)}", event_id=event, t=t, author=rng.choice("xy"), log=rng.choice("lm"), commitid=rng.choice([None, None, "c1", "c2"]), dead=rng.random() < 0.2))
            event += 1
        rows += own
        want |= {(f"b{branch}", lead, tuple(members)) for lead, members in greedy([dict(r) for r in own], 300)}
    df = spark.createDataFrame(rows, "branch string, path string, event_id long, t long, author string, log string, commitid string, dead boolean")
    got = changesets.frontier_changesets(df, 300, chunk=chunk).groupBy("branch", "leader_id").agg(F.sort_array(F.collect_list("event_id")).alias("m")).collect()
    assert {(r.branch, r.leader_id, tuple(r.m)) for r in got} == want


def test_a_dense_history_in_chunks_like_the_sequential_fold(spark):
    """One epoch of 100,000 revisions: chunks folded at once give what one fold gives."""
    rng = random.Random(11)
    rows, t = [], 0
    for i in range(100_000):
        t += rng.choice([0, 5, 10, 30])
        rows.append((i, t, f"p{rng.randint(0, 400)}", rng.choice("abcdefg"), rng.choice("lmnop"), rng.choice([None, None, f"c{i // 50}"]), rng.random() < 0.1))
    frontier, want = changesets.Frontier(300, (0, "", 1), True), {}
    fed = [changesets.Revision(i, t, p, a, m, c, True) for i, t, p, a, m, c, _ in sorted(rows, key=lambda r: (-r[1], r[2], -r[0]))]
    for found in [*(f for r in fed for f in frontier.feed(r)), *frontier.finish()]:
        want[found[0].event_id] = sorted(m.event_id for m in found[1])
    df = spark.createDataFrame(rows, "event_id long, t long, path string, author string, log string, commitid string, dead boolean").withColumns({"branch": F.lit("b"), "keeps_alive": F.lit(True)})
    found = changesets.frontier_changesets(df, 300, prepared=True, chunk=8_000)
    assert found.groupBy("leader_id").agg(F.sort_array(F.collect_list("event_id")).alias("m")).rdd.map(tuple).collectAsMap() == want
    assert df.count() == found.count() and len(want) > 1000


def test_chunks_whose_guess_is_wrong_are_folded_again(spark, monkeypatch):
    monkeypatch.setattr(changesets, "WARM", 0)
    rng = random.Random(12)
    rows = [dict(branch="b", path=f"p{rng.randint(0, 5)}", event_id=i, t=i * 40, author=rng.choice("xy"), log="l", commitid=None, dead=i < 3) for i in range(300)]
    want = {(lead, tuple(members)) for lead, members in greedy([dict(r) for r in rows], 300)}
    df = spark.createDataFrame(rows, "branch string, path string, event_id long, t long, author string, log string, commitid string, dead boolean")
    for size in (60, 20):
        got = changesets.frontier_changesets(df, 300, chunk=size).groupBy("leader_id").agg(F.sort_array(F.collect_list("event_id")).alias("m")).collect()
        assert {(r.leader_id, tuple(r.m)) for r in got} == want


def test_running_sums_and_neighbours_cross_buckets(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randint(0, 900_000), i, rng.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t long, i long, v long").withColumn("day", ordered.day_of("t"))
    got = ordered.running(df, ["k"], "day", [F.col("t"), F.col("i")], {"s": F.col("v")})
    got = ordered.with_neighbour(got, ["k"], "day", [F.col("t"), F.col("i")], {"before": "i"})
    got = {r.i: (r.s, r.before) for r in ordered.with_neighbour(got, ["k"], "day", [F.col("t"), F.col("i")], {"after": "i"}, following=True).filter("before is null or after is null or true").collect()}
    for key in "ab":
        total, last = 0, None
        for _, t, i, v in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            total += v
            assert got[i] == (total, last)
            last = i


def test_as_of_join(spark):
    rng = random.Random(6)
    left = [(rng.choice("ab"), rng.randint(0, 900_000), i) for i in range(100)]
    right = [(rng.choice("ab"), rng.randint(0, 900_000), i + 1000, f"v{i}") for i in range(100)]
    a = spark.createDataFrame(left, "k string, t long, event_id long")
    b = spark.createDataFrame(right, "k string, t long, event_id long, v string")
    got = {r.event_id: r.v for r in branches.as_of_backward(a, b, ["k"], ["v"]).collect()}
    for k, t, i in left:
        found = max(((r[1], r[2], r[3]) for r in right if r[0] == k and r[1] <= t), default=(0, 0, None))
        assert got[i] == found[2]


def test_date_repair_rules():
    def run(newest_first):
        state, out = repair.Repair(), []
        for i, d in enumerate(newest_first):
            out += state.feed(i, d)
        return [d for _, d in [*out, *state.finish()]]

    assert run([100, 90, 80]) == [100, 90, 80]
    assert run([100, 150, 80]) == [100, 100, 80]  # the parent is pulled back
    assert run([100, 50, 90]) == [100, 90, 90]  # the odd one out moves up


def test_replay_inverts_edits(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(8):
        texts.append("".join(rng.choice(["a\n", "b\n", "c c\n", "\n"]) for _ in range(rng.randint(0, 12))) + rng.choice(["", "end"]))
    rows = [(m, i, x) for m in (1, 2) for i, x in enumerate(texts[m:])]
    df = spark.createDataFrame(rows, "m long, i long, x string")
    scripts = replay.scripts_between(df, "m", "i", "x").select("master_id", "number", "edit_text", F.lit(False).alias("dead"), F.lit("b").alias("mode"))
    got = {(r.master_id, int(r.number[2:]) - 1): bytes(r.content).decode() for r in replay.snapshots(scripts).collect()}
    assert got == {(m, i): x for m, i, x in rows}
    with pytest.raises(replay.CorruptDelta):
        replay.apply_edit([b"x\n"], b"d3 1\n")


class Row:
    t, author, state, number, path, log = 978_307_200, "ann", "Exp", "1.3", "dir/f x.c,v", "why\n\nso\n"


def test_keywords():
    assert expanded(b"$Revision$ $Id: old $ $Nope$ $Log", Row, "kv") == b"$Revision: 1.3 $ $Id: f\\040x.c,v 1.3 2001/01/01 00:00:00 ann Exp $ $Nope$ $Log"
    assert expanded(b"$Name$Author$", Row, "kv") == b"$Name:  $Author: ann $"
    assert expanded(b"$Revision: 9 $", Row, "k") == b"$Revision$" and expanded(b"$Revision$", Row, "v") == b"1.3" and expanded(b"$Id$", Row, "o") == b"$Id$"
    assert expanded(b"/* $Log$\n", Row, "kv") == b"/* $Log: f\\040x.c,v $\n * Revision 1.3  2001/01/01 00:00:00  ann\n * why\n *\n * so\n *\n"


def test_column_functions(spark):
    row = spark.range(1).select(
        paths.rectified(F.lit("p/Attic/RCS/a/x,v"), "p/").alias("path"),
        revnum.render(revnum.branch_key(revnum.parse(F.lit("1.2.0.4")))).alias("key"),
        text.log_label(F.lit('Fix "it" (now). More')).alias("label"),
        F.unix_timestamp(text.rcs_timestamp(F.lit("97.04.06.08.41.11"))).alias("date"),
        text.author_stamp(F.timestamp_seconds(F.lit(1143964799)), F.lit("CST6CDT")).alias("stamp"),
    ).first()
    assert row.path == "a/x" and row.key == "1.2.4" and row.label == 'Fix \\"it\\" now.'
    assert row.date == 860316071 and row.stamp == "1143964799 -0600"
    assert text.command_date("2001-01-01T00:00:00 +0100") == 978_303_600 and text.command_date("77") == 77


def test_absolute_paths(spark):
    names = ["a/b", "./a", ".//./b", "/x/y", "..", ".hidden"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert [r.p for r in df.select(paths.absolute("p", "/r/").alias("p")).collect()] == ["/r/a/b", "/r/a", "/r/b", "/x/y", "/r/..", "/r/.hidden"]


def test_deep_order(spark):
    names = ["a/b/c", "a/x", "a/b", "b", "a/b/d/e", "z/y"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert [r.p for r in df.orderBy(paths.deep_key("p")).collect()] == ["a/b/d/e", "a/b/c", "a/b", "a/x", "z/y", "b"]
