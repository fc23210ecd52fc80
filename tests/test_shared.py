"""Tables that several steps read are computed once, and keys stay whole."""

import pandas as pd
from pyspark.sql import functions as F

from revloom.operators import filetrees, forest, keywords, replay, shared
from revloom.operators.changesets import Frontier, Revision
from revloom.operators.shared import materialize
from revloom.sources import masters


def counted(rows, spark):
    """``rows``, and an accumulator of how many of them were computed."""
    n = spark.sparkContext.accumulator(0)

    def see(batches):
        for pdf in batches:
            n.add(len(pdf))
            yield pdf

    return rows.mapInPandas(see, rows.schema), n


def test_materialized_once(spark):
    rows, n = counted(spark.range(100), spark)
    table = materialize(rows)
    assert table.count() == 100 and table.agg(F.sum("id")).first()[0] == 4950
    assert n.value == 100


def test_trees_read_their_nodes_once(spark):
    chain = spark.range(40).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(0).cast("long").alias("t"), F.lit("a").alias("author"), F.lit("l").alias("log"))
    rows, n = counted(chain, spark)
    assert sorted(tuple(r) for r in forest.ordered_commits(rows).collect()) == [(i, i) for i in range(40)]
    assert n.value == 40
    rows, n = counted(chain, spark)
    assert {r["first"] for r in forest.first_of_history(rows, F.col("node")).collect()} == {0}
    assert n.value == 40


def test_chains_stay_whole_where_a_join_turns_into_a_broadcast(spark):
    # planned as a sort-merge join and turned at run time, its rows read where they lie
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    rows = []
    for i in range(60):
        rows += [(i, f"1.{k}", "".join(f"{i} {k} {j}\n" for j in range(k)) if k == 6 else f"d1 {k + 1}\na{k + 1} {k}\n" + "".join(f"{i} {k} {j}\n" for j in range(k))) for k in range(1, 7)]
        rows.append((i, "1.1.2.1", "a1 1\nbranched\n"))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        deltas = spark.createDataFrame([(i, n, bytearray(e.encode()), False, "b") for i, n, e in rows], "master_id long, number string, edit_text binary, dead boolean, mode string").repartition(4)
        got = {(r.master_id, r.number): bytes(r.content).decode() for r in replay.snapshots(deltas).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = {(i, f"1.{k}"): "".join(f"{i} {k} {j}\n" for j in range(k)) for i in range(60) for k in range(1, 7)}
    assert got == want | {(i, "1.1.2.1"): f"{i} 1 0\nbranched\n" for i in range(60)}


def test_leaders_look_at_the_newest_of_their_paths_only():
    # one dense window: a lookup of all held revisions would take millions of steps
    steps = 0

    class Counted(Revision):
        __slots__ = ()

        @property
        def key(self):
            nonlocal steps
            steps += 1
            return self.author, self.log

    class Paths(dict):
        def __getitem__(self, path):
            nonlocal steps
            steps += 1
            return super().__getitem__(path)

    n = 3000
    frontier = Frontier(3600, None, True)
    frontier.by_path = Paths()
    found = []
    for i in range(n):
        found += frontier.feed(Counted(n - i, 5000 - i // 4, f"p{i % 3}", "a", "l", None, True))
    found += frontier.finish()
    assert [len(members) for _, members in found] == [3] * (n // 3)
    assert steps < 10 * n


def small(frames, column):
    sizes = [frame[column].map(len).sum() for frame in frames]
    assert len(sizes) > 3 and max(sizes) < 2 * shared.BATCH
    return sum(sizes)


def test_expanded_batches_are_given_out_in_pieces():
    n = 400  # 8 MB become over 40
    row = {"content": b"$Revision$\n" * 2000, "mode": "kv", "path": "f,v", "number": "1." + "1" * 100, "t": 0, "author": "a", "state": "Exp", "log": "l"}
    frames = list(keywords.expander("doc_id")(iter([pd.DataFrame([row | {"doc_id": i} for i in range(n)])])))
    assert [i for frame in frames for i in frame["doc_id"]] == list(range(n))
    assert small(frames, "content") == n * 2000 * (len("$Revision:  $\n") + 102)


def test_wanted_deltas_are_read_a_few_times(spark):
    rows = [(i, f"1.{k}", b"x\n" if k == 9 else b"d1 1\na1 1\n%d\n" % k) for i in range(5) for k in range(1, 10)]
    rows += [(i, "1.2.2.1", b"a1 1\nbranched\n") for i in range(5)]
    deltas = spark.createDataFrame(rows, "master_id long, number string, edit_text binary").withColumns({"dead": F.lit(False), "mode": F.lit("b")})
    deltas, n = counted(deltas, spark)
    wanted = spark.createDataFrame([(i, number) for i in range(5) for number in ("1.3", "1.2.2.1")], "master_id long, number string")
    got = {(r.master_id, r.number): bytes(r.content) for r in replay.snapshots(deltas, wanted, segment=3).collect()}
    assert got == {(i, "1.3"): b"3\n" for i in range(5)} | {(i, "1.2.2.1"): b"2\nbranched\n" for i in range(5)}
    assert n.value <= 2 * len(rows)


def test_short_segments_are_composed_and_walked_many_at_a_time():
    edits = pd.DataFrame([(i, "", s, b"x\n" if s == 0 else b"a1 1\ny\n") for i in range(1000) for s in (0, 1)], columns=[*replay.GROUP, "edit_text"])
    (composed,) = replay.composer(iter([edits]))
    (walked,) = replay.walker(iter([composed.assign(base=None)]))
    assert [tuple(r) for r in walked.itertuples(index=False)] == [(i, "", 1, b"x\n") for i in range(1000)]


def test_parsed_batches_are_given_out_in_pieces():
    text = b"line\n" * 10_000
    content = b"head\t1.1;\naccess;\nsymbols;\nlocks;\n\n\n1.1\ndate\t2001.01.01.00.00.00;\tauthor a;\tstate Exp;\nbranches;\nnext\t;\n\n\ndesc\n@@\n\n1.1\nlog\n@l\n@\ntext\n@" + text + b"@\n"
    frames = list(masters.parsed(iter([pd.DataFrame({"path": [f"{i},v" for i in range(400)], "content": [content] * 400})])))
    assert [path for frame in frames for path in frame["path"]] == [f"{i},v" for i in range(400)]
    texts = [frame.assign(edit=frame["deltas"].map(lambda d: d[0]["edit_text"])) for frame in frames]
    assert small(texts, "edit") == 400 * len(text)


def test_file_revisions_read_their_deltas_once(spark):
    rows = [(m, f"f{m}", [1, k], 1000 * k, "a", "l", None, False, "Exp", b"text") for m in range(3) for k in (1, 2, 3)] + [(0, "f0", [1, 1, 2, 1], 1500, "a", "l", None, False, "Exp", b"text")]
    deltas, n = counted(spark.createDataFrame(rows, "master_id long, fileop_path string, rev array<int>, t long, author string, log string, commitid string, dead boolean, state string, edit_text binary"), spark)
    symbols = spark.createDataFrame([(0, "BR", [1, 1, 0, 2], 0)], "master_id long, name string, rev array<int>, pos int")
    found = filetrees.file_revisions(deltas, symbols)
    assert {(r.master_id, tuple(r.rev)): (r.branch, r.parent_rev) for r in found.collect()} == {(m, (1, k)): ("master", [1, k - 1] if k > 1 else None) for m in range(3) for k in (1, 2, 3)} | {(0, (1, 1, 2, 1)): ("BR", [1, 1])}
    assert n.value == len(rows)
    assert "edit_text" not in found.columns
