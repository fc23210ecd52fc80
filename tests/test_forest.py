"""Trees by doubling, against walks."""

import random

import pytest
from pyspark.sql import functions as F

from revloom.operators import branches, forest
from revloom.operators.shared import materialize


def walk(up, node):
    while node is not None:
        yield node
        node = up.get(node)


@pytest.fixture(scope="module")
def trees(spark):
    rng = random.Random(4)
    up = {i: rng.choice([None, rng.randrange(i)]) if i < 5 else rng.randrange(max(0, i - 9), i) for i in range(1, 400)} | {0: None, 900: 77_777}
    return {k: v if v in up else None for k, v in up.items()}, spark.createDataFrame(list(up.items()), "node long, parent long")


def test_on_the_way_up(trees):
    up, df = trees
    assert {r.node: r.depth for r in forest.depths(df).collect()} == {n: len(list(walk(up, n))) - 1 for n in up}
    assert {r.node: r.label for r in forest.path_names(df, F.col("node").cast("string")).collect()} == {n: " > ".join(map(str, [*walk(up, n)][::-1])) for n in up}
    assert {r.node: r.first for r in forest.first_of_history(df, F.col("node") * 2).collect()} == {n: [*walk(up, n)][-1] * 2 for n in up}


def test_owners_and_tails(spark, trees):
    up, df = trees
    rng = random.Random(8)
    heads = [(n, rng.randrange(50)) for n in rng.sample(sorted(up), 60)] + [(7, 1), (7, 60)]
    refs, owner, tails = {}, {}, set()
    for head, _ in sorted(heads, key=lambda h: (h[1], h[0])):
        path = list(walk(up, head))
        for n in path:
            refs[n] = refs.get(n, 0) + 1
        fresh = [n for n in path if n not in owner]
        owner |= dict.fromkeys(fresh, head)
        if fresh and up[fresh[-1]] is not None:
            tails.add(fresh[-1])
    table = spark.createDataFrame(heads, "head long, place long")
    assert {r.node: (r.refs, r.owner) for r in forest.reference_counts(df, table).collect()} == {n: (refs[n], owner[n]) for n in refs}
    assert {r.node: (r.owner, r.tail) for r in forest.tail_bits(df, table).collect()} == {n: (owner[n], n in tails) for n in owner}


def test_a_long_chain_keeps_a_row_per_node(spark):
    n = 100_000
    chain = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    found = forest.depths(chain)
    assert found.filter("node != depth").count() == 0 and found.count() == n


def test_cycles_are_found(spark):
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "node long, parent long")
    with pytest.raises(forest.BranchCycle):
        forest.depths(ring)
    with pytest.raises(forest.BranchCycle):
        forest.reference_counts(ring, spark.createDataFrame([(1,)], "head long"))


def test_commits_tied_in_everything_go_by_their_ancestors(spark):
    # two lines whose commits agree but for the third one from the end
    rows = [(10 * line + i, 10 * line + i - 1 if i else None, 100 + i, "a", "early" if (line, i) == (2, 2) else "log") for line in (1, 2, 3) for i in range(6)]
    rows += [(50, 35, 105, "z", "same date as its parent"), (51, 50, 105, "a", "and again")]
    df = spark.createDataFrame(rows, "node long, parent long, t long, author string, log string")
    rank = {r.node: r.rank for r in forest.ordered_commits(df).collect()}
    assert rank[22] < rank[12] == rank[32] and rank[25] < rank[15] == rank[35] < rank[50] < rank[51]
    assert rank[10] == rank[20] == rank[30] == 0


def test_newest_match_without_pairs(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice("ab"), rng.randint(0, 40_000)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k string, t long")
    for others in (False, True):
        got = {r.id: (r.found_t, r.found_id) for r in branches.newest_match(df, df, ["k"], 60, "id", "id", others=others).collect()}
        want = {i: max(((u, j) for j, m, u in rows if m == k and abs(u - t) < 60 and not (others and i == j)), default=None) for i, k, t in rows}
        assert got == {i: w for i, w in want.items() if w}
    left = spark.createDataFrame([(1, "a", 5)], "id long, k string, t long")
    right = spark.createDataFrame([(7, "a", 20), (8, "a", 64), (9, "a", 65)], "id long, k string, t long")
    assert [tuple(r) for r in branches.newest_match(left, right, ["k"], 60, "id", "id").collect()] == [(1, 64, 8)]


def test_a_deep_chain_climbs_by_stations(spark, monkeypatch):
    n, written = 4000, []

    def counting(rows):
        table = materialize(rows)
        written.append(table.count())
        return table

    monkeypatch.setattr(forest, "materialize", counting)
    chain = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    assert {(r.node, r["first"]) for r in forest.first_of_history(chain, F.col("node") + 7).collect()} == {(i, 7) for i in range(n)}
    assert sum(written) < 9 * n  # a row for every node in each round would be 12 * n
    with pytest.raises(forest.BranchCycle):
        forest.first_of_history(chain.withColumn("parent", F.coalesce("parent", F.lit(99).cast("long"))).filter("node < 100"), F.col("node"))
