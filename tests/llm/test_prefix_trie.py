"""The conversation trie against brute force."""

import hashlib
import random
import re
import zlib

import pytest

from revloom.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_order(row):
    turn, role, text = row
    digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
    return turn is not None, turn or 0, digest[:32]


def expected(table):
    own = {}
    for c, turn, role, text in table:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))
    own = {c: [r[1:] for r in sorted(rows, key=turn_order)] for c, rows in own.items()}
    rebuilt = {}
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt[c] = tuple(own.get(base, [])[:h] + rows[h:])
    nodes = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    children, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in sorted(nodes, key=len, reverse=True):
        if p:
            children[p[:-1]] += 1
            saved[p] += (len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1]))
        leaves[p] += not children[p]
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(rebuilt[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("limit", [pt.LIMIT, 5, 0])
def test_awkward_conversations(spark, limit):
    draw = random.Random(3)
    table = []
    for c in [*range(-25, 130, 3), *range(400, 420)]:
        for t in range(draw.randrange(1, 8)):
            table.append((c, t if c % 11 else draw.choice([t, None, 1]), draw.choice(["user", "assistant", None, ""]) if c % 3 else "user", draw.choice(["hi there", "", None, "a b  c", "é\tx "]) if c % 2 else f"turn {t}"))
    table += table[:9] + [(None, 0, "user", "nobody's"), (None, None, None, None)]
    table += [(600 + 20 * i, t, "user", f"step {t}") for i in range(30) for t in range(12 if i % 3 else 3 + i)]  # copies and snapshots
    got = pt.prefix_trie(spark.createDataFrame(table, SCHEMA).repartition(4), limit)
    assert got.columns == COLUMNS
    assert rows_of(got) == expected(table)


def test_a_long_conversation_in_parts(spark, monkeypatch):
    monkeypatch.setattr(pt, "PART", 16)
    table = [(40, t, "user", f"{t} x") for t in range(300)] + [(60, t, "user", f"{t} x") for t in range(280)] + [(80, None, "user", "same")] * 200 + [(81, None, "user", "same")] * 150
    rows = pt.with_prefixes(pt.rebuilt(pt.placed_turns(spark.createDataFrame(table, SCHEMA))), 16)
    whole = pt.with_prefixes(pt.rebuilt(pt.placed_turns(spark.createDataFrame(table, SCHEMA))), 10**6)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, whole.collect()))
    assert rows_of(pt.prefix_trie(spark.createDataFrame(table, SCHEMA), 20)) == expected(table)


def test_many_copies_end_together(spark, monkeypatch):
    monkeypatch.setattr(pt, "IDS", 7)
    table = [(20 * c, t, "user", "copy") for c in range(200) for t in range(2)]
    assert rows_of(pt.prefix_trie(spark.createDataFrame(table, SCHEMA))) == expected(table)


def test_turnless_conversations(spark):
    turnless = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 1][:3]
    table = [(c, 0, "user", "alone") for c in turnless]
    got = rows_of(pt.prefix_trie(spark.createDataFrame(table, SCHEMA)))
    assert got == expected(table) and len(got) == 1


def test_empty_table_long_text_and_extra_columns(spark):
    assert pt.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    table = [(1, 0, "user", "word " * 300_000), (2, 0, "user", "word " * 300_000), (20, 0, "user", "b")]
    extra = spark.createDataFrame([(*r, 1, "x", 5) for r in table], SCHEMA + ", depth int, path string, n int")
    assert rows_of(pt.prefix_trie(extra)) == expected(table)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet")
    assert rows_of(pt.prefix_trie(df)) == expected([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
