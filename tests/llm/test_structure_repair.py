"""Conversation repair against brute force."""

import functools
import hashlib
import itertools
import random
import re
import sys
import zlib

import pytest

from revloom.llm import structure_repair as sr

sys.setrecursionlimit(10_000)
SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def least(a, b):
    return b if a is None else a if b is None else min(a, b)


def cheapest(turns):
    """(cost, audit, repaired turns) by trying every edit; ``turns`` has (role, text, fault)."""

    @functools.cache
    def go(i, done, inserts):
        best = None
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", "".join("sua"["sua".index(x)] for x in done)):
            best = (0, "", ())
        viable = lambda s: any(re.fullmatch("(s?(ua)+)?", s + rest) for rest in ("", "a", "ua"))
        step = lambda cost, letter, j, more, out, n: (lambda x: None if x is None else (cost + x[0], letter + x[1], out + x[2]))(go(j, more, n))
        if inserts < 3:
            for role in ("user", "assistant"):
                if viable(shorter(done) + role[0]):
                    best = least(best, step(2, "I", i, shorter(done) + role[0], ((role, ""),), inserts + 1))
        if i < len(turns):
            role, text, fault = turns[i]
            best = least(best, step(3, "D", i + 1, done, (), 0))
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                if role[:1] in ("s", "u", "a") and viable(shorter(done) + role[:1]):
                    best = least(best, step(more, "K", i + 1, shorter(done) + role[:1], ((role, text),), 0))
                for other in ("user", "assistant"):
                    if viable(shorter(done) + other[0]):
                        best = least(best, step(2 + more, "R", i + 1, shorter(done) + other[0], ((other, text),), 0))
        return best

    def shorter(done):
        """The same place in the grammar with few turns before it."""
        return done if len(done) < 4 else "ua" if done.endswith("a") else "uau"

    return go(0, "", 0)


def faults(rows):
    """Rows (turn, role, text) in order, with their first fault."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\r\x0b\x0c")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "good"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def expected(table):
    kept = {}
    for c, turn, role, text in table:
        rows = kept.setdefault(c, [])
        spaced = lambda x: " " if x is None else str(x)
        draw = zlib.crc32(f"{spaced(c)}:{spaced(turn)}".encode()) % 20
        text, role = spaced(text), spaced(role)
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        role = "user" if draw == 4 else role
        rows += [(turn, role, text)] * (2 if draw == 3 else 1)
    out = []
    for c, rows in kept.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        judged = faults(rows)
        turns = {t for t, _, _ in rows if t is not None}
        initials = [r[:1] for r, _, _ in judged]
        counts = [sum(f == k for _, _, f in judged) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, repaired = cheapest(tuple(judged))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, digest))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_all_short_signatures():
    kinds = [("system", "good"), ("user", "good"), ("assistant", "good"), ("tool", "good"), ("user", "truncated"), ("assistant", "truncated"), ("user", "blank")]
    letters = ["s", "u", "a", "o", "U", "A", "x"]
    found = {}
    endings = sr.Endings()
    every = [x for n in range(5) for x in itertools.product(range(len(kinds)), repeat=n)]
    for x in sorted(every, key=lambda x: "".join(letters[i] for i in x)[::-1]):
        endings.follow("".join(letters[i] for i in x))
        found[x] = endings.best()
    for x in random.Random(1).sample(every, 900):
        want = cheapest(tuple((kinds[i][0], "t", kinds[i][1]) for i in x))
        assert found[x] == want[:2], x


def test_awkward_conversations(spark):
    draw = random.Random(5)
    texts = ["Done.", "Really?  ", "no end", "", " \t", None, "Same!", "é ends ", "multi\nline.", "Same!"]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "users"]
    table = []
    for c in range(120):
        for t in range(draw.randrange(9)):
            table.append((c if c % 30 else None, draw.choice([t, t, t + c % 3, 2**40 * t, None]) if c % 7 == 0 else t, draw.choice(roles[:2] if c % 2 else roles), draw.choice(texts)))
    table += [(500, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(260)]  # a long one
    table += [(600 + c, t, "user", "A hot one.") for c in range(300) for t in range(3)]
    table += table[:20]
    got = sr.repair_report(spark.createDataFrame(table, SCHEMA).repartition(5))
    assert got.columns == COLUMNS
    assert rows_of(got) == expected(table)


def test_dropped_conversation_and_nulls(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table = [(dropped, 0, "user", "Hi."), (None, None, None, None)]
    empty = hashlib.sha256(b"").hexdigest()
    got = rows_of(sr.repair_report(spark.createDataFrame(table, SCHEMA)))
    assert (dropped, 0, 0, 0, 0, 0, 0, "", empty) in got and got == expected(table)


def test_empty_table_and_extra_columns(spark):
    assert sr.repair_report(spark.createDataFrame([], SCHEMA)).collect() == []
    extra = spark.createDataFrame([(1, 0, "user", "Hi.", "x", 7, "s")], SCHEMA + ", audit string, n int, key string")
    assert rows_of(sr.repair_report(extra)) == expected([(1, 0, "user", "Hi.")])


def test_very_long_text(spark):
    table = [(3, 1, "user", "word " * 400_000 + "."), (3, 2, "assistant", ". " * 200_000), (3, 3, "user", " " * 500_000)]
    assert rows_of(sr.repair_report(spark.createDataFrame(table, SCHEMA))) == expected(table)


def test_repaired_turns(spark):
    table = [(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (2, 0, "system", "Rules."), (2, 1, "user", "So?"), (2, 2, "assistant", "Yes."), (2, 3, "user", "So?"), (3, 0, "tool", "")]
    got = sorted(map(tuple, sr.repaired_turns(spark.createDataFrame(table, SCHEMA)).collect()))
    want = []
    for c in (1, 2, 3):
        _, audit, repaired = cheapest(tuple(faults([r[1:] for r in table if r[0] == c])))
        edits = audit.replace("D", "")
        want += [(c, i, e, *turn) for i, (e, turn) in enumerate(zip(edits, repaired, strict=True))]
    assert got == sorted(want)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet")
    assert rows_of(sr.repair_report(df)) == expected([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
