"""Replay of edit scripts, whole and in segments, against plain texts."""

import random

import pytest
from pyspark.sql import functions as F

from revloom.operators import replay

SCHEMA = "master_id long, number string, edit_text binary"


def random_text(rng, most=12):
    return "".join(rng.choice(["a\n", "b\n", "c c\n", "\n", f"u{rng.randint(0, 99)}\n"]) for _ in range(rng.randint(0, most))) + rng.choice(["", "end"])


def changed(rng, text):
    lines = replay.split_lines(text.encode())
    for _ in range(rng.randint(0, 3)):
        at = rng.randint(0, len(lines))
        lines[at : at + rng.randint(0, 2)] = [f"n{rng.randint(0, 999)}\n".encode()] * rng.randint(0, 2)
    joined = b"".join(x if x.endswith(b"\n") else x + b"\n" for x in lines)
    return (joined + rng.choice([b"", b"tail"])).decode()


def lines_of(text):
    return replay.split_lines(text.encode())


def test_edits_compose():
    rng = random.Random(1)
    for _ in range(300):
        texts = [random_text(rng)]
        edit = replay.Edit.nothing()
        for _ in range(rng.randint(1, 6)):
            texts.append(changed(rng, texts[-1]) if rng.random() < 0.8 else random_text(rng))
            script = replay.make_edit(lines_of(texts[-2]), lines_of(texts[-1]))
            assert b"".join(replay.apply_edit(lines_of(texts[-2]), script)).decode() == texts[-1]
            edit = replay.Edit.unpacked(edit.then(script).packed())
        assert b"".join(edit.on(lines_of(texts[0]))).decode() == texts[-1]
    with pytest.raises(replay.CorruptDelta):
        replay.Edit.of_text(b"x\n").then(b"d3 1\n")
    with pytest.raises(replay.CorruptDelta):
        replay.Edit.nothing().then(b"d3 1\n").on([b"x\n"])


def repository(rng, trunk=40):
    """(master_id, number, edit), texts by (master_id, number), of files with nested branches."""
    rows, texts = [], {}
    for master in (1, 2, 3):
        own = [random_text(rng)]
        for _ in range(trunk - master * 10):
            own.append(changed(rng, own[-1]))
        for i, x in enumerate(own, 1):
            texts[master, f"1.{i}"] = x
            rows.append((master, f"1.{i}", x.encode() if i == len(own) else replay.make_edit(lines_of(own[i]), lines_of(x))))
        for root, size in (("1.3", 9), ("1.8", 3), ("1.3.2.5", 7), ("1.3.2.5.2.2", 2)):
            above = texts[master, root]
            for i in range(1, size + 1):
                x = changed(rng, above)
                texts[master, f"{root}.2.{i}"] = x
                rows.append((master, f"{root}.2.{i}", replay.make_edit(lines_of(above), lines_of(x))))
                above = x
    return rows, texts


@pytest.mark.parametrize("segment", [replay.SEGMENT, 4, 1])
def test_chains_in_segments(spark, segment):
    rows, texts = repository(random.Random(2))
    df = spark.createDataFrame(rows + [(9, "1.5.2.1", b"a0 1\nno root\n")], SCHEMA).withColumns({"dead": F.col("number") == "1.4", "mode": F.lit("b")}).repartition(5)
    got = {(r.master_id, r.number): bytes(r.content).decode() for r in replay.snapshots(df, segment=segment).collect()}
    assert got == {k: v for k, v in texts.items() if k[1] != "1.4"}


def test_only_what_is_wanted_is_replayed(spark):
    rows, texts = repository(random.Random(3))
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"dead": F.lit(False), "mode": F.lit("b")})
    asked = [(1, "1.28"), (2, "1.3.2.5.2.3"), (1, "1.30")]
    wanted = spark.createDataFrame(asked, "master_id long, number string")
    read = {(r.master_id, r.number) for r in replay.needed(replay.chained(df), wanted).collect()}
    trunk = lambda m, least: {(m, f"1.{i}") for i in range(least, 200) if (m, f"1.{i}") in texts}
    assert read == trunk(1, 28) | trunk(2, 3) | {(2, f"1.3.2.{i}") for i in range(1, 6)} | {(2, f"1.3.2.5.2.{i}") for i in range(1, 4)}
    for segment in (replay.SEGMENT, 3):
        got = {(r.master_id, r.number): bytes(r.content).decode() for r in replay.snapshots(df, wanted, segment=segment).collect()}
        assert got == {k: texts[k] for k in asked}
    # a broken delta that nothing wanted depends on does no harm
    broken = df.withColumn("edit_text", F.when(F.col("number") == "1.1", F.lit(b"junk")).otherwise(F.col("edit_text")))
    assert replay.snapshots(broken, spark.createDataFrame([(1, "1.28")], "master_id long, number string")).count() == 1


def test_a_long_chain_of_large_texts_streams(spark):
    """2,000 revisions of a text of 0.5 MB: a gigabyte of texts from small edits."""
    base = b"".join(b"line %06d %s\n" % (i, b"x" * 40) for i in range(9_500))
    rows = [(1, "1.2000", base)] + [(1, f"1.{i}", b"d%d 1\na%d 1\nedit %d\n" % (i, i, i)) for i in range(1, 2000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"dead": F.lit(False), "mode": F.lit("b")})
    found = replay.snapshots(df).select("number", F.length("content").alias("n"), F.md5("content").alias("md5")).agg(F.count("*"), F.countDistinct("md5"), F.min("n"), F.max("n")).first()
    assert found[0] == found[1] == 2000 and len(base) - 2000 * 60 < found[2] <= found[3] == len(base)


def test_scripts_between_versions_of_a_hot_key(spark):
    rng = random.Random(4)
    rows = [(1, i * 7, random_text(rng)) for i in range(600)] + [(2, 3, None), (2, 5, "x")]
    df = spark.createDataFrame(rows, "m long, i long, x string")
    scripts = replay.scripts_between(df, "m", "i", "x").withColumns({"dead": F.lit(False), "mode": F.lit("b")})
    got = {(r.master_id, int(r.number[2:]) - 1): bytes(r.content).decode() for r in replay.snapshots(scripts, segment=50).collect()}
    assert got == {(1, i): r[2] for i, r in enumerate(rows[:600])} | {(2, 0): "", (2, 1): "x"}
