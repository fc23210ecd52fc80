"""Masters to histories, on small repositories written for the tests."""

import glob

import pytest
from masters import master
from pyspark.sql import functions as F

from revloom.operators import replay
from revloom.plans import emit
from revloom.plans.history import History, Options
from revloom.plans.master_queries import RELEASES, tagged_stream
from revloom.sources.masters import MasterError, Masters, author_map, master_files, parse_master


def files_of(spark, **contents):
    rows = [(p.replace("__", "/") + ",v", bytearray(c)) for p, c in contents.items()]
    return spark.createDataFrame(rows, "path string, content binary")


def text_of(stream):
    rows = stream.orderBy("place", "kind", "sub").collect()
    return b"".join(bytes(r.chunk) for r in rows)


A = master(
    [
        dict(number="1.2", date="2004.01.01.10.10.00", text="one\ntwo\n$Revision$ x\n", log="second", next="1.1"),
        dict(number="1.1", date="2004.01.01.10.00.00", text="d2 2\na3 1\nold\n", log="first", branches=["1.1.2.1"]),
        dict(number="1.1.2.1", date="2004.01.02.10.00.00", text="a2 1\nbranched\n", log="on branch"),
    ],
    symbols={"REL": "1.1.0.2", "T1": "1.1", "T2": "1.2"},
)
B = master(
    [
        dict(number="1.2", date="2004.01.01.10.10.05", text="", state="dead", log="second", next="1.1"),
        dict(number="1.1", date="2004.01.01.10.00.03", text="a0 1\nhe@lo\n", log="first"),
    ],
    symbols={"REL": "1.1.0.2", "T1": "1.1", "T2": "1.1"},
)


def test_parser_reads_quotes_clauses_and_problems():
    m = parse_master(B)
    assert [d["number"] for d in m["deltas"]] == ["1.2", "1.1"]
    assert m["deltas"][1]["edit_text"] == b"a0 1\nhe@lo\n" and m["symbols"][0] == ("REL", "1.1.0.2", 0)
    with pytest.raises(MasterError):
        parse_master(b"junk")
    extra = B.replace(b"strict;", b"strict;\nhardlinks @a@ @b@;")
    assert parse_master(extra)["deltas"] == m["deltas"]


@pytest.fixture(scope="module")
def two_files(spark):
    masters = Masters(files_of(spark, m__a_txt=A, m__Attic__b_txt=B, bad=b"junk"), "m/")
    return History(masters, Options(keywords="kv", properties=True))


def test_changesets_and_branch_points(two_files):
    got = {(r.branch, r.seq): r for r in two_files.changesets.collect()}
    assert sorted(got) == [("REL", 0), ("master", 0), ("master", 1)]
    assert got["REL", 0].parent_cs == got["master", 0].cs_id
    assert got["master", 1].parent_cs == got["master", 0].cs_id
    assert got["master", 0].log == "first\n"


def test_file_operations(two_files):
    cs = {r.cs_id: (r.branch, r.seq) for r in two_files.changesets.collect()}
    got = sorted((*cs[r.cs_id], r.op, r.path, r.rev) for r in two_files.fileops.collect())
    assert got == [("REL", 0, "M", "a_txt", [1, 1, 2, 1]), ("master", 0, "M", "a_txt", [1, 1]), ("master", 0, "M", "b_txt", [1, 1]), ("master", 1, "D", "b_txt", None), ("master", 1, "M", "a_txt", [1, 2])]


def test_tags_on_trees_and_of_their_own(two_files):
    cs = {r.cs_id: (r.branch, r.seq) for r in two_files.changesets.collect()}
    assert {r.name: cs[r.cs_id] for r in two_files.tags.collect()} == {"T1": ("master", 0)}
    lets = two_files.branchlets.collect()
    assert [(r.name, cs[r.parent_cs], r.log) for r in lets] == [("T2", ("master", 1), "Synthetic commit for tag T2")]


def test_contents_replayed_and_expanded(two_files):
    got = {(r.number, bytes(r.content)) for r in two_files.blobs().collect()}
    assert got == {("1.1", b"he@lo\n"), ("1.2", b"one\ntwo\n$Revision: 1.2 $ x\n"), ("1.1", b"one\nold\n"), ("1.1.2.1", b"one\nold\nbranched\n")}


def test_stream_and_sink(two_files, tmp_path):
    stream = emit.stream(two_files)
    data = text_of(stream)
    assert data.startswith(b"blob\nmark :1\ndata 8\none\nold\n\nblob\nmark :2\n") and data.endswith(b"done\n")
    assert b"commit refs/heads/REL\nmark :7\ncommitter ann <ann> 1073037600 +0000\ndata 10\non branch\n\nfrom :3\nM 100644 :6 a_txt\n" in data
    assert b"reset refs/tags/T1\nfrom :3\n\n" in data and b"property cvs-revision 20 a_txt 1.1\nb_txt 1.1\n" in data
    assert data.count(b"M 100644 inline .gitignore") == 1 and b"D b_txt\n" in data
    emit.write_stream(stream, str(tmp_path / "out"))
    assert b"".join(open(f, "rb").read() for f in sorted(glob.glob(str(tmp_path / "out/part-*")))) == data


def test_graph_map_authors_problems(two_files):
    lines = [r.line for r in emit.graph(two_files).orderBy("part").collect()]
    assert lines[0].startswith("digraph G {") and lines[-1] == "}" and sum("shape=ellipse" in x for x in lines) == 2
    assert "a_txt 1.2 :5" in {r.line for r in emit.revision_map(two_files).collect()}
    assert [r.author for r in two_files.authors().collect()] == ["ann"]
    assert {r.kind for r in emit.problems(two_files).collect()} >= {"unreadable", "tag is on no tree"}


def test_vendor_line_becomes_trunk_or_stays(spark):
    imported = master(
        [
            dict(number="1.1", date="2001.01.01.00.00.00", text="v2\n", log="Initial revision", branches=["1.1.1.1"]),
            dict(number="1.1.1.1", date="2001.01.01.00.00.01", text="", log="import", next="1.1.1.2"),
            dict(number="1.1.1.2", date="2001.02.01.00.00.00", text="d1 1\na1 1\nv3\n", log="import again"),
        ],
        symbols={"VENDOR": "1.1.1"},
    )
    changed = imported.replace(b"1.1\ndate", b"1.2\ndate\t2001.03.01.00.00.00;\tauthor ann;\tstate Exp;\nbranches;\nnext\t1.1;\n\n1.1\ndate", 1)
    changed += b"\n\n1.2\nlog\n@change\n@\ntext\n@v4\n@\n"
    h = History(Masters(files_of(spark, a=imported)))
    assert [(r.ref_name, r.parent_ref) for r in h.branches.collect()] == [("master", None)]
    assert sorted((r.branch, r.seq) for r in h.changesets.collect()) == [("master", 0), ("master", 1), ("master", 2)]
    h = History(Masters(files_of(spark, a=changed)))
    assert sorted((r.ref_name, r.parent_ref) for r in h.branches.collect()) == [("import-1.1.1", "master"), ("master", None)]


def test_dead_and_unnamed_branches(spark):
    m = master(
        [
            dict(number="1.1", date="2001.01.01.00.00.00", text="x\n", branches=["1.1.2.1", "1.1.4.1"]),
            dict(number="1.1.2.1", date="2001.01.02.00.00.00", text="", state="dead"),
            dict(number="1.1.4.1", date="2001.01.03.00.00.00", text="a1 1\ny\n", commitid="abc"),
        ]
    )
    h = History(Masters(files_of(spark, a=m)))
    assert {r.ref_name for r in h.branches.collect()} == {"master", "master-UNNAMED-BRANCH-abc"}
    assert "dead unnamed branch left out" in {r.kind for r in emit.problems(h).collect()}


def test_branch_whose_files_were_added_later_stays_disjoint(spark):
    both = dict(number="1.1", date="2001.01.01.00.00.00", text="x\n", branches=["1.1.2.1"])
    added = master([both, dict(number="1.1.2.1", date="2001.01.01.00.00.00", text="", state="dead", next="1.1.2.2"), dict(number="1.1.2.2", date="2001.02.01.00.00.00", text="a1 1\ny\n", log="on branch")], symbols={"BR": "1.1.0.2"})
    other = master([dict(number="1.1", date="2001.01.01.00.00.00", text="z\n")])
    h = History(Masters(files_of(spark, a=added, b=other)))
    assert {(r.branch, r.seq): r.parent_cs for r in h.changesets.collect()} == {("BR", 0): None, ("master", 0): None}
    assert {(r.branch, r.rev[0], len(r.rev)) for r in h.intervals.collect()} == {("master", 1, 2), ("BR", 1, 4)}
    assert b"data 10\non branch\n\nM 100644 :4 a\n" in text_of(emit.stream(h))


def branched(number, base_date, parent_number=None, **more):
    """A master with a branch BR from ``number``, and a branch between if that isn't on the trunk."""
    deltas = [dict(number="1.1", date=base_date, text="x\n", log="base", **more)]
    if parent_number:
        deltas[0]["branches"] = [parent_number]
        deltas.append(dict(number=parent_number, date=base_date[:-2] + "30", text="a1 1\nbetween\n", log="between", branches=[f"{parent_number}.2.1"]))
    else:
        deltas[0]["branches"] = ["1.1.2.1"]
    own = f"{parent_number}.2.1" if parent_number else "1.1.2.1"
    return deltas + [dict(number=own, date="2001.06.01.00.00.00", text="a1 1\non BR\n", log="on BR")]


def test_a_branch_joins_the_newest_match_on_its_parent(spark):
    deltas = branched("1.1", "2001.01.01.00.00.00", commitid="same")
    other = master([dict(number="1.2", date="2001.03.01.00.00.00", text="z\n", log="again", commitid="same", next="1.1"), dict(number="1.1", date="2001.02.01.00.00.00", text="d1 1\na1 1\ny\n", log="own")])
    h = History(Masters(files_of(spark, a=master(deltas, symbols={"BR": "1.1.0.2"}), b=other)))
    cs = {(r.branch, r.seq): r for r in h.changesets.collect()}
    assert [(r.branch, r.how) for r in h.joins.collect()] == [("BR", "match")]
    assert cs["BR", 0].parent_cs == cs["master", 2].cs_id and cs["master", 2].log == "again\n"


def test_a_branch_whose_masters_disagree_joins_its_parent_by_date(spark):
    x = master(branched("1.1.2.1", "2001.01.02.00.00.00", "1.1.2.1"), symbols={"OTHER": "1.1.0.2", "BR": "1.1.2.1.0.2"})
    y = master(branched("1.1.4.1", "2001.01.01.00.00.00", "1.1.4.1"), symbols={"THIRD": "1.1.0.4", "BR": "1.1.4.1.0.2"})
    h = History(Masters(files_of(spark, x=x, y=y)))
    assert {r.ref_name: r.parent_ref for r in h.branches.collect()}["BR"] == "THIRD"
    cs = {(r.branch, r.seq): r for r in h.changesets.collect()}
    assert [r.how for r in h.joins.collect() if r.branch == "BR"] == ["date"]
    assert cs["BR", 0].parent_cs == cs["THIRD", 0].cs_id


def test_a_branch_that_finds_nothing_adopts_its_files_in_a_root(spark):
    x = master(branched("1.1.2.1", "2001.01.02.00.00.00", "1.1.2.1"), symbols={"OTHER": "1.1.0.2", "BR": "1.1.2.1.0.2"})
    y = master(branched("1.1.4.1", "2001.05.01.00.00.00", "1.1.4.1"), symbols={"THIRD": "1.1.0.4", "BR": "1.1.4.1.0.2"})
    late = y.replace(b"2001.06.01", b"2001.04.01")  # on BR before what it grows from: not taken over
    h = History(Masters(files_of(spark, x=x, y=late)))
    cs = {(r.branch, r.seq): r for r in h.changesets.collect()}
    how = {r.branch: r.how for r in h.joins.collect()}
    assert how["BR"] == "root" and cs["BR", -1].parent_cs is None and cs["BR", 0].parent_cs == cs["BR", -1].cs_id
    ops = {(r.op, r.path, tuple(r.rev)) for r in h.fileops.filter(F.col("cs_id") == cs["BR", -1].cs_id).collect()}
    assert ops == {("M", "x", (1, 1, 2, 1))}
    assert b"commit refs/heads/BR" in text_of(emit.stream(h))


def test_incremental_and_forced_dates(spark):
    m = master([dict(number="1.2", date="2001.01.02.00.00.00", text="b\n", next="1.1"), dict(number="1.1", date="2001.01.01.00.00.00", text="d1 1\na1 1\na\n")])
    masters = Masters(files_of(spark, a=m))
    data = text_of(emit.stream(History(masters, Options(newer_than=978_350_400))))
    assert b"from refs/heads/master^0\n\ncommit refs/heads/master\nmark :4\n" in data and b"mark :2\n" not in data
    data = text_of(emit.stream(History(masters, Options(force_dates=True))))
    assert b"mark :2\ncommitter ann <ann> 101200 +0000\n" in data
    with pytest.raises(ValueError):
        Options(embed_ids=True, properties=True)


def test_reading_files_and_author_maps(spark, tmp_path):
    (tmp_path / "r/CVSROOT").mkdir(parents=True)
    (tmp_path / "r/a.c,v").write_bytes(A)
    (tmp_path / "r/CVSROOT/b.c,v").write_bytes(B)
    (tmp_path / "r/c.c").write_bytes(B)
    assert [r.path for r in master_files(spark, str(tmp_path / "r")).collect()] == ["a.c,v"]
    assert master_files(spark, str(tmp_path / "r"), promiscuous=True).count() == 3
    (tmp_path / "map").write_text("# people\nann = Ann Ba <ann@example.org> Europe/Berlin\nbad line\nbob=Bob <b@example.org>\n")
    got = {r.name: (r.full, r.email, r.zone) for r in author_map(spark, str(tmp_path / "map")).collect()}
    assert got == {"ann": ("Ann Ba", "ann@example.org", "Europe/Berlin"), "bob": ("Bob", "b@example.org", None)}


def test_fast_order_puts_blobs_first_and_keeps_trees(spark, two_files):
    fast = History(two_files.masters, Options(fast=True))
    data = text_of(emit.stream(fast))
    assert data.rindex(b"blob\n") < data.index(b"commit ")
    same = lambda h: {(r.branch, r.seq, r.op, r.path) for r in h.fileops.join(h.changesets, "cs_id").select("branch", "seq", "op", "path").collect()}
    assert same(fast) == same(two_files)
    assert fast.intervals.select(F.count("*")).first() == two_files.intervals.select(F.count("*")).first()


def test_references_are_those_of_the_stream(spark, two_files):
    for options in (Options(fast=True), Options(remote="up", newer_than=1_072_951_400)):
        h = History(two_files.masters, options)
        want = emit.stream(h).filter("kind in (2, 3)").collect()
        assert want and sorted(map(str, emit.references(h, emit.marked(h)[0]).select("place", "kind", "sub", "chunk").collect())) == sorted(map(str, want))


def test_where_tags_are_needs_no_texts(spark, monkeypatch):
    def replayed(*_, **__):
        raise AssertionError("texts are replayed")

    monkeypatch.setattr(replay, "snapshots", replayed)
    assert tagged_stream(spark, "/root/testdata/sf0.001").count() == RELEASES + 3
