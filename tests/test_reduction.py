"""Masters written back, whole and reduced."""

import hashlib

from masters import master

from revloom.sources import reduction
from revloom.sources.masters import parse_master

WHOLE = master(
    [
        dict(number="1.2", date="2004.01.01.10.10.00", text="one@two\nthree\n", log="sec@nd é", next="1.1", commitid="abc", author="änn"),
        dict(number="1.1", date="99.01.01.10.00.00", text="d1 1\na1 1\nold @\n", log="first\n\nlines", branches=["1.1.2.1", "1.1.4.1"], state="dead"),
        dict(number="1.1.2.1", date="2004.01.02.10.00.00", text="", log=""),
        dict(number="1.1.4.1", date="2004.01.02.10.00.00", text="a0 1\nx\n"),
    ],
    symbols={"REL": "1.1.0.2", "T1": "1.1", "T2": "1.2", "OTHER": "1.1.0.4", "TEN": "1.10"},
    description="about @ it",
    expand="kv",
)
BYTES = WHOLE.replace(b"three", b"\xff\xfe\x80 three")
EMPTY = b"head\t;\naccess;\nsymbols;\nlocks; strict;\n\n\ndesc\n@@\n"
FILES = [("m/a.c,v", WHOLE), ("m/sub/b.c,v", BYTES), ("m/sub/e.c,v", EMPTY), ("bad,v", b"junk")]


def test_written_masters_parse_to_the_same(spark, tmp_path):
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in FILES], "path string, content binary")
    files = reduction.rendered(reduction.parsed_files(df))
    got = {r.path: bytes(r.content) for r in files.collect()}
    assert set(got) == {p for p, _ in FILES[:3]}
    for path, content in FILES[:3]:
        assert parse_master(got[path]) == parse_master(content), path
    reduction.write_mirror(files, f"{tmp_path}/mirror")
    assert {p.name for p in (tmp_path / "mirror").iterdir() if p.is_dir()} == {"folder=m", "folder=m%2Fsub"}
    assert {r.path: bytes(r.content) for r in spark.read.parquet(f"{tmp_path}/mirror").collect()} == got


def test_reduced_masters(spark):
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in FILES], "path string, content binary")
    nested = reduction.parsed_files(df)
    got = {r.path: parse_master(bytes(r.content)) for r in reduction.rendered(reduction.reduced(nested)).collect()}
    want = parse_master(WHOLE)
    for i, d in enumerate(want["deltas"]):
        d["log"] = hashlib.md5(d["log"].encode()).hexdigest() + "\n"
        d["edit_text"] = b"d1 1\na1 1\n" * (i > 0) + f"m/a.c,v content for {d['number']}\n".encode()
    want["symbols"] = [("REL", "1.1.0.2", 0), ("OTHER", "1.1.0.4", 1), ("TEN", "1.10", 2)]
    assert got["m/a.c,v"] == want
    kept = {r.path: parse_master(bytes(r.content)) for r in reduction.rendered(reduction.reduced(nested, logs=False, contents=False, tags=False)).collect()}
    assert kept["m/sub/b.c,v"] == parse_master(BYTES)
