"""Reading master files, the per-file histories of a version-control repository.

Spark lists and reads the files; a small parser turns each into one nested row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revloom.functions import paths, revnum, text
from revloom.operators.shared import framed, materialize

TOKEN = re.compile(rb"@((?:[^@]|@@)*)@|([;:])|([^\s;:@]+)")
NUMBER = re.compile(rb"[0-9.]+\Z")

DELTA = "struct<number:string,date:string,author:string,state:string,branches:array<string>,next:string,commitid:string,log:string,edit_text:binary,pos:int>"
SCHEMA = f"path string, head string, default_branch string, expand string, description string, bytes long, problem string, deltas array<{DELTA}>, symbols array<struct<name:string,number:string,pos:int>>"


class MasterError(ValueError):
    """A file that isn't a master."""


def decoded(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


class _Tokens:
    def __init__(self, data: bytes):
        self.found = TOKEN.finditer(data)
        self.next()

    def next(self) -> None:
        m = next(self.found, None)
        self.quoted = m is not None and m.group(1) is not None
        self.now = None if m is None else (m.group(1).replace(b"@@", b"@") if self.quoted else m.group(0))

    def take(self) -> bytes:
        if self.now is None:
            raise MasterError("the file ends too early")
        got = self.now
        self.next()
        return got

    def phrase(self) -> list[tuple[bytes, bool]]:
        """What stands before the next semicolon, which is skipped."""
        got = []
        while self.quoted or self.now != b";":
            quoted = self.quoted
            got.append((self.take(), quoted))
        self.next()
        return got

    def at_number(self) -> bool:
        return not self.quoted and self.now is not None and NUMBER.match(self.now) is not None


def parse_master(data: bytes) -> dict:
    """The admin part, deltas and texts of one master, as plain values."""
    t = _Tokens(data)
    out: dict = {"head": None, "default_branch": None, "expand": None, "description": "", "symbols": [], "deltas": {}}
    if t.now != b"head":
        raise MasterError("no head")
    while not t.at_number() and t.now != b"desc":
        key, words = t.take(), [w for w, _ in t.phrase()]
        if key == b"head":
            out["head"] = decoded(words[0]) if words else None
        elif key == b"branch":
            out["default_branch"] = decoded(words[0]) if words else None
        elif key == b"expand":
            out["expand"] = decoded(words[0]) if words else None
        elif key == b"symbols":
            for name, number in zip(words[::3], words[2::3], strict=False):
                out["symbols"].append((decoded(name), decoded(number), len(out["symbols"])))
    order = 0
    while t.at_number():
        number = decoded(t.take())
        delta = {"number": number, "date": None, "author": None, "state": None, "branches": [], "next": None, "commitid": None, "log": "", "edit_text": b"", "pos": order}
        while not t.at_number() and t.now != b"desc":
            key, words = decoded(t.take()), [decoded(w) for w, _ in t.phrase()]
            if key == "branches":
                delta["branches"] = words
            elif key in ("date", "author", "state", "next", "commitid"):
                delta[key] = words[0] if words else None
        out["deltas"].setdefault(number, delta)  # of a repeated number the first counts
        order += 1
    if t.take() != b"desc":
        raise MasterError("no description")
    out["description"] = decoded(t.take())
    while t.now is not None:
        delta = out["deltas"].get(decoded(t.take()), {})
        while t.now is not None and not t.at_number():
            key = t.take()
            if key == b"log":
                delta["log"] = decoded(t.take())
            elif key == b"text":
                delta["edit_text"] = t.take()
                break
            else:
                t.phrase()
    return out | {"deltas": list(out["deltas"].values())}


def parsed_rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, tuple]]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            try:
                master, problem = parse_master(bytes(content)), None
            except MasterError as e:
                master, problem = {"head": None, "default_branch": None, "expand": None, "description": None, "deltas": [], "symbols": []}, str(e)
            symbols = [dict(zip(("name", "number", "pos"), s, strict=True)) for s in master["symbols"]]
            yield len(content), (path, master["head"], master["default_branch"], master["expand"], master["description"], len(content), problem, master["deltas"], symbols)


def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Masters as they are parsed, some at a time: as values they are several times as large."""
    return framed(parsed_rows(batches), ["path", "head", "default_branch", "expand", "description", "bytes", "problem", "deltas", "symbols"])


def master_files(spark: SparkSession, root: str, promiscuous: bool = False) -> DataFrame:
    """(path, content) of the masters below ``root``, paths relative to it.

    Names must end in ``,v`` and not lie in CVSROOT, unless ``promiscuous``.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader if promiscuous else reader.option("pathGlobFilter", "*,v")).load(root)
    tail = F.regexp_replace("path", F.lit("^.*?" + re.escape(re.sub(r"^[a-z]+:/*", "/", root).rstrip("/")) + "/"), F.lit(""))
    files = files.select(tail.alias("path"), "content")
    return files if promiscuous else files.filter(~F.col("path").contains("CVSROOT"))


class Masters:
    """Parsed masters as tables: ``files``, ``deltas``, ``symbols`` and ``problems``.

    Symbols that can't be references even when sanitised are left out and reported, as are
    authors and states of that kind, whose revisions stay; ``strict`` makes any problem an error.
    """

    def __init__(self, files: DataFrame, strip: str | None = None, executable: DataFrame | None = None, strict: bool = False):
        rows = materialize(files.mapInPandas(parsed, SCHEMA))  # parsed once for all tables
        export = paths.rectified("path", strip)
        rows = rows.withColumn("master_id", F.xxhash64("path")).withColumn("export_path", export).withColumn("fileop_path", paths.ignore_renamed(export))
        self.problems = rows.filter(F.col("problem").isNotNull()).select("path", "problem")
        good = rows.filter(F.col("problem").isNull())
        self.files = good.select("master_id", "path", "export_path", "fileop_path", "head", "default_branch", text.expand_mode("expand").alias("expand"), "description", "bytes", F.size("deltas").alias("n_versions"))
        if executable is not None:
            self.files = self.files.join(executable, "path", "left").withColumn("executable", F.coalesce("executable", F.lit(False)))
        else:
            self.files = self.files.withColumn("executable", F.lit(False))
        deltas = good.select("master_id", "fileop_path", "description", F.inline("deltas"))
        self.deltas = deltas.select(
            "master_id",
            "fileop_path",
            revnum.parse("number").alias("rev"),
            F.unix_timestamp(text.rcs_timestamp("date")).alias("t"),
            text.sanitised("author").alias("author"),
            (F.col("state") == "dead").alias("dead"),
            "state",
            F.when(F.col("commitid") != "", F.col("commitid")).alias("commitid"),
            text.default_log("log", "description").alias("log"),
            "edit_text",
            "pos",
        )
        symbols = good.select("master_id", "path", F.inline("symbols")).filter(F.col("number").contains("."))
        bad = symbols.filter(text.bad_ref("name")).select("path", F.concat(F.lit("bad reference name: "), "name").alias("problem"))
        states = good.select("path", F.explode(F.flatten(F.transform("deltas", lambda d: F.array(d["author"], d["state"])))).alias("name")).distinct()
        bad = bad.unionByName(states.filter((F.col("name") != "") & text.bad_ref("name")).select("path", F.concat(F.lit("bad author or state: "), "name").alias("problem")))
        self.problems = self.problems.unionByName(bad)
        symbols = symbols.filter(~text.bad_ref("name")).select("master_id", text.sanitised("name").alias("name"), revnum.parse("number").alias("rev"), "pos")
        first = symbols.groupBy("master_id", "name").agg(F.min(F.struct("pos", "rev")).alias("s"))  # of a repeated name the first counts
        self.symbols = first.select("master_id", "name", F.col("s.rev").alias("rev"), F.col("s.pos").alias("pos"))
        if strict and (found := self.problems.first()):
            raise MasterError(f"{found.path}: {found.problem}")


def author_map(spark: SparkSession, path: str) -> DataFrame:
    """``name = Full Name <email> [zone]`` lines; comments and other lines are left out."""
    pattern = r"^\s*([^#=\s]+)\s*=\s*([^<]*?)\s*<([^>]*)>\s*(\S*)\s*$"
    lines = spark.read.text(path).filter(F.col("value").rlike(pattern))
    parts = [F.regexp_extract("value", pattern, i).alias(n) for i, n in enumerate(("name", "full", "email", "zone"), 1)]
    rows = lines.select(*parts).withColumn("zone", F.when(F.col("zone") != "", F.col("zone")))
    return rows.groupBy("name").agg(F.min(F.struct("full", "email", "zone")).alias("m")).select("name", "m.*")
