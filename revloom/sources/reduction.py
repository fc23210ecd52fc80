"""Reducing masters to their shape, and writing parsed masters back as files.

All of it is expressions over the parsed rows, a row per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revloom.functions import paths, text
from revloom.sources.masters import SCHEMA, parsed


def parsed_files(files: DataFrame) -> DataFrame:
    """The parser's nested rows of ``files`` (path, content)."""
    return files.mapInPandas(parsed, SCHEMA)


def reduced(masters: DataFrame, logs: bool = True, contents: bool = True, tags: bool = True) -> DataFrame:
    """Parsed masters without what isn't their shape: logs become digests, texts a line that
    names file and revision, and of the symbols those that name branches stay, whose numbers
    have a 0 in them.  Each of the three may be left as it is."""
    stub = lambda d: F.concat(F.col("path"), F.lit(" content for "), d["number"], F.lit("\n"))

    def delta(d: Column, i: Column) -> Column:
        # the first text is whole, the others replace its only line
        edit = F.concat(F.when(i > 0, "d1 1\na1 1\n").otherwise(""), stub(d))
        d = d.withField("log", F.concat(F.md5(d["log"]), F.lit("\n"))) if logs else d
        return d.withField("edit_text", F.encode(edit, "UTF-8")) if contents else d

    out = masters.withColumn("deltas", F.transform("deltas", delta))
    return out.withColumn("symbols", F.filter("symbols", lambda s: s["number"].contains("0"))) if tags else out


def rendered(masters: DataFrame) -> DataFrame:
    """(path, content) of parsed masters as master files; unreadable ones are left out.

    A text's bytes are characters of Latin 1 on the way, so that any of them pass unchanged.
    """
    raw = lambda s: F.decode(F.encode(s, "UTF-8"), "ISO-8859-1")
    quoted = lambda s: F.concat(F.lit("@"), text.at_escaped(s), F.lit("@"))
    joined = lambda array, f: F.array_join(F.transform(array, f), "")
    phrase = lambda key, value: F.concat(F.lit(f"{key}\t"), F.coalesce(value, F.lit("")), F.lit(";"))

    def header(d: Column) -> Column:
        sprouts = joined(d["branches"], lambda b: F.concat(F.lit("\n\t"), b))
        first = F.concat(d["number"], F.lit("\ndate\t"), d["date"], F.lit(";\tauthor "), raw(d["author"]), F.lit(";\tstate "), F.coalesce(d["state"], F.lit("")), F.lit(";\nbranches"), sprouts, F.lit(";\n"))
        return F.concat(first, phrase("next", d["next"]), F.when(d["commitid"].isNotNull(), F.concat(F.lit("\n"), phrase("commitid", raw(d["commitid"])))).otherwise(""), F.lit("\n\n"))

    body = lambda d: F.concat(F.lit("\n\n"), d["number"], F.lit("\nlog\n"), quoted(raw(d["log"])), F.lit("\ntext\n"), quoted(F.decode(d["edit_text"], "ISO-8859-1")), F.lit("\n"))
    symbols = joined("symbols", lambda s: F.concat(F.lit("\n\t"), raw(s["name"]), F.lit(":"), s["number"]))
    optional = lambda key: F.when(F.col(key).isNotNull(), F.concat(F.lit({"default_branch": "branch\t", "expand": "expand\t@"}[key]), F.col(key), F.lit({"default_branch": ";\n", "expand": "@;\n"}[key]))).otherwise("")
    admin = F.concat(phrase("head", F.col("head")), F.lit("\n"), optional("default_branch"), F.lit("access;\nsymbols"), symbols, F.lit(";\nlocks; strict;\n"), optional("expand"), F.lit("\n\n"))
    whole = F.concat(admin, joined("deltas", header), F.lit("\ndesc\n"), quoted(raw(F.coalesce("description", F.lit("")))), F.lit("\n"), joined("deltas", body))
    return masters.filter("problem is null").select("path", F.encode(whole, "ISO-8859-1").alias("content"))


def write_mirror(files: DataFrame, folder: str) -> None:
    """Write (path, content) as a table laid out by the files' folders, as their tree is."""
    files.withColumn("folder", paths.directory("path")).write.partitionBy("folder").parquet(folder)
