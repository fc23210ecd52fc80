"""Expansion of keywords in file contents."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revloom.operators.shared import framed

# The keywords, and the leaders of comments that $Log$ turns into " *".
KEYWORDS = (b"Author", b"Date", b"Header", b"Id", b"Locker", b"Log", b"Name", b"RCSfile", b"Revision", b"Source", b"State")
FOUND = re.compile(rb"\$(" + b"|".join(KEYWORDS) + rb")(?=\$|:[^$\n]*\$)(:[^$\n]*)?")
COMMENT_START = re.compile(rb"^([ \t]*)[/(](\*[ \t]*)$")


def escaped(value: bytes) -> bytes:
    for char, instead in ((b"\\", b"\\\\"), (b"\t", b"\\t"), (b"\n", b"\\n"), (b" ", b"\\040"), (b"$", b"\\044")):
        value = value.replace(char, instead)
    return value


def value_of(keyword: bytes, row) -> bytes:
    date = dt.datetime.fromtimestamp(row.t, dt.timezone.utc).strftime("%Y/%m/%d %H:%M:%S").encode()
    author, state, number = row.author.encode(), row.state.encode(), row.number.encode()
    name, full = escaped(row.path.rsplit("/", 1)[-1].encode()), escaped(row.path.encode())
    if keyword in (b"Id", b"Header"):
        return b" ".join([name if keyword == b"Id" else full, number, date, author, state])
    plain = {b"Author": author, b"Date": date, b"RCSfile": name, b"Log": name, b"Revision": number, b"Source": full, b"State": state}
    return plain.get(keyword, b"")


def log_entry(line_start: bytes, row) -> bytes:
    """The lines that $Log$ adds below its own, each with the comment's leader."""
    leader = line_start
    if m := COMMENT_START.match(leader):
        leader = m[1] + b" " + m[2]
    date = dt.datetime.fromtimestamp(row.t, dt.timezone.utc).strftime("%Y/%m/%d %H:%M:%S").encode()
    first = leader + b"Revision %s  %s  %s" % (row.number.encode(), date, row.author.encode())
    bare = leader.rstrip(b" \t")
    logged = [leader + x if x else bare for x in row.log.encode().split(b"\n")]
    return b"\n".join([b"", first, *logged])


def expanded(content: bytes, row, mode: str) -> bytes:
    """``content`` with keywords written as ``mode`` has it (o and b: as they are).

    Closing delimiters may open the next keyword.
    """
    if mode in ("o", "b") or b"$" not in content:
        return content
    out, at, values = [], 0, {}
    while m := FOUND.search(content, at):
        out.append(content[at : m.start()])
        keyword = m[1]
        if keyword not in values:
            values[keyword] = b"" if mode == "k" else value_of(keyword, row)
        value = values[keyword]
        if mode == "k":
            out.append(b"$" + keyword)
        elif mode == "v":
            out.append(value)
        else:
            out.append(b"$" + keyword + b": " + value + b" ")
        at = m.end()
        if mode == "v" or keyword == b"Log":
            if mode != "v":
                out.append(b"$")
            at += 1
        if keyword == b"Log" and mode in ("kv", "kvl") and not row.log.startswith("checked in with -k"):
            start = content.rfind(b"\n", 0, m.start()) + 1
            out.append(log_entry(content[start : m.start()], row))
    out.append(content[at:])
    return b"".join(out)


def expander(key: str):
    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, tuple]]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                content = None if row.content is None else expanded(bytes(row.content), row, row.mode)
                yield len(content or b""), (getattr(row, key), content)

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return framed(contents(batches), [key, "content"])  # a batch may become ten times as large

    return expand


def expanded_contents(rows: DataFrame, key: str) -> DataFrame:
    """(key, content) of ``rows`` with keywords expanded in the row's mode.

    ``rows``: the key, content (binary), mode, path, number, t, author, state, log.  Null
    contents stay null.
    """
    asked = rows.select(key, "content", "mode", "path", "number", "t", "author", "state", "log").filter(F.col(key).isNotNull())
    return asked.mapInPandas(expander(key), f"{key} {rows.schema[key].dataType.simpleString()}, content binary")
