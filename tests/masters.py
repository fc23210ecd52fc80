"""Writes small masters for the tests."""

from __future__ import annotations


def quoted(text: str) -> str:
    return "@" + text.replace("@", "@@") + "@"


def master(deltas: list[dict], symbols: dict[str, str] | None = None, description: str = "", expand: str | None = None) -> bytes:
    """``deltas``: number, date, text, and optionally author, state, log, commitid, branches, next."""
    out = [f"head\t{deltas[0]['number']};", "access;", "symbols" + "".join(f"\n\t{k}:{v}" for k, v in (symbols or {}).items()) + ";", "locks; strict;", "comment\t@# @;"]
    if expand:
        out.append(f"expand\t@{expand}@;")
    out.append("\n")
    for d in deltas:
        out.append(f"{d['number']}\ndate\t{d['date']};\tauthor {d.get('author', 'ann')};\tstate {d.get('state', 'Exp')};\nbranches" + "".join(f"\n\t{b}" for b in d.get("branches", ())) + f";\nnext\t{d.get('next', '')};")
        if d.get("commitid"):
            out.append(f"commitid\t{d['commitid']};")
        out.append("")
    out.append(f"\ndesc\n{quoted(description)}\n")
    for d in deltas:
        out.append(f"\n{d['number']}\nlog\n{quoted(d.get('log', 'change') + chr(10))}\ntext\n{quoted(d['text'])}\n")
    return "\n".join(out).encode()
