"""Column expressions over names, dates, logs and other text."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that results must carry as they are.
EMPTY_LOG = "*** empty log message ***\n"
INITIAL_LOG = "Initial revision\n"
DEFAULT_IGNORES = (
    "# CVS default ignores begin\ntags\nTAGS\n.make.state\n.nse_depinfo\n*~\n#*\n.#*\n,*\n_$*\n*$\n*.old\n*.bak\n*.BAK\n*.orig\n*.rej\n"
    ".del-*\n*.a\n*.olb\n*.o\n*.obj\n*.so\n*.exe\n*.Z\n*.elc\n*.ln\ncore\n# CVS default ignores end\n"
)
EXPAND_MODES = ("kv", "kvl", "k", "v", "o", "b")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sanitised(name: Column | str) -> Column:
    """A name without white space, control and non-ASCII characters, and ``~^\\*?``."""
    return F.regexp_replace(_col(name), r"[^\x21-\x7e]|[~^\\*?]", "")


def bad_ref(name: Column | str) -> Column:
    """Whether even the sanitised name can't be a reference."""
    clean = sanitised(name)
    return (clean == "") | clean.contains("..") | clean.contains("@{")


def rcs_timestamp(text: Column | str) -> Column:
    """``yy.mm.dd.hh.mi.ss``; years up to 1900 count from 1900."""
    parts = F.transform(F.split(_col(text), "[.]"), lambda x: x.cast("int"))
    year = F.get(parts, 0)
    return F.make_timestamp(F.when(year > 1900, year).otherwise(year + 1900), F.get(parts, 1), F.get(parts, 2), F.get(parts, 3), F.get(parts, 4), F.get(parts, 5).cast("decimal(8,6)"), F.lit("UTC"))


def command_date(text: str) -> int:
    """A date given as an option, in Unix seconds: a number, or a date with an optional zone."""
    found = re.search(r"(\d{4})[-/](\d\d)[-/](\d\d)[ T](\d\d):(\d\d):(\d\d)(?:\s*([+-])(\d\d)(\d\d))?", text)
    if not found:
        return int(text)
    at = dt.datetime(*map(int, found.groups()[:6]), tzinfo=dt.timezone.utc).timestamp()
    sign, hours, minutes = found.groups()[6:]
    return int(at) - (0 if sign is None else int(sign + "1") * (int(hours) * 3600 + int(minutes) * 60))


def rfc3339(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def zone_offset(ts: Column, zone: Column) -> Column:
    """``+hhmm`` of a zone, named or itself an offset, at a time."""
    numeric = zone.rlike(r"^[+-]\d{4}$")
    named = F.when(numeric, F.lit("UTC")).otherwise(zone)
    seconds = F.unix_timestamp(F.from_utc_timestamp(ts, named)) - F.unix_timestamp(ts)
    minutes = F.abs(seconds) / 60
    text = F.format_string("%s%02d%02d", F.when(seconds < 0, "-").otherwise("+"), F.floor(minutes / 60).cast("int"), (F.floor(minutes) % 60).cast("int"))
    return F.when(numeric, zone).otherwise(text)


def author_stamp(ts: Column | str, zone: Column | str) -> Column:
    """Unix seconds and the author's offset."""
    ts, zone = _col(ts), _col(zone)
    return F.concat(F.unix_timestamp(ts).cast("string"), F.lit(" "), zone_offset(ts, zone))


def forced_seconds(mark: Column | str, window: int = 300) -> Column:
    """The date that stands for a commit when dates are forced."""
    return (F.lit(100_000) + _col(mark) * F.lit(2 * window)).cast("long")


def mode(executable: Column | str) -> Column:
    return F.when(_col(executable), "100755").otherwise("100644")


def default_log(log: Column | str, description: Column | str) -> Column:
    """The file's description takes the place of the log of an import."""
    log, description = _col(log), _col(description)
    filled = F.when(F.coalesce(description, F.lit("")) == "", EMPTY_LOG).otherwise(description)
    return F.when(log == INITIAL_LOG, filled).otherwise(log)


def expand_mode(text: Column | str) -> Column:
    """A known mode, or null."""
    text = _col(text)
    return F.when(text.isin(*EXPAND_MODES), text)


def resolved_mode(master: Column | str, option: str | None = None) -> Column:
    """Binary masters stay binary; then the option, the master, and binary."""
    own = expand_mode(master)
    return F.when(own == "b", "b").otherwise(F.coalesce(F.lit(option), own, F.lit("b")))


def log_label(log: Column | str) -> Column:
    """A log's beginning, for a graph: one short line without brackets and controls.

    Of the first 48 characters, up to a line end after the sixth, or a sentence's end.
    """
    head = F.substring(_col(log), 1, 48)
    head = F.regexp_replace(head, r"(?s)^(.{6}[^\n]*)\n.*$", "$1")
    full_stop = F.regexp_replace(head, r"(?s)^(.*?\.)[ \t\n\x0b\f\r].*$", "$1")
    plain = F.regexp_replace(full_stop, r"[^\x20-\x7f]|[()\[\]{}]", "")
    return F.replace(plain, F.lit('"'), F.lit('\\"'))


def at_unescaped(text: Column | str) -> Column:
    return F.replace(_col(text), F.lit("@@"), F.lit("@"))


def at_escaped(text: Column | str) -> Column:
    return F.replace(_col(text), F.lit("@"), F.lit("@@"))


def value_escaped(text: Column | str) -> Column:
    """What stands in a keyword's value instead of white space, dollars and backslashes."""
    out = F.replace(_col(text), F.lit("\\"), F.lit("\\\\"))
    for char, instead in (("\t", "\\t"), ("\n", "\\n"), (" ", "\\040"), ("$", "\\044")):
        out = F.replace(out, F.lit(char), F.lit(instead))
    return out


def keyword_expanded(text: Column | str, keyword: str, value: Column) -> Column:
    """Text with one single-line keyword expanded, in Spark alone."""
    safe = F.regexp_replace(value, r"([\\$])", r"\\$1")
    return F.regexp_replace(_col(text), F.lit(rf"\${keyword}(?::[^$\n]*)?\$"), F.concat(F.lit(rf"\${keyword}: "), safe, F.lit(r" \$")))


def branch_ref(name: Column | str, remote: str | None = None) -> Column:
    return F.concat(F.lit(f"refs/remotes/{remote}/" if remote else "refs/heads/"), _col(name))


def vendor_branch_name(rev: Column | str) -> Column:
    return F.concat(F.lit("import-"), F.array_join(F.slice(_col(rev), 1, 3).cast("array<string>"), "."))


def unnamed_branch_name(parent: Column | str, commitid: Column | str) -> Column:
    return F.concat_ws("-", F.coalesce(_col(parent), F.lit("null")), F.lit("UNNAMED-BRANCH"), _col(commitid))


def is_junk_branch(name: Column | str) -> Column:
    name = _col(name)
    return name.startswith("import-") | name.contains("UNNAMED")


def repository_url(url: Column | str) -> Column:
    """Host, path and module of ``cvs://[user@]host/path[#module]``."""
    url = _col(url)
    pattern = r"^(?:cvs|https?)://(?:[^@/]*@)?([^/]*)(/[^#]*)?(?:#(.*))?$"
    return F.struct(*[F.regexp_extract(url, pattern, i).alias(n) for i, n in ((1, "host"), (2, "path"), (3, "module"))])


#: For hosts whose name contains the first, how a module's files are addressed.
MIRROR_HOSTS = (("sourceforge", "{project}::{root}/{module}/"), ("berlios", "cvs.berlios.de::{module}_cvs"), ("sourceware", "{host}::{second}-cvs/{module}/"), ("savannah", "rsync://vcs.savannah.gnu.org{root}/{module}/"))
MIRROR_ROOTS = {"sourceforge": "/cvsroot", "savannah": "/sources"}


def mirror_source(host: Column | str, path: Column | str, module: Column | str) -> Column:
    """Where a module of a repository is mirrored from: known hosts have forms of their own,
    others ``host:path/module/``.

    A known host's root is put before paths that lack it; the first form names the project,
    the path's last part, before the host and drops the leading slash.
    """
    host, path, module = _col(host), _col(path), _col(module)

    def filled(form: str, values: dict[str, Column]) -> Column:
        parts = re.split(r"[{}]", form)
        return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts) if x])

    out = F.lit(None).cast("string")
    for i, (name, form) in enumerate(MIRROR_HOSTS):
        root = F.when(path.startswith(MIRROR_ROOTS[name]), path).otherwise(F.concat(F.lit(MIRROR_ROOTS[name]), path)) if name in MIRROR_ROOTS else path
        project = F.element_at(F.split(root, "/"), -1)
        own = F.when(host.startswith(F.concat(project, F.lit("."))), host).otherwise(F.concat(project, F.lit("."), host))
        below = F.substring(root, 2, 2**31 - 1) if "{project}" in form else root
        made = filled(form, {"host": host, "project": own, "root": below, "module": module, "second": F.coalesce(F.get(F.split(path, "/"), 2), F.lit(""))})
        out = F.when(host.contains(name), made) if i == 0 else out.when(host.contains(name), made)
    return out.otherwise(F.concat(host, F.lit(":"), path, F.lit("/"), module, F.lit("/")))
