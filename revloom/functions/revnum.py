"""Column expressions over revision numbers.

A number is an ``array<int>``.  Spark orders such arrays component by component with the
shorter prefix first, which is the order of revisions, so they sort and compare as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse(text: Column | str) -> Column:
    """``1.2.4`` to [1, 2, 4]."""
    return F.transform(F.split(_col(text), "[.]"), lambda x: x.cast("int"))


def render(rev: Column | str) -> Column:
    return F.array_join(_col(rev).cast("array<string>"), ".")


def label(path: Column | str, rev: Column | str, separator: str = " ") -> Column:
    """A file's revision as one string."""
    return F.concat(_col(path), F.lit(separator), render(rev))


def is_magic(rev: Column | str) -> Column:
    """Whether a symbol's number names a branch: a.b.0.k."""
    rev = _col(rev)
    return (F.size(rev) > 2) & (F.size(rev) % 2 == 0) & (F.element_at(rev, F.greatest(F.size(rev) - 1, F.lit(1))) == 0)


def is_trunk(rev: Column | str) -> Column:
    return F.size(_col(rev)) == 2


def is_vendor(rev: Column | str) -> Column:
    """1.1.n.m with an odd n: an imported revision."""
    rev = _col(rev)
    return (F.size(rev) == 4) & (F.get(rev, 0) == 1) & (F.get(rev, 1) == 1) & (F.get(rev, 2) % 2 == 1)


def branch_key(rev: Column | str) -> Column:
    """Equal for numbers on one branch; empty for the trunk."""
    rev = _col(rev)
    n = F.size(rev)
    magic = F.concat(F.slice(rev, 1, F.greatest(n - 2, F.lit(0))), F.slice(rev, F.greatest(n, F.lit(1)), 1))
    own = F.slice(rev, 1, F.greatest(n - 1, F.lit(0)))
    return F.when(n <= 2, F.slice(rev, 1, 0)).when(is_magic(rev), magic).when(n % 2 == 1, rev).otherwise(own)


def same_branch(a: Column | str, b: Column | str) -> Column:
    return branch_key(a) == branch_key(b)


def degree(rev: Column | str) -> Column:
    """Components, one fewer on a vendor line."""
    rev = _col(rev)
    return F.size(rev) - F.when(is_vendor(F.slice(rev, 1, 4)), 1).otherwise(0)


def sprout(rev: Column | str) -> Column:
    """The revision that a branch revision's branch grows from."""
    rev = _col(rev)
    return F.slice(rev, 1, F.greatest(F.size(rev) - 2, F.lit(0)))


def prefixes(key: Column | str) -> Column:
    """The branch key and those of the branches it nests in, longest first.

    The trunk is the empty key; a.b.c nests in it, a.b.c.d.e in a.b.c.
    """
    key = _col(key)
    steps = F.sequence(F.lit(0), F.floor(F.size(key) / 2).cast("int"))
    kept = F.transform(steps, lambda i: F.size(key) - 2 * i)
    return F.transform(kept, lambda n: F.slice(key, 1, F.when(n <= 1, 0).otherwise(n).cast("int")))
