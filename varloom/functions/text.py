"""String helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shortest start of the first line after which the second line goes on differently; only one line end follows
#: the first line's rest, so that it is taken as a whole and never given back.
_PARTING = "^(.*?)(.).*+\n\\1(?!\\2)"


def common_prefix(x: Column, y: Column) -> Column:
    """Length of the longest common prefix of two strings without line breaks.

    One regular expression over both strings, so that each is evaluated once; unlike end
    marks make them part at the latest where the shorter ends.
    """
    both = F.concat(x, F.lit("\u0001\n"), y, F.lit("\u0002"))
    return F.length(F.regexp_extract(both, _PARTING, 1))


def common_suffix(x: Column, y: Column) -> Column:
    return common_prefix(F.reverse(x), F.reverse(y))


def tail(x: Column, n: Column) -> Column:
    """Last n characters (all if there are fewer, none for n <= 0)."""
    return F.when(n <= 0, F.lit("")).otherwise(F.substring(x, F.greatest(F.length(x) - n + 1, F.lit(1)), n))


def head(x: Column, n: Column) -> Column:
    return F.when(n <= 0, F.lit("")).otherwise(F.substring(x, F.lit(1), n))


def strict_int(x: Column, kind: str = "int") -> Column:
    """Digits with an optional sign and nothing else; null for all else and out of range."""
    return F.when(x.rlike(r"^[+-]?[0-9]+$"), x.try_cast(kind))


#: Decimal, exponent, infinity and not-a-number spellings; no white space, no type suffix.
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"


def strict_double(x: Column) -> Column:
    return F.when(x.rlike(FLOAT), x.try_cast("double"))


def all_or_null(values: Column) -> Column:
    """The array, or null if any element is null."""
    return F.when(~F.exists(values, lambda v: v.isNull()), values)


def unescape(x: Column) -> Column:
    """Four percent escapes only, %25 first, so that %252C ends as a comma."""
    for code, sign in (("%25", "%"), ("%2C", ","), ("%3B", ";"), ("%3D", "=")):
        x = F.replace(x, F.lit(code), F.lit(sign))
    return x
