"""Strings elementwise: widths never truncate, positions count from 0 and -1 means absent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def upper(s): return F.upper(_c(s))  # noqa: E704
def lower(s): return F.lower(_c(s))  # noqa: E704
def reverse(s): return F.reverse(_c(s))  # noqa: E704
def str_len(s): return F.length(_c(s))  # noqa: E704


def capitalize(s) -> Column:
    s = _c(s)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 2**30)))


def swapcase(s) -> Column:
    chars = F.split(_c(s), "")
    return F.array_join(F.transform(chars, lambda c: F.when(F.upper(c) == c, F.lower(c)).otherwise(F.upper(c))), "")


def title(s) -> Column:
    """Any character without case starts a new word."""
    s = _c(s)
    parts = F.regexp_extract_all(s, F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, capitalize), "")


def add(a, b): return F.concat(_c(a), _c(b))  # noqa: E704
def multiply(s, n): return F.repeat(_c(s), n)  # noqa: E704


def _pad(s, width: int, fill: str, side: str) -> Column:
    s = _c(s)
    short = F.length(s) < width
    if side == "center":
        left = F.floor((F.lit(width) - F.length(s)) / 2).cast("int")
        both = F.concat(F.repeat(F.lit(fill), left), s, F.repeat(F.lit(fill), (F.lit(width) - F.length(s) - left).cast("int")))
        return F.when(short, both).otherwise(s)
    return F.when(short, F.lpad(s, width, fill) if side == "right" else F.rpad(s, width, fill)).otherwise(s)


def ljust(s, width, fill=" "): return _pad(s, width, fill, "left")  # noqa: E704
def rjust(s, width, fill=" "): return _pad(s, width, fill, "right")  # noqa: E704
def center(s, width, fill=" "): return _pad(s, width, fill, "center")  # noqa: E704


def zfill(s, width: int) -> Column:
    """Zeros after a sign."""
    s = _c(s)
    signed = s.rlike(r"^[+-]")
    body = F.when(signed, F.substring(s, 2, 2**30)).otherwise(s)
    sign = F.when(signed, F.substring(s, 1, 1)).otherwise(F.lit(""))
    zeros = F.greatest(F.lit(width) - F.length(s), F.lit(0))
    return F.concat(sign, F.repeat(F.lit("0"), zeros), body)


def strip(s, chars=SPACE): return F.btrim(_c(s), F.lit(chars))  # noqa: E704
def lstrip(s, chars=SPACE): return F.ltrim(_c(s), F.lit(chars))  # noqa: E704
def rstrip(s, chars=SPACE): return F.rtrim(_c(s), F.lit(chars))  # noqa: E704


def find(s, part: str) -> Column:
    return F.instr(_c(s), part) - 1


def rfind(s, part: str) -> Column:
    s = _c(s)
    back = F.instr(F.reverse(s), part[::-1])
    return F.when(back == 0, F.lit(-1)).otherwise(F.length(s) - back - len(part) + 1)


def index(s, part: str) -> Column:
    """As find, but absence raises."""
    at = find(s, part)
    return F.when(at < 0, F.raise_error(F.lit("substring not found")).cast("int")).otherwise(at)


def rindex(s, part: str) -> Column:
    """As rfind, but absence raises."""
    at = rfind(s, part)
    return F.when(at < 0, F.raise_error(F.lit("substring not found")).cast("int")).otherwise(at)


def slice(s, start: int | None = None, stop: int | None = None) -> Column:  # noqa: A001
    """Characters from ``start`` before ``stop``, negative ones counted from the end."""
    s = _c(s)
    n = F.length(s)

    def place(x: int | None, default: Column) -> Column:
        if x is None:
            return default
        return F.least(F.lit(x), n) if x >= 0 else F.greatest(n + x, F.lit(0))

    a, b = place(start, F.lit(0)), place(stop, n)
    return F.substring(s, a + 1, F.greatest(b - a, F.lit(0)))


def mod(pattern: str, *values) -> Column:
    """A printf pattern filled with columns."""
    return F.format_string(pattern, *[_c(v) for v in values])


def equal(a, b): return _c(a) == _c(b)  # noqa: E704
def not_equal(a, b): return _c(a) != _c(b)  # noqa: E704
def less(a, b): return _c(a) < _c(b)  # noqa: E704
def less_equal(a, b): return _c(a) <= _c(b)  # noqa: E704
def greater(a, b): return _c(a) > _c(b)  # noqa: E704
def greater_equal(a, b): return _c(a) >= _c(b)  # noqa: E704


def compare_chararrays(a, b, op: str, rstrip: bool = True) -> Column:
    """A comparison by code point, by default without white space at the ends."""
    ops = {"==": equal, "!=": not_equal, "<": less, "<=": less_equal, ">": greater, ">=": greater_equal}
    end = (lambda x: F.rtrim(_c(x), F.lit(SPACE))) if rstrip else _c
    return ops[op](end(a), end(b))


def count(s, part: str) -> Column:
    """Without overlaps."""
    s = _c(s)
    if not part:
        return F.length(s) + 1
    return ((F.length(s) - F.length(F.replace(s, F.lit(part), F.lit("")))) / len(part)).cast("int")


def startswith(s, part): return F.startswith(_c(s), F.lit(part))  # noqa: E704
def endswith(s, part): return F.endswith(_c(s), F.lit(part))  # noqa: E704


def replace(s, old: str, new: str) -> Column:
    return F.replace(_c(s), F.lit(old), F.lit(new))


def _class(s, pattern: str) -> Column:
    return _c(s).rlike(pattern)


def isalpha(s): return _class(s, r"^\p{L}+$")  # noqa: E704
def isdecimal(s): return _class(s, r"^\p{Nd}+$")  # noqa: E704
def isdigit(s): return _class(s, r"^[\p{Nd}²³¹⁰-⁹₀-₉]+$")  # noqa: E704
def isnumeric(s): return _class(s, r"^\p{N}+$")  # noqa: E704
def isalnum(s): return _class(s, r"^[\p{L}\p{N}]+$")  # noqa: E704
def isspace(s): return _class(s, r"^[\s\x1c-\x1f\x85\p{Z}]+$")  # noqa: E704
def isupper(s): return _class(s, r"\p{Lu}") & ~_class(s, r"[\p{Ll}\p{Lt}]")  # noqa: E704
def islower(s): return _class(s, r"\p{Ll}") & ~_class(s, r"[\p{Lu}\p{Lt}]")  # noqa: E704


def istitle(s) -> Column:
    s = _c(s)
    return s.rlike(r"\p{Lu}") & (title(s) == s)


def partition(s, sep: str) -> Column:
    """(head, sep, tail) at the first separator."""
    s = _c(s)
    at = F.instr(s, sep)
    none = F.struct(s.alias("head"), F.lit("").alias("sep"), F.lit("").alias("tail"))
    cut = F.struct(F.substring(s, F.lit(1), at - 1).alias("head"), F.lit(sep).alias("sep"), F.substring(s, at + len(sep), F.lit(2**30)).alias("tail"))
    return F.when(at == 0, none).otherwise(cut)


def rpartition(s, sep: str) -> Column:
    s = _c(s)
    at = rfind(s, sep) + 1
    none = F.struct(F.lit("").alias("head"), F.lit("").alias("sep"), s.alias("tail"))
    cut = F.struct(F.substring(s, F.lit(1), at - 1).alias("head"), F.lit(sep).alias("sep"), F.substring(s, at + len(sep), F.lit(2**30)).alias("tail"))
    return F.when(at == 0, none).otherwise(cut)


def _literal(sep: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() else c for c in sep)


def split(s, sep: str | None = None, maxsplit: int = -1) -> Column:
    s = _c(s)
    if sep is None:
        trimmed = F.btrim(s, F.lit(SPACE))
        return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+", maxsplit + 1 if maxsplit >= 0 else -1))
    return F.split(s, _literal(sep), maxsplit + 1 if maxsplit >= 0 else -1)


def rsplit(s, sep: str | None = None, maxsplit: int = -1) -> Column:
    """As split, but the cuts are counted from the end."""
    if maxsplit < 0:
        return split(s, sep)
    parts = split(F.reverse(_c(s)), None if sep is None else sep[::-1], maxsplit)
    return F.reverse(F.transform(parts, F.reverse))


def splitlines(s) -> Column:
    parts = F.split(_c(s), "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def join(sep: str, parts) -> Column:
    return F.array_join(_c(parts), sep)


def expandtabs(s, size: int = 8) -> Column:
    """Tabs to the next column that is a multiple of ``size``."""
    pieces = F.split(_c(s), "\t")

    def grown(acc, piece):
        line = F.length(F.element_at(F.split(acc, "\n"), -1))
        return F.concat(acc, F.repeat(F.lit(" "), (size - line % size).cast("int")), piece)

    return F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), F.get(pieces, F.lit(0)), grown)


def translate(s, old: str, new: str): return F.translate(_c(s), old, new)  # noqa: E704
def regex_match(s, pattern: str): return _c(s).rlike(pattern)  # noqa: E704
def regex_extract(s, pattern: str, group: int = 0): return F.regexp_extract(_c(s), pattern, group)  # noqa: E704


def encode(s, charset="utf-8"): return F.encode(_c(s), charset)  # noqa: E704
def decode(s, charset="utf-8"): return F.decode(_c(s), charset)  # noqa: E704
