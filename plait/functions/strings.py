"""String and character functions. Positions count code points from 0."""

from __future__ import annotations

import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plait.functions.sem import ascii_lower, ascii_upper, col

#: The 25 white space characters that trimming removes.
WHITE_SPACE = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _fold(a: Any, b: Any, ignore_case: bool) -> tuple[Column, Column]:
    return (ascii_lower(a), ascii_lower(b)) if ignore_case else (col(a), col(b))


def length(s: Any) -> Column:
    """Code points, up to a NUL character."""
    s = col(s)
    return F.length(F.substring_index(s, "\0", 1))


def contains(s: Any, v: Any, ignore_case: bool = True) -> Column:
    return F.contains(*_fold(s, v, ignore_case))


def starts_with(s: Any, v: Any, ignore_case: bool = True) -> Column:
    return F.startswith(*_fold(s, v, ignore_case))


def ends_with(s: Any, v: Any, ignore_case: bool = True) -> Column:
    return F.endswith(*_fold(s, v, ignore_case))


def index_of(s: Any, v: Any, start: Any = 0) -> Column:
    s, v = col(s), col(v)
    begin = F.greatest(col(start), F.lit(0))
    rest = F.substring(s, begin + 1, F.length(s))
    at = F.instr(rest, v)
    return F.when(at > 0, at - 1 + begin).otherwise(F.when(at.isNotNull(), -1)).cast("int")


def last_index_of(s: Any, v: Any, start: Any = None) -> Column:
    s, v = col(s), col(v)
    if start is not None:
        s = F.substring(s, F.lit(1), col(start) + 1)
    at = F.length(s) - F.length(v) - F.instr(F.reverse(s), F.reverse(v)) + 1
    return F.when(v == "", F.length(s)).when(F.contains(s, v), at).otherwise(F.when(s.isNotNull() & v.isNotNull(), -1))


def insert(s: Any, at: Any, v: Any) -> Column:
    s, at = col(s), col(at)
    return F.concat(F.substring(s, F.lit(1), at), col(v), F.substring(s, at + 1, F.length(s)))


def remove(s: Any, at: Any, n: Any = None) -> Column:
    s, at = col(s), col(at)
    head = F.substring(s, F.lit(1), at)
    if n is None:
        return head
    return F.concat(head, F.substring(s, at + F.greatest(col(n), F.lit(0)) + 1, F.length(s)))


def replace(s: Any, a: Any, b: Any) -> Column:
    return F.replace(col(s), col(a), F.coalesce(col(b).cast("string"), F.lit("")))


def _strip(s: Any, chars: str | None, head: bool, tail: bool) -> Column:
    some = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in (WHITE_SPACE if chars is None else chars)) + "]+"
    parts = ([f"^{some}"] if head else []) + ([rf"{some}\z"] if tail else [])
    return F.regexp_replace(col(s), "|".join(parts), "")


def trim(s: Any, chars: str | None = None) -> Column:
    return _strip(s, chars, True, True)


def trim_start(s: Any, chars: str | None = None) -> Column:
    return _strip(s, chars, True, False)


def trim_end(s: Any, chars: str | None = None) -> Column:
    return _strip(s, chars, False, True)


def char_at(s: Any, i: Any) -> Column:
    return F.substring(col(s), col(i) + 1, F.lit(1))


def substring(s: Any, start: Any, n: Any = None) -> Column:
    s = col(s)
    begin = F.greatest(col(start), F.lit(0)) + 1
    return F.substring(s, begin, F.length(s) if n is None else col(n))


to_upper, to_lower = ascii_upper, ascii_lower


def pad_left(s: Any, n: int, c: str = " ") -> Column:
    s = col(s)
    return F.when(F.length(s) >= n, s).otherwise(F.lpad(s, n, c))


def pad_right(s: Any, n: int, c: str = " ") -> Column:
    s = col(s)
    return F.when(F.length(s) >= n, s).otherwise(F.rpad(s, n, c))


def compare(a: Any, b: Any, ignore_case: bool = False) -> Column:
    """-1, 0 or 1; null sorts first."""
    a, b = _fold(a, b, ignore_case)
    less = a.isNull() & b.isNotNull() | F.coalesce(a < b, F.lit(False))
    return F.when(a.eqNullSafe(b), 0).when(less, -1).otherwise(1)


def compare_part(a: Any, i: int, b: Any, j: int, n: int, ignore_case: bool = False) -> Column:
    return compare(substring(a, i, n), substring(b, j, n), ignore_case)


def equals(a: Any, b: Any, ignore_case: bool = False) -> Column:
    a, b = _fold(a, b, ignore_case)
    return a.eqNullSafe(b)


def is_null_or_empty(s: Any) -> Column:
    return F.coalesce(col(s), F.lit("")) == ""


def is_null_or_white_space(s: Any) -> Column:
    return trim(F.coalesce(col(s), F.lit(""))) == ""


def concat(*xs: Any) -> Column:
    return F.concat(*[F.coalesce(col(x).cast("string"), F.lit("")) for x in xs])


def join(sep: str, *xs: Any) -> Column:
    return F.array_join(F.array(*[F.coalesce(col(x).cast("string"), F.lit("")) for x in xs]), sep)


def instr(s: Any, v: Any) -> Column:
    return F.instr(col(s), col(v))


def unicode_of(s: Any) -> Column:
    return F.when(col(s) != "", F.ascii(col(s)))


def char_of(*points: Any) -> Column:
    return F.concat(*[F.decode(F.unhex(F.lpad(F.hex(col(p).cast("bigint")), 8, "0")), "UTF-32") for p in points])


@F.pandas_udf(StringType())
def _g15(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else f"{v:.15g}")


def real_text(x: Any) -> Column:
    """A real as text with 15 significant digits."""
    return _g15(col(x).cast("double"))


def printf(fmt: str, *xs: Any) -> Column:
    """printf; %g goes by 15-digit text, the rest is Java's formatter."""
    args, parts = [], re.split(r"(%(?:[-+ 0#]*\d*(?:\.\d+)?)[a-zA-Z%])", fmt)
    it, out = iter(xs), []
    for p in parts:
        if p.startswith("%") and p != "%%":
            x = next(it)
            if p.endswith("g"):
                p, x = "%s", real_text(x)
            elif p[-1] in "di":
                p, x = p[:-1] + "d", col(x).cast("bigint")
            args.append(col(x))
        out.append(p)
    return F.format_string("".join(out), *args) if args else F.lit(fmt.replace("%%", "%"))


def glob(pattern: str, s: Any) -> Column:
    """Case-sensitive match with *, ? and [..]."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (j := pattern.find("]", i + 2)) > 0:
            inside = pattern[i + 1 : j].replace("\\", "\\\\").replace("[", "\\[")
            out += f"[{inside}]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return col(s).rlike(f"(?s)^{out}\\z")


def regexp(s: Any, pattern: str) -> Column:
    return col(s).rlike(pattern)


def is_white_space(c: Any) -> Column:
    return F.when(col(c).isNotNull(), (F.length(col(c)) > 0) & (trim(c) == ""))


def is_ascii_digit(c: Any) -> Column:
    return col(c).rlike("^[0-9]$")


def is_ascii_letter(c: Any) -> Column:
    return col(c).rlike("^[A-Za-z]$")


def is_ascii_letter_or_digit(c: Any) -> Column:
    return col(c).rlike("^[A-Za-z0-9]$")


def is_ascii_lower(c: Any) -> Column:
    return col(c).rlike("^[a-z]$")


def is_ascii_upper(c: Any) -> Column:
    return col(c).rlike("^[A-Z]$")
