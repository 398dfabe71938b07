"""Storage-class, literal, hex and random functions; custom functions and converters."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from plait.functions.sem import col

_CLASSES = {
    "integer": ("boolean", "tinyint", "smallint", "int", "bigint"),
    "real": ("float", "double"),
    "text": ("string",),
    "blob": ("binary",),
}


def type_of(x: Any) -> Column:
    """null, integer, real, text or blob."""
    x = col(x)
    kind = F.typeof(x)
    out = F.when(x.isNull(), "null").when(F.startswith(kind, F.lit("decimal")), "real")
    for name, kinds in _CLASSES.items():
        out = out.when(kind.isin(*kinds), name)
    return out.otherwise("text")


def quote(x: Any, kind: str = "text") -> Column:
    """x as an SQL literal; kind: text, number or blob."""
    x = col(x)
    text = {
        "text": lambda: F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'")),
        "number": lambda: x.cast("string"),
        "blob": lambda: F.concat(F.lit("X'"), F.hex(x), F.lit("'")),
    }[kind]()
    return F.coalesce(text, F.lit("NULL"))


def hex_(x: Any) -> Column:
    return F.hex(col(x).cast("binary"))


def unhex(x: Any, ignore: str = "") -> Column:
    x = col(x)
    if ignore:
        x = F.translate(x, ignore, "")
    return F.when(F.length(x) % 2 == 0, F.unhex(x))


def zeroblob(n: Any) -> Column:
    return F.unhex(F.repeat(F.lit("00"), col(n)))


def random() -> Column:
    """Any 64-bit integer."""
    return (F.floor(F.rand() * 2**32).cast("bigint") * 2**31 + F.floor(F.rand() * 2**31).cast("bigint")) * F.when(F.rand() < 0.5, 1).otherwise(-1)


def random_blob(n: int) -> Column:
    return F.unhex(F.substring(F.concat(*[F.replace(F.uuid(), F.lit("-"), F.lit("")) for _ in range(-(-n // 16))]), 1, 2 * n))


def new_guid() -> Column:
    return F.uuid()


class Functions:
    """Custom functions: names to macros over columns, so Catalyst sees them.
    A name registered again replaces the earlier one."""

    def __init__(self) -> None:
        self._macros: dict[str, Callable[..., Column]] = {}

    def add(self, name: str, macro: Callable[..., Column]) -> None:
        self._macros[name] = macro

    def __getattr__(self, name: str) -> Callable[..., Column]:
        try:
            return self.__dict__["_macros"][name]
        except KeyError:
            raise AttributeError(f"no function {name}") from None


class Converter:
    """A user type: how its values are stored in, and read from, columns."""

    def __init__(self, encode: Callable[[Any], Any], read: Callable[[Column], Column] = lambda c: c):
        self.encode, self.read = encode, read
