"""JSON text: reads by built-in functions, changes by Arrow-batched Python."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from plait.functions.sem import col


def extract(x: Any, path: str, kind: str = "string") -> Column:
    return F.get_json_object(col(x), path).try_cast(kind)


def valid(x: Any) -> Column:
    return F.try_parse_json(col(x)).isNotNull()


def array_length(x: Any, path: str | None = None) -> Column:
    return F.json_array_length(col(x) if path is None else F.get_json_object(col(x), path))


def minify(x: Any) -> Column:
    return F.to_json(F.parse_json(col(x)))


to_jsonb = lambda x: F.parse_json(col(x))


def type_of(x: Any, path: str = "$") -> Column:
    """null, true, false, integer, real, text, array or object."""
    kind = F.schema_of_variant(F.try_variant_get(F.parse_json(col(x)), path, "variant"))
    value = F.try_variant_get(F.parse_json(col(x)), path, "boolean")
    return (
        F.when(kind == "VOID", "null")
        .when(kind == "BOOLEAN", F.when(value, "true").otherwise("false"))
        .when(kind.isin("TINYINT", "SMALLINT", "INT", "BIGINT"), "integer")
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "real")
        .when(kind == "STRING", "text")
        .when(F.startswith(kind, F.lit("ARRAY")), "array")
        .when(F.startswith(kind, F.lit("OBJECT")), "object")
    )


def _steps(path: str) -> list:
    if not path.startswith("$"):
        raise ValueError(f"not a JSON path: {path}")
    out: list = []
    for name, quoted, index in re.findall(r'\.([^.\["]+)|\."([^"]*)"|\[(#(?:-\d+)?|\d+)\]', path[1:]):
        out.append(index if index.startswith("#") else int(index) if index else name or quoted)
    return out


def _change(doc: Any, steps: list, value: Any, make: bool, over: bool) -> Any:
    """doc with value at the path; make: where there is none, over: where there is one."""
    if not steps:
        return value if over else doc
    at = doc
    for i, s in enumerate(steps):
        last = i == len(steps) - 1
        if isinstance(at, dict) and isinstance(s, str) and not s.startswith("#"):
            there = s in at
            if last:
                if over if there else make:
                    at[s] = value
                return doc
            if not there:
                if not make:
                    return doc
                at[s] = {} if isinstance(steps[i + 1], str) and not steps[i + 1].startswith("#") else []
            at = at[s]
        elif isinstance(at, list) and not (isinstance(s, str) and not s.startswith("#")):
            n = len(at) + int(s[1:] or 0) if isinstance(s, str) else s
            there = 0 <= n < len(at)
            if last:
                if there and over:
                    at[n] = value
                elif n == len(at) and make:
                    at.append(value)
                return doc
            if not there:
                return doc
            at = at[n]
        else:
            return doc
    return doc


def _drop(doc: Any, steps: list) -> Any:
    if not steps:
        return None
    at = doc
    for i, s in enumerate(steps):
        n = s
        if isinstance(at, list):
            n = len(at) + int(s[1:] or 0) if isinstance(s, str) and s.startswith("#") else s
            if not isinstance(n, int) or not 0 <= n < len(at):
                return doc
        elif not isinstance(at, dict) or s not in at:
            return doc
        if i == len(steps) - 1:
            del at[n]
            return doc
        at = at[n]
    return doc


def _merge(doc: Any, patch: Any) -> Any:
    """RFC 7396 merge patch."""
    if not isinstance(patch, dict):
        return patch
    out = dict(doc) if isinstance(doc, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = _merge(out.get(k), v)
    return out


def _mutator(x: Any, fn: Callable[[Any, Any], Any], value: Any = None) -> Column:
    @F.pandas_udf("string")
    def run(docs: pd.Series, values: pd.Series) -> pd.Series:
        def one(d: Any, v: Any) -> str | None:
            return None if d is None else json.dumps(fn(json.loads(d), None if v is None else json.loads(v)), separators=(",", ":"), ensure_ascii=False)

        return pd.Series([one(d, v) for d, v in zip(docs, values, strict=True)])

    return run(col(x), _as_json(value))


def _as_json(value: Any) -> Column:
    """A column by to_json of a one-field struct; a Python value directly."""
    if not isinstance(value, Column):
        return F.lit(json.dumps(value))
    whole = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.regexp_extract(whole, r'(?s)^\{"v":(.*)\}$', 1)


def set_(x: Any, path: str, value: Any) -> Column:
    steps = _steps(path)
    return _mutator(x, lambda d, v: _change(d, steps, v, True, True), value)


def insert(x: Any, path: str, value: Any) -> Column:
    steps = _steps(path)
    return _mutator(x, lambda d, v: _change(d, steps, v, True, False), value)


def replace(x: Any, path: str, value: Any) -> Column:
    steps = _steps(path)
    return _mutator(x, lambda d, v: _change(d, steps, v, False, True), value)


def remove(x: Any, path: str) -> Column:
    steps = _steps(path)
    return _mutator(x, lambda d, v: _drop(d, steps))


def patch(x: Any, with_: Any) -> Column:
    if not isinstance(with_, Column):
        return _mutator(x, _merge, with_)

    @F.pandas_udf("string")
    def run(docs: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([None if d is None or v is None else json.dumps(_merge(json.loads(d), json.loads(v)), separators=(",", ":"), ensure_ascii=False) for d, v in zip(docs, values, strict=True)])

    return run(col(x), with_)
