"""Databases: registered tables with declared schemas, default filters and views."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plait.functions.misc import Converter, Functions
from plait.operators.recursive import recursive_union, recursive_union_all
from plait.plans.query import Query, SequenceError

#: Schemas of the tables that the driver lays out.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
}


class SchemaError(ValueError):
    pass


@dataclass
class Table:
    """A registered table. computed: columns derived on load; checks: predicates
    that every row must meet (asserted by verify); read_only: no writes."""

    name: str
    path: str
    schema: StructType
    format: str = "parquet"
    read_only: bool = False
    computed: dict[str, Column] = field(default_factory=dict)
    checks: list[Column] = field(default_factory=list)
    converters: dict[str, Converter] = field(default_factory=dict)
    kinds: tuple[str, ...] = ()


class Database:
    """Tables of a folder, by name. Scans carry the declared schema, so nothing
    is inferred, and filters and projections reach the files."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str] | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.fn = Functions()
        self._tables: dict[str, Table] = {}
        self._views: dict[str, Callable[[], Query]] = {}
        self._filters: list[tuple[str, Callable[[DataFrame], Column]]] = []
        self._attached: dict[str, Database] = {}
        self._kept: list[DataFrame] = []
        for name, ddl in (SCHEMAS if schemas is None else schemas).items():
            self.register(name, ddl)

    def register(self, name: str, ddl: str | StructType, path: str | None = None, **options: Any) -> Table:
        schema = ddl if isinstance(ddl, StructType) else StructType.fromDDL(ddl)
        at = path or f"{self.path}/{name}.{options.get('format', 'parquet')}"
        self._tables[name] = Table(name, at, schema, **options)
        return self._tables[name]

    def validate(self, name: str) -> None:
        """The declared columns must be in the files, with their types."""
        t = self._tables[name]
        there = {f.name: f.dataType for f in self.spark.read.format(t.format).load(t.path).schema}
        bad = [f"{f.name} {f.dataType.simpleString()}" for f in t.schema if there.get(f.name) != f.dataType]
        if bad:
            raise SchemaError(f"{name}: {', '.join(bad)} not as declared")

    def verify(self, name: str) -> int:
        """Rows that break a check of the table."""
        t, df = self._tables[name], self.frame(name, filters=False)
        return sum(df.filter(~F.coalesce(c, F.lit(True))).count() for c in t.checks)

    def add_filter(self, name: str, pred: Callable[[DataFrame], Column]) -> None:
        """A predicate on every scan of a table, or of all tables of a kind."""
        self._filters.append((name, pred))

    def frame(self, name: str, filters: bool = True) -> DataFrame:
        if "." in name:
            db, _, rest = name.partition(".")
            return self._attached[db].frame(rest, filters)
        if name in self._views:
            return self._views[name]().df
        t = self._tables[name]
        df = self.spark.read.format(t.format).schema(t.schema).load(t.path)
        for c, conv in t.converters.items():
            df = df.withColumn(c, conv.read(F.col(c)))
        for c, expr in t.computed.items():
            df = df.withColumn(c, expr)
        if filters:
            for kind, pred in self._filters:
                if kind == name or kind in t.kinds:
                    df = df.filter(pred(df))
        return df

    def table(self, name: str, filters: bool = True) -> Query:
        return Query(self.frame(name, filters), self)

    read_only_table = table

    def save(self, name: str, rows: Query | DataFrame, mode: str = "append") -> int:
        """Write rows to a table: append to it, or overwrite it. Columns go by
        name, through the table's converters; rows that break a check are an
        error. An overwritten table moves to a new folder, so its old files may
        be read by what is written. Gives the number of rows."""
        t = self._tables[name]
        if t.read_only:
            raise PermissionError(f"{name} is read-only")
        if mode not in ("append", "overwrite"):
            raise ValueError(mode)
        df = rows.df if isinstance(rows, Query) else rows
        broken = [df.filter(~F.coalesce(c, F.lit(True))).limit(1).count() for c in t.checks]
        if any(broken):
            raise ValueError(f"rows break a check of {name}")
        out = df.select(*[(t.converters[f.name].encode(F.col(f.name)) if f.name in t.converters else F.col(f.name)).cast(f.dataType).alias(f.name) for f in t.schema])
        path = t.path if mode == "append" else f"{t.path.rstrip('/')}-{uuid.uuid4().hex}"
        out.write.format(t.format).mode("append").save(path)
        n = self.spark.read.format(t.format).schema(t.schema).load(path).count() if mode == "overwrite" else df.count()
        t.path = path
        return n

    # databases side by side

    def attach(self, name: str, path: str, schemas: dict[str, str] | None = None) -> Database:
        self._attached[name] = Database(self.spark, path, schemas)
        return self._attached[name]

    def detach(self, name: str) -> None:
        del self._attached[name]

    # other sources

    def from_sql(self, sql: str, **params: Any) -> Query:
        """A SELECT over the registered tables, with :name parameters."""
        sql = sql.rstrip().rstrip(";")
        bare = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*|/\*.*?\*/", "''", sql, flags=re.S)
        if ";" in bare:
            raise ValueError("one statement only")
        words, before = {w.lower() for w in re.findall(r"\w+", bare)}, {}
        views = {v.name.lower() for v in self.spark.catalog.listTables() if v.isTemporary}
        try:  # a plan is bound when it is made: the session's own views come back at once
            for name in (*self._tables, *self._views):
                if name.lower() in words:
                    before[name] = self.spark.table(name) if name.lower() in views else None
                    self.frame(name).createOrReplaceTempView(name)
            return Query(self.spark.sql(sql, args=params or None), self)
        finally:
            for name, df in before.items():
                self.spark.catalog.dropTempView(name)
                if df is not None:
                    df.createOrReplaceTempView(name)

    def query_first(self, sql: str, **params: Any):
        return self.from_sql(sql, **params).first()

    def query_single(self, sql: str, **params: Any):
        return self.from_sql(sql, **params).single()

    def query_first_or_default(self, sql: str, default: Any = None, **params: Any):
        return self.from_sql(sql, **params).first_or_default(default=default)

    def query_single_or_default(self, sql: str, default: Any = None, **params: Any):
        return self.from_sql(sql, **params).single_or_default(default=default)

    def execute_scalar(self, sql: str, **params: Any) -> Any:
        row = self.from_sql(sql, **params).first_or_default()
        return None if row is None else row[0]

    def values(self, rows: list, ddl: str) -> Query:
        """Inline rows; none make an empty relation of the schema."""
        return Query(self.spark.createDataFrame(rows, ddl), self)

    def create_view(self, name: str, make: Callable[[], Query]) -> None:
        self._views[name] = make

    def drop_view(self, name: str) -> None:
        del self._views[name]

    def with_(self, query: Query, materialized: bool = False) -> Query:
        """A shared subquery; materialized: computed once, and kept."""
        if not materialized:
            return query
        self._kept.append(query.df.cache())
        return Query(self._kept[-1], self)

    def release(self) -> None:
        """Let go of materialized subqueries."""
        while self._kept:
            self._kept.pop().unpersist()

    def with_recursive(self, seed: Query, step: Callable[[Query], Query], distinct: bool = False, most: int = 1000) -> Query:
        run = recursive_union if distinct else recursive_union_all
        return Query(run(seed.df, lambda df: step(Query(df, self)).df, most), self)

    def table_info(self, name: str) -> Query:
        """Columns of a table: cid, name, type, not_null."""
        t = self._tables[name]
        rows = [(i, f.name, f.dataType.simpleString(), not f.nullable) for i, f in enumerate(t.schema)]
        return self.values(rows, "cid int, name string, type string, not_null boolean")

    def master(self) -> Query:
        """Tables and views: type, name."""
        return self.values([*[("table", n) for n in self._tables], *[("view", n) for n in self._views]], "type string, name string")


__all__ = ["Converter", "Database", "SchemaError", "SequenceError", "Table"]
