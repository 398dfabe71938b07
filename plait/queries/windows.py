"""Window functions, frames, filters and exclusions."""

from pyspark.sql import functions as F

from plait.operators import window as W
from plait.queries import case

c = F.col
_P = ("o_custkey",)
_K = ["o_orderdate", "o_orderkey"]
_OVER = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
_YEAR = "PARTITION BY o_custkey ORDER BY year(o_orderdate)"


def _orders(db):
    return db.frame("orders").withColumn("y", F.year("o_orderdate"))


def _run(db, cols):
    return W.apply(_orders(db), cols).select("o_orderkey", *cols)


def _at(sql, over):
    """sql over a window; a sum is an integer of 64 bits."""
    out = f"{sql} OVER ({over})"
    return f"CAST({out} AS BIGINT)" if sql.startswith("sum(") else out


def _simple(name, fn, sql, order=True):
    over = _OVER if order else "PARTITION BY o_custkey"

    @case(name, f"SELECT o_orderkey, {_at(sql, over)} AS v FROM orders")
    def run(db):
        return _run(db, {"v": (fn(), W.over(*_P, order=_K if order else []))})


_simple("window_sum", lambda: W.sum_("o_custkey"), "sum(o_custkey::BIGINT)")
_simple("window_avg", lambda: W.avg("o_orderkey"), "avg(o_orderkey)", order=False)
_simple("window_min", lambda: W.min_("o_totalprice"), "min(o_totalprice)")
_simple("window_max", lambda: W.max_("o_totalprice"), "max(o_totalprice)")
_simple("window_count", lambda: W.count(), "count(*)")
_simple("window_count_value", lambda: W.count(F.nullif(c("o_orderstatus"), F.lit("F"))), "count(nullif(o_orderstatus, 'F'))")
_simple("window_row_number", W.row_number, "row_number()")
_simple("window_percent_rank", W.percent_rank, "percent_rank()")
_simple("window_cume_dist", W.cume_dist, "cume_dist()")
_simple("window_ntile", lambda: W.ntile(4), "ntile(4)")
_simple("window_lag", lambda: W.lag("o_totalprice", 2, 0.0), "lag(o_totalprice, 2, 0.0)")
_simple("window_lead", lambda: W.lead("o_orderkey"), "lead(o_orderkey)")
_simple("window_first_value", lambda: W.first_value("o_orderkey"), "first_value(o_orderkey)")
_simple("window_last_value", lambda: W.last_value("o_orderkey"), "last_value(o_orderkey)")
_simple("window_nth_value", lambda: W.nth_value("o_orderkey", 3), "nth_value(o_orderkey, 3)")


@case("window_rank", f"SELECT o_orderkey, rank() OVER ({_YEAR}) AS r, dense_rank() OVER ({_YEAR}) AS d FROM orders")
def window_rank(db):
    w = W.over("o_custkey", order=["y"])
    return _run(db, {"r": (W.rank(), w), "d": (W.dense_rank(), w)})


@case("window_lag_column", f"SELECT o_orderkey, lag(o_orderkey, CAST(o_custkey % 3 AS INT), -1) OVER ({_OVER}) AS v FROM orders")
def window_lag_column(db):
    return _run(db, {"v": (W.lag("o_orderkey", (c("o_custkey") % 3).cast("int"), -1), W.over(*_P, order=_K))})


@case("window_filter", f"""
SELECT o_orderkey, count(*) FILTER (o_orderstatus = 'F') OVER ({_OVER}) AS n, max(o_totalprice) FILTER (o_orderstatus = 'O') OVER ({_OVER}) AS m FROM orders""")
def window_filter(db):
    w = W.over(*_P, order=_K)
    return _run(db, {"n": (W.count().filter(c("o_orderstatus") == "F"), w), "m": (W.max_("o_totalprice").filter(c("o_orderstatus") == "O"), w)})


def _framed(name, fn, sql, frame, frame_sql, order=None, over=_OVER):
    @case(name, f"SELECT o_orderkey, {_at(sql, f'{over} {frame_sql}')} AS v FROM orders")
    def run(db):
        return _run(db, {"v": (fn(), W.over(*_P, order=order or _K, frame=frame))})


_framed("frame_rows", lambda: W.max_("o_totalprice"), "max(o_totalprice)", W.rows(-2, 1), "ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING")
_framed("frame_rows_tail", lambda: W.last_value("o_orderkey"), "last_value(o_orderkey)", W.rows(0, W.END), "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING")
_framed("frame_range", lambda: W.count(), "count(*)", W.range_(-1, 1), "RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING", ["y"], _YEAR)
_framed("frame_groups", lambda: W.count(), "count(*)", W.groups(-1, 0), "GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW", ["y"], _YEAR)
_framed("frame_groups_ahead", lambda: W.min_("o_totalprice"), "min(o_totalprice)", W.groups(1, 2), "GROUPS BETWEEN 1 FOLLOWING AND 2 FOLLOWING", ["y"], _YEAR)
_framed("exclude_current", lambda: W.max_("o_totalprice"), "max(o_totalprice)", W.rows(-2, 2, "current_row"), "ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW")
_ALL = "RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE"
_framed("exclude_group", lambda: W.count(), "count(*)", W.range_(W.START, W.END, "group"), f"{_ALL} GROUP", ["y"], _YEAR)
_framed("exclude_ties", lambda: W.count(), "count(*)", W.range_(W.START, W.END, "ties"), f"{_ALL} TIES", ["y"], _YEAR)
_framed("exclude_current_sum", lambda: W.sum_("o_orderkey"), "sum(o_orderkey::BIGINT)", W.rows(W.START, W.END, "current_row"), "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW")
_framed("exclude_groups_frame", lambda: W.max_("o_totalprice"), "max(o_totalprice)", W.groups(-1, 1, "group"), "GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP", ["y"], _YEAR)


@case("window_then_filter", f"SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER ({_OVER}) AS r FROM orders) WHERE r <= 2")
def window_then_filter(db):
    return W.apply(_orders(db), {"r": (W.row_number(), W.over(*_P, order=_K))}).filter("r <= 2").select("o_orderkey", "o_custkey")


@case("window_descending", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders")
def window_descending(db):
    return _run(db, {"r": (W.row_number(), W.over("o_custkey", "o_orderstatus", order=[("o_totalprice", True), "o_orderkey"]))})
