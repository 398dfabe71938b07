"""Set operations and common table expressions."""

from pyspark.sql import functions as F

from plait.functions import sem
from plait.queries import case

c = F.col
_A, _B = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000"


def _sides(db):
    return db.table("customer").where("c_acctbal > 9000").select(k="c_nationkey"), db.table("supplier").where("s_acctbal > 5000").select(k="s_nationkey")


@case("union_all", f"{_A} UNION ALL {_B}")
def union_all(db):
    a, b = _sides(db)
    return a.concat(b)


@case("union", f"{_A} UNION {_B}")
def union(db):
    a, b = _sides(db)
    return a.union(b)


@case("intersect", f"{_A} INTERSECT {_B}")
def intersect(db):
    a, b = _sides(db)
    return a.intersect(b)


@case("except", f"{_A} EXCEPT {_B}")
def except_(db):
    a, b = _sides(db)
    return a.except_(b)


@case("set_nested", f"SELECT k FROM nation JOIN ({_A} EXCEPT ({_B} UNION SELECT 3)) ON k = n_nationkey")
def set_nested(db):
    a, b = _sides(db)
    both = a.except_(b.union(db.values([(3,)], "k int")))
    return db.table("nation").join(both, [("n_nationkey", "k")]).select("k")


@case("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(db):
    return db.table("orders").select("o_orderstatus", "o_orderpriority").distinct()


@case("cte_shared", """
WITH x AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT a.o_custkey AS p, b.o_custkey AS q FROM x a JOIN x b ON a.n = b.n AND a.o_custkey < b.o_custkey WHERE a.n > 15""")
def cte_shared(db):
    x = db.with_(db.table("orders").group_by("o_custkey").select(n=sem.count()))
    a, b = x.select(p="o_custkey", n="n").where("n > 15"), x.select(q="o_custkey", m="n")
    return a.cross_join(b, lambda s, t: (s.n == t.m) & (s.p < t.q)).select("p", "q")


@case("cte_materialized", "WITH x AS MATERIALIZED (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1) SELECT x.k, x.n, y.n AS m FROM x JOIN x y ON x.k = y.k")
def cte_materialized(db):
    x = db.with_(db.table("nation").group_by(k="n_regionkey").select(n=sem.count()), materialized=True)
    return x.join(x.select(j="k", m="n"), [("k", "j")]).select("k", "n", "m")


@case("recursive_count", "WITH RECURSIVE t(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM t WHERE x < 12) SELECT x FROM t")
def recursive_count(db):
    return db.with_recursive(db.values([(1,)], "x int"), lambda t: t.where("x < 12").select(x=c("x") + 1))


@case("recursive_union_closure", """
WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation),
t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a, b FROM t""")
def recursive_union_closure(db):
    e = db.table("nation").select(a="n_nationkey", b=(c("n_nationkey") * 3 + 1) % 25)
    edge = e.select(p="a", q="b")
    return db.with_recursive(e, lambda t: t.join(edge, [("b", "p")]).select(a="a", b="q"), distinct=True)
