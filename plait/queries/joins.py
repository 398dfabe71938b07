"""Joins and subqueries."""

from pyspark.sql import functions as F

from plait.functions import sem
from plait.queries import case

c = F.col


@case("inner_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 150000")
def inner_join(db):
    return db.table("orders").where("o_totalprice > 150000").join(db.table("customer"), [("o_custkey", "c_custkey")]).select("o_orderkey", "c_name")



@case("composite_key_nullsafe", """
SELECT a.c_custkey AS x, b.c_custkey AS y FROM customer a JOIN customer b
ON nullif(a.c_mktsegment, 'BUILDING') IS NOT DISTINCT FROM nullif(b.c_mktsegment, 'BUILDING') AND a.c_nationkey = b.c_nationkey""")
def composite_key_nullsafe(db):
    a = db.table("customer").select(x="c_custkey", seg=F.nullif(c("c_mktsegment"), F.lit("BUILDING")), nk="c_nationkey")
    b = a.select(y="x", seg2="seg", nk2="nk")
    return a.join(b, [("seg", "seg2"), ("nk", "nk2")], nullable=("seg",), many=True).select("x", "y")


@case("left_join_marker", """
SELECT c_custkey, o_orderkey, o_orderkey IS NOT NULL AS matched FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 250000""")
def left_join_marker(db):
    big = db.table("orders").where("o_totalprice > 250000").select("o_orderkey", "o_custkey")
    return db.table("customer").left_join(big, [("c_custkey", "o_custkey")], marker="matched").select("c_custkey", "o_orderkey", "matched")


@case("right_join", "SELECT o_orderkey, c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 200000) RIGHT JOIN customer ON o_custkey = c_custkey")
def right_join(db):
    return db.table("orders").where("o_totalprice > 200000").right_join(db.table("customer"), [("o_custkey", "c_custkey")]).select("o_orderkey", "c_custkey")


@case("full_join", """
SELECT a.c_custkey AS x, b.s_suppkey AS y FROM customer a
FULL JOIN (SELECT s_suppkey + 20 AS s_suppkey FROM supplier) b ON a.c_custkey = b.s_suppkey""")
def full_join(db):
    a, b = db.table("customer"), db.table("supplier").select(s_suppkey=c("s_suppkey") + 20)
    return a.full_join(b, [("c_custkey", "s_suppkey")]).select(x="c_custkey", y="s_suppkey")


@case("group_join_inner", "SELECT n_name, s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def group_join_inner(db):
    return db.table("nation").group_join(db.table("supplier"), [("n_nationkey", "s_nationkey")], keep_empty=False).select("n_name", "s_name")


@case("group_join_left", "SELECT n_name, s_name FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey")
def group_join_left(db):
    return db.table("nation").group_join(db.table("supplier"), [("n_nationkey", "s_nationkey")]).select("n_name", "s_name")


@case("group_join_filtered", "SELECT n_name, s_name FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000")
def group_join_filtered(db):
    return db.table("nation").group_join(db.table("supplier"), [("n_nationkey", "s_nationkey")], where="s_acctbal > 5000").select("n_name", "s_name")


@case("cross_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def cross_theta(db):
    a = db.table("nation").select(x="n_nationkey", rx="n_regionkey")
    b = db.table("nation").select(y="n_nationkey", ry="n_regionkey")
    return a.cross_join(b, lambda p, q: (p.rx == q.ry) & (p.x < q.y)).select("x", "y")


@case("cross_join", "SELECT r_name, n_name FROM region, nation")
def cross_join(db):
    return db.table("region").cross_join(db.table("nation")).select("r_name", "n_name")


@case("join_sources", """
WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT c_custkey, n, label FROM customer JOIN big ON c_custkey = o_custkey JOIN (VALUES (10, 'ten'), (11, 'eleven')) v(k, label) ON n = k""")
def join_sources(db):
    big = db.with_(db.table("orders").group_by("o_custkey").select(n=sem.count()))
    labels = db.values([(10, "ten"), (11, "eleven")], "k bigint, label string")
    return db.table("customer").join(big, [("c_custkey", "o_custkey")]).join(labels, [("n", "k")]).select("c_custkey", "n", "label")


@case("self_join", "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey < b.s_suppkey")
def self_join(db):
    a = db.table("supplier").select(x="s_suppkey", k="s_nationkey")
    b = db.table("supplier").select(y="s_suppkey", j="s_nationkey")
    return a.join(b, [("k", "j")]).where("x < y").select("x", "y")


@case("self_join_same", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def self_join_same(db):
    q = db.table("nation")
    return q.join(q, lambda a, b: (a["n_regionkey"] == b["n_regionkey"]) & (a["n_nationkey"] < b["n_nationkey"])).select(x="n_name", y="n_name_2")


@case("semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_exists(db):
    big = db.table("orders").where("o_totalprice > 200000")
    return db.table("customer").exists(big, [("c_custkey", "o_custkey")]).select("c_custkey")


@case("anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def anti_not_exists(db):
    big = db.table("orders").where("o_totalprice > 200000")
    return db.table("customer").not_exists(big, [("c_custkey", "o_custkey")]).select("c_custkey")


@case("where_all", """
SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT coalesce(o_totalprice > 20000, false))""")
def where_all(db):
    return db.table("customer").where_all(db.table("orders"), lambda a, b: a.c_custkey == b.o_custkey, lambda a, b: b.o_totalprice > 20000).select("c_custkey")


@case("in_subquery", """
SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM (SELECT nullif(s_nationkey, 3) AS k FROM supplier) WHERE k IS NOT DISTINCT FROM nullif(c_nationkey, 3))""")
def in_subquery(db):
    three = F.lit(3)
    keys = db.table("supplier").select(k=F.nullif(c("s_nationkey"), three)).distinct()
    return db.table("customer").with_column("nk", F.nullif(c("c_nationkey"), three)).where_in("nk", keys, "k").select("c_custkey")


@case("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
def scalar_subquery(db):
    mean = db.table("orders").agg(m=F.avg("o_totalprice") * 1.5)
    return db.table("orders").cross_join(mean).where("o_totalprice > m").select("o_orderkey")


@case("correlated_count", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
def correlated_count(db):
    return db.table("customer").scalar(db.table("orders"), [("c_custkey", "o_custkey")], default=0, n=sem.count()).select("c_custkey", "n")


@case("correlated_first", """
SELECT c_custkey, coalesce((SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate, o_orderkey LIMIT 1), 0) AS k FROM customer""")
def correlated_first(db):
    order = F.struct("o_orderdate", "o_orderkey")
    return db.table("customer").scalar_first(db.table("orders"), [("c_custkey", "o_custkey")], "o_orderkey", order, "k", default=0).select("c_custkey", "k")


@case("entity_subquery_null", "SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal > 9000)")
def entity_subquery_null(db):
    return db.table("supplier").not_exists(db.table("customer").where("c_acctbal > 9000"), [("s_nationkey", "c_nationkey")]).select("s_suppkey")


@case("dto_join_benchmark", """
SELECT o_orderkey, c_name, o_totalprice, (SELECT count(*) FROM orders x WHERE x.o_custkey = c_custkey) AS orders_of
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000""")
def dto_join_benchmark(db):
    q = db.table("orders").where("o_totalprice > 200000").join(db.table("customer"), [("o_custkey", "c_custkey")])
    q = q.scalar(db.table("orders"), [("c_custkey", "o_custkey")], default=0, orders_of=sem.count())
    return q.select("o_orderkey", "c_name", "o_totalprice", "orders_of").order_by_descending("o_totalprice").then_by("o_orderkey").take(1000)
