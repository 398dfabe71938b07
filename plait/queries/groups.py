"""Grouping and aggregation."""

from pyspark.sql import functions as F

from plait.functions import sem
from plait.queries import case

c = F.col


@case("group_multi", """
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty, min(l_shipdate) AS lo, max(l_shipdate) AS hi, round(avg(l_quantity), 6) AS mean
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def group_multi(db):
    return db.table("lineitem").group_by("l_returnflag", "l_linestatus").select(
        n=sem.count(), qty=sem.sum0(c("l_quantity")).cast("bigint"), lo=F.min("l_shipdate"), hi=F.max("l_shipdate"), mean=F.round(F.avg("l_quantity"), 6)
    )


@case("group_expression", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1")
def group_expression(db):
    return db.table("orders").group_by(y=F.year("o_orderdate")).select(n=sem.count())


@case("count_pred", "SELECT o_custkey, count(*) FILTER (o_totalprice > 100000) AS n FROM orders GROUP BY o_custkey")
def count_pred(db):
    return db.table("orders").group_by("o_custkey").select(n=sem.count(c("o_totalprice") > 100000))


@case("agg_filter", """
SELECT o_orderpriority, max(o_totalprice) FILTER (o_orderstatus = 'F') AS m, coalesce(count(o_custkey) FILTER (o_orderstatus = 'P'), 0) AS n FROM orders GROUP BY o_orderpriority""")
def agg_filter(db):
    return db.table("orders").group_by("o_orderpriority").select(
        m=sem.filtered(F.max, c("o_totalprice"), c("o_orderstatus") == "F"), n=sem.filtered(F.count, c("o_custkey"), c("o_orderstatus") == "P")
    )


@case("any_all_group", """
SELECT o_custkey, coalesce(bool_or(o_totalprice > 200000), false) AS some, coalesce(bool_and(o_totalprice > 5000), true) AS every,
  bool_or(o_orderstatus = 'P') AS has_p FROM orders GROUP BY o_custkey""")
def any_all_group(db):
    return db.table("orders").group_by("o_custkey").select(
        some=sem.any_(c("o_totalprice") > 200000), every=sem.all_(c("o_totalprice") > 5000), has_p=sem.contains_value(c("o_orderstatus"), "P")
    )


@case("string_join_group", """
SELECT n_regionkey, string_agg(coalesce(nullif(n_name, 'FRANCE'), ''), '; ' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey""")
def string_join_group(db):
    return db.table("nation").group_by("n_regionkey").select(names=sem.string_join(F.nullif(c("n_name"), F.lit("FRANCE")), "; ", c("n_nationkey")))


@case("string_join_ordered", "SELECT string_agg(n_name, ',' ORDER BY n_name) AS result FROM nation")
def string_join_ordered(db):
    return db.table("nation").order_by("n_name").string_join("n_name", ",")


@case("string_join_keys", "SELECT string_agg(n_name, ',' ORDER BY n_regionkey DESC, n_name) AS result FROM nation")
def string_join_keys(db):
    return db.table("nation").order_by_descending("n_regionkey").then_by("n_name").string_join("n_name", ",")


@case("group_first", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def group_first(db):
    return db.table("orders").group_by("o_custkey").first(c("o_totalprice").desc(), c("o_orderkey")).select("o_custkey", "o_orderkey")


@case("total_group", "SELECT o_custkey, coalesce(sum(CAST(o_orderkey AS DOUBLE)), 0.0) AS t FROM orders GROUP BY o_custkey")
def total_group(db):
    return db.table("orders").group_by("o_custkey").select(t=sem.total(c("o_orderkey")))


@case("total_empty", "SELECT CAST(0.0 AS DOUBLE) AS total, CAST(0 AS BIGINT) AS sum, CAST(NULL AS DOUBLE) AS mean, CAST(0 AS BIGINT) AS n")
def total_empty(db):
    q = db.table("orders").where(F.lit(False))
    return q.agg(total=sem.total(c("o_totalprice")), sum=sem.sum0(c("o_orderkey")), mean=F.avg("o_totalprice"), n=sem.count())


@case("terminals", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi, avg(o_orderkey) AS mean FROM orders WHERE o_orderstatus = 'O'")
def terminals(db):
    q = db.table("orders").where("o_orderstatus = 'O'")
    return q.agg(n=sem.count(), s=sem.sum0(c("o_orderkey")), lo=F.min("o_totalprice"), hi=F.max("o_totalprice"), mean=F.avg("o_orderkey"))


@case("distinct_count_null", """
SELECT count(DISTINCT s) + max(CASE WHEN s IS NULL THEN 1 ELSE 0 END) AS result FROM (SELECT nullif(c_mktsegment, 'BUILDING') AS s FROM customer)""")
def distinct_count_null(db):
    return db.table("customer").select(s=F.nullif(c("c_mktsegment"), F.lit("BUILDING"))).agg(result=sem.count_distinct(c("s")))


@case("distinct_sum_avg", "SELECT CAST(sum(DISTINCT p_size) AS BIGINT) AS s, avg(DISTINCT p_size) AS a FROM part")
def distinct_sum_avg(db):
    return db.table("part").select("p_size").distinct().agg(s=F.sum("p_size"), a=F.avg("p_size"))


@case("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def having(db):
    return db.table("orders").group_by("o_custkey").having(lambda t: t.n > 12, n=sem.count())


@case("count_of_groups", "SELECT count(*) AS result FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)")
def count_of_groups(db):
    return db.table("orders").group_by("o_custkey", "o_orderstatus").count_groups()


@case("agg_of_agg", "SELECT max(n) AS most, min(n) AS least, avg(n) AS mean, CAST(sum(n) AS BIGINT) AS total FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def agg_of_agg(db):
    q = db.table("orders").group_by("o_custkey").select(n=sem.count())
    return q.agg(most=F.max("n"), least=F.min("n"), mean=F.avg("n"), total=sem.sum0(c("n")))


@case("collect_groups", """
SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, count(*) AS n FROM nation GROUP BY n_regionkey""")
def collect_groups(db):
    q = db.table("nation").group_by("n_regionkey").rows()
    return q.select("n_regionkey", names=F.array_join(F.sort_array(c("rows.n_name")), ","), n=F.size("rows").cast("bigint"))


@case("order_by_aggregate", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 15")
def order_by_aggregate(db):
    return db.table("orders").group_by("o_custkey").select(n=sem.count()).order_by_descending("n").then_by("o_custkey").take(15)


@case("modulo_aggregate", "SELECT l_orderkey % 10 AS k, count(*) AS n, CAST(sum(l_partkey % 7) AS BIGINT) AS s FROM lineitem GROUP BY 1")
def modulo_aggregate(db):
    q = db.table("lineitem").group_by(k=c("l_orderkey") % 10)
    return q.select(n=sem.count(), s=sem.sum0(sem.mod(c("l_partkey"), F.lit(7).cast("bigint"))))
