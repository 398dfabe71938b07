"""Scans, projections, filters, order, paging and row selectors."""

from pyspark.sql import functions as F

from plait.functions import misc, sem
from plait.functions import strings as S
from plait.queries import case


@case("flagship", """
SELECT n_name AS name, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_totalprice > 1000 GROUP BY n_name ORDER BY revenue DESC, name LIMIT 20""")
def flagship(db):
    q = db.table("orders").where(F.col("o_totalprice") > 1000)
    q = q.join(db.table("customer"), [("o_custkey", "c_custkey")]).join(db.table("nation"), [("c_nationkey", "n_nationkey")])
    got = q.group_by(name="n_name").select(orders=sem.count(), revenue=F.round(F.sum("o_totalprice"), 2))
    return got.order_by_descending("revenue").then_by("name").take(20)


@case("scan_table", "SELECT * FROM nation")
def scan_table(db):
    db.validate("nation")
    return db.read_only_table("nation")


@case("attached_scan", "SELECT a.r_name, count(*) AS n FROM region a JOIN nation ON r_regionkey = n_regionkey GROUP BY a.r_name")
def attached_scan(db):
    db.attach("other", db.path)
    other = db.table("other.region")
    return other.join(db.table("nation"), [("r_regionkey", "n_regionkey")]).group_by("r_name").select(n=sem.count())


@case("from_sql", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 100 GROUP BY c_mktsegment")
def from_sql(db):
    q = db.from_sql("SELECT * FROM customer WHERE c_acctbal > :least", least=100.0)
    return q.group_by("c_mktsegment").select(n=sem.count())


@case("scalar_sql", "SELECT max(o_totalprice) AS value FROM orders")
def scalar_sql(db):
    return db.from_sql("SELECT max(o_totalprice) AS value FROM orders")


@case("values_row", "SELECT 1 AS id, 'one' AS name")
def values_row(db):
    return db.values([(1, "one")], "id int, name string")


@case("values_range", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(id, name)")
def values_range(db):
    return db.values([(1, "a"), (2, "b"), (3, None)], "id int, name string")


@case("values_empty", "SELECT 1 AS id, 'a' AS name WHERE false")
def values_empty(db):
    return db.values([], "id int, name string")


@case("view_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def view_scan(db):
    db.create_view("finished", lambda: db.table("orders").where(F.col("o_orderstatus") == "F"))
    return db.table("finished").where("o_totalprice > 100000").select("o_orderkey", "o_totalprice")


@case("table_info", """SELECT 'r_regionkey' AS name, 'int' AS type, 0 AS cid UNION ALL SELECT 'r_name', 'string', 1""")
def table_info(db):
    return db.table_info("region").select("name", "type", "cid")


@case("computed_column", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_quantity < 3")
def computed_column(db):
    db._tables["lineitem"].computed["net"] = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)
    return db.table("lineitem").where("l_quantity < 3").select("l_orderkey", "l_linenumber", "net")


@case("query_filter", "SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY event_type")
def query_filter(db):
    db.add_filter("events", lambda t: t.event_type != "error")
    return db.table("events").group_by("event_type").select(n=sem.count())


@case("ignore_query_filters", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def ignore_query_filters(db):
    db.add_filter("events", lambda t: t.event_type != "error")
    return db.table("events", filters=False).group_by("event_type").select(n=sem.count())


@case("filter_lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-01' AND l_quantity > 45 AND l_returnflag = 'R'")
def filter_lineitem(db):
    q = db.table("lineitem").where(F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp_ntz"), "l_quantity > 45").where("l_returnflag = 'R'")
    return q.select("l_orderkey", "l_linenumber", "l_quantity")


@case("project_nested", "SELECT c_custkey, {'name': c_name, 'segment': c_mktsegment}.name AS name, upper(c_mktsegment) AS segment FROM customer")
def project_nested(db):
    q = db.table("customer").select("c_custkey", who=F.struct(F.col("c_name").alias("name"), S.to_upper(F.col("c_mktsegment")).alias("segment")))
    return q.select("c_custkey", name="who.name", segment="who.segment")


@case("chained_select", "SELECT (o_totalprice * 2) + 1 AS y FROM orders")
def chained_select(db):
    return db.table("orders").select(x=F.col("o_totalprice") * 2).select(y=F.col("x") + 1)


@case("client_select", "SELECT c_custkey, length(c_name) AS n FROM customer")
def client_select(db):
    q = db.table("customer").select("c_custkey", "c_name")
    return q.select_client(lambda x: x.assign(n=x["c_name"].str.len())[["c_custkey", "n"]], "c_custkey bigint, n bigint")


@case("where_builder", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'P') AND (o_totalprice > 200000 OR o_orderpriority = '1-URGENT')")
def where_builder(db):
    c = F.col
    either = sem.WhereBuilder().Or(c("o_orderstatus") == "F").Or(c("o_orderstatus") == "P")
    other = sem.WhereBuilder().Or(c("o_totalprice") > 200000).Or(c("o_orderpriority") == "1-URGENT")
    return db.table("orders").where(sem.WhereBuilder().And(either).And(other).build()).select("o_orderkey")


@case("case_when", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM orders")
def case_when(db):
    s = F.col("o_orderstatus")
    return db.table("orders").select("o_orderkey", code=F.when(s == "F", 1).when(s == "O", 2).otherwise(0))


@case("coalesce_nullif", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg FROM customer")
def coalesce_nullif(db):
    return db.table("customer").select("c_custkey", seg=F.coalesce(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), F.lit("none")))


_SEG = "nullif(c_mktsegment, 'BUILDING')"


@case("null_comparisons", f"""
SELECT c_custkey, {_SEG} IS NOT DISTINCT FROM nullif(c_mktsegment, 'MACHINERY') AS same, {_SEG} IS DISTINCT FROM 'MACHINERY' AS differs,
  {_SEG} IS NULL AS missing, NOT coalesce({_SEG} < 'G', false) AS not_less FROM customer""")
def null_comparisons(db):
    a = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    b = F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY"))
    return db.table("customer").select("c_custkey", same=sem.eq(a, b), differs=sem.ne(a, "MACHINERY"), missing=sem.eq(a, None), not_less=sem.negate(a < "G"))


@case("logic", "SELECT o_orderkey, (o_orderstatus = 'F') <> (o_totalprice > 100000) AS x, NOT (o_orderstatus = 'F' AND o_totalprice > 5) AS y FROM orders")
def logic(db):
    p, q = F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000
    return db.table("orders").select("o_orderkey", x=sem.xor(p, q), y=~(p & (F.col("o_totalprice") > 5)))


@case("in_list", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def in_list(db):
    return db.table("orders").where(sem.in_list(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"])).select("o_orderkey")


@case("in_list_null", f"SELECT c_custkey FROM customer WHERE {_SEG} = 'MACHINERY' OR {_SEG} IS NULL")
def in_list_null(db):
    a = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return db.table("customer").where(sem.in_list(a, ["MACHINERY", None])).select("c_custkey")


@case("in_empty", "SELECT o_orderkey FROM orders WHERE false")
def in_empty(db):
    return db.table("orders").where(sem.in_list(F.col("o_orderkey"), [])).select("o_orderkey")


@case("row_value_in", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linenumber) IN (('R', 1), ('A', 2))")
def row_value_in(db):
    q = db.table("lineitem").where_in_rows(["l_returnflag", "l_linenumber"], [("R", 1), ("A", 2)], "a string, b int")
    return q.select("l_orderkey", "l_linenumber")


@case("between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 15")
def between(db):
    return db.table("part").where(sem.between(F.col("p_size"), 10, 15)).select("p_partkey")


@case("distinct_from", f"SELECT c_custkey, {_SEG} IS DISTINCT FROM 'AUTOMOBILE' AS d FROM customer")
def distinct_from(db):
    return db.table("customer").select("c_custkey", d=sem.distinct_from(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), "AUTOMOBILE"))


@case("glob", "SELECT p_partkey FROM part WHERE p_type GLOB '*[AB]R*' ")
def glob(db):
    return db.table("part").where(S.glob("*[AB]R*", F.col("p_type"))).select("p_partkey")


@case("regexp", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '#[13][0-9]$')")
def regexp(db):
    return db.table("part").where(S.regexp(F.col("p_brand"), "#[13][0-9]$")).select("p_partkey")


@case("column_of", "SELECT s_name FROM supplier")
def column_of(db):
    return db.table("supplier").select(F.col("s_name"))


@case("storage_functions", """
SELECT p_partkey, 'integer' AS t1, 'real' AS t2, CASE WHEN nullif(p_size, 10) IS NULL THEN 'null' ELSE 'integer' END AS t3,
  '''' || replace(p_name, '''', '''''') || '''' AS q, hex(p_brand) AS h FROM part""")
def storage_functions(db):
    size = F.col("p_size")
    return db.table("part").select(
        "p_partkey", t1=misc.type_of(size), t2=misc.type_of(F.col("p_retailprice")), t3=misc.type_of(F.nullif(size, F.lit(10))),
        q=misc.quote(F.col("p_name")), h=misc.hex_(F.col("p_brand")),
    )


@case("blob_functions", "SELECT p_partkey, hex(p_brand) AS back, NULL AS bad, repeat('00', 3) AS zeros FROM part")
def blob_functions(db):
    return db.table("part").select(
        "p_partkey", back=F.hex(misc.unhex(misc.hex_(F.col("p_brand")))), bad=F.hex(misc.unhex("zz")), zeros=F.hex(misc.zeroblob(3))
    )


@case("random_values")
def random_values(db):
    return db.table("region").select("r_regionkey", a=misc.random(), b=misc.random_blob(8), c=misc.new_guid())


@case("scalar_min_max", """
SELECT o_orderkey, least(o_orderkey, o_custkey) AS a, greatest(o_orderkey, o_custkey, 100) AS b,
  CASE WHEN nullif(o_orderstatus, 'F') IS NOT NULL THEN greatest(o_orderstatus, 'M') END AS c FROM orders""")
def scalar_min_max(db):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.nullif(F.col("o_orderstatus"), F.lit("F"))
    return db.table("orders").select("o_orderkey", a=sem.scalar_min(k, c), b=sem.scalar_max(k, c, F.lit(100).cast("bigint")), c=sem.scalar_max(status, "M"))


@case("collate", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building' AND rtrim(c_name || '  ') = c_name")
def collate(db):
    c = F.col
    same = sem.collate_key(c("c_mktsegment"), "nocase") == sem.collate_key("Building", "nocase")
    return db.table("customer").where(same, sem.collate_key(F.concat("c_name", F.lit("  ")), "rtrim") == c("c_name")).select("c_custkey")


@case("order_nulls", f"SELECT c_custkey, {_SEG} AS seg FROM customer ORDER BY seg ASC NULLS LAST, c_custkey LIMIT 25")
def order_nulls(db):
    q = db.table("customer").select("c_custkey", seg=F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))
    return q.order_by("c_custkey").order_by("seg", nulls="last").then_by("c_custkey").take(25)


@case("order_descending", f"SELECT c_custkey, {_SEG} AS seg FROM customer ORDER BY seg DESC NULLS LAST, c_custkey DESC LIMIT 25")
def order_descending(db):
    q = db.table("customer").select("c_custkey", seg=F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))
    return q.order_by_descending("seg").then_by_descending("c_custkey").take(25)


@case("topk_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk_orders(db):
    return db.table("orders").select("o_orderkey", "o_totalprice").order_by_descending("o_totalprice").then_by("o_orderkey").take(50).take(10)


@case("skip_take", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
def skip_take(db):
    return db.table("orders").select("o_orderkey").order_by("o_orderkey").skip(20).skip(5).take(10)


@case("take_range", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 4 OFFSET 3")
def take_range(db):
    return db.table("orders").select("o_orderkey").order_by("o_orderkey").take_range(3, 7)


@case("reverse", "SELECT c_custkey FROM customer ORDER BY c_acctbal ASC, c_custkey DESC LIMIT 7")
def reverse(db):
    return db.table("customer").order_by_descending("c_acctbal").then_by("c_custkey").reverse().take(7).select("c_custkey")


@case("first_element", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def first_element(db):
    return db.table("orders").where("o_orderstatus = 'P'").order_by("o_orderdate", "o_orderkey").take(1).select("o_orderkey")


@case("element_at", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 7")
def element_at(db):
    return db.table("orders").select("o_orderkey").order_by("o_orderkey").skip(7).take(1)


@case("any_exists", "SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 100) AS result")
def any_exists(db):
    return db.table("orders").any_("o_totalprice > 100")


@case("all_not_exists", "SELECT NOT EXISTS (SELECT 1 FROM orders WHERE NOT coalesce(o_totalprice > 100, false)) AS result")
def all_not_exists(db):
    return db.table("orders").all_("o_totalprice > 100")


@case("contains_value", "SELECT EXISTS (SELECT 1 FROM nation WHERE n_name IS NULL) AS result")
def contains_value(db):
    return db.table("nation").contains("n_name", None)


@case("operators_after_take", """
SELECT o_orderstatus, count(*) AS n FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100) WHERE o_totalprice > 1000 GROUP BY o_orderstatus""")
def operators_after_take(db):
    return db.table("orders").order_by("o_orderkey").take(100).where("o_totalprice > 1000").group_by("o_orderstatus").select(n=sem.count())


@case("bit_operations", """
SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS b, xor(o_orderkey, 5) AS c, ~o_orderkey AS d, o_orderkey << 3 AS e, o_orderkey >> 2 AS f FROM orders""")
def bit_operations(db):
    from plait.functions import maths as M

    k = F.col("o_orderkey")
    lit = lambda n: F.lit(n).cast("bigint")
    return db.table("orders").select("o_orderkey", a=k.bitwiseAND(lit(12)), b=k.bitwiseOR(lit(3)), c=k.bitwiseXOR(lit(5)), d=F.bitwise_not(k), e=M.shift_left(k, 3), f=M.shift_right(k, 2))


@case("arithmetic", """
SELECT o_orderkey, CAST(trunc(o_orderkey / nullif(o_custkey % 4, 0)) AS BIGINT) AS d, o_orderkey % nullif(o_custkey % 4, 0) AS m, -o_orderkey % 7 AS neg,
  CAST(-(o_orderkey // 2) AS BIGINT) AS h, o_totalprice / nullif(o_custkey % 4, 0) AS r FROM orders""")
def arithmetic(db):
    k, z = F.col("o_orderkey"), F.col("o_custkey") % 4
    return db.table("orders").select("o_orderkey", d=sem.int_div(k, z), m=sem.mod(k, z), neg=sem.mod(-k, F.lit(7).cast("bigint")), h=sem.int_div(-k, 2), r=sem.div(F.col("o_totalprice"), z))


@case("casts", """
SELECT o_orderkey, CAST(((o_orderkey * 37 + 128) % 256) - 128 AS TINYINT) AS i8, CAST(o_orderkey * 5000 % 65536 AS BIGINT) AS u16,
  CAST(regexp_extract(o_orderpriority, '^[0-9]+') AS BIGINT) AS p, CAST(o_totalprice AS VARCHAR) IS NOT NULL AS t, 0 AS z FROM orders""")
def casts(db):
    k = F.col("o_orderkey")
    return db.table("orders").select(
        "o_orderkey", i8=sem.wrap_int(k * 37, 8), u16=sem.wrap_int(k * 5000, 16, signed=False).cast("bigint"), p=sem.parse_int(F.col("o_orderpriority")),
        t=F.col("o_totalprice").cast("string").isNotNull(), z=sem.parse_int(F.lit("abc")).cast("int"),
    )
