"""The engine's semantics on a few literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plait.functions import arrays as A
from plait.functions import dates as D
from plait.functions import jsons as J
from plait.functions import maths as M
from plait.functions import misc, sem
from plait.functions import strings as S
from plait.operators import mutate as U
from plait.operators import window as W
from plait.operators.fulltext import Index, Tokenizer, parse, porter
from plait.plans.query import SequenceError
from plait.queries import oracle_sql, queries
from plait.sources.catalog import Database, SchemaError

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db"))
    spark.createDataFrame([(1, "abc", 2.5, None), (2, "ABC", -2.5, 4), (3, None, 0.0, 0), (4, "é%_", 7.0, 4)], "id int, s string, x double, n int").write.parquet(f"{path}/t.parquet")
    return Database(spark, path, {"t": "id int, s string, x double, n int"})


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first().asDict()


def test_null_rules(db):
    t = db.table("t")
    n = F.col("n")
    assert [r.id for r in t.where(sem.eq(n, None)).to_list()] == [1]
    assert sorted(r.id for r in t.where(sem.ne(n, 4)).to_list()) == [1, 3]
    assert sorted(r.id for r in t.where(sem.negate(n > 2)).to_list()) == [1, 3]
    assert t.where(sem.in_list(n, [])).count() == 0
    assert sorted(r.id for r in t.where(sem.in_list(n, [0, None])).to_list()) == [1, 3]
    assert t.all_(n >= 0).first().result is False and t.where("n is not null").all_(n >= 0).first().result is True
    assert t.where(F.lit(False)).all_(n > 99).first().result is True


def test_numbers(spark):
    got = one(
        spark, a=sem.int_div(-7, 2), b=sem.int_div(7, 0), c=sem.mod(-7, 3), d=sem.div(1, 0), e=M.round_(2.5), f=M.round_(2.5, mode="away_from_zero"), g=M.sqrt(-1.0),
        h=sem.wrap_int(F.lit(300), 8), i=sem.wrap_int(F.lit(-1), 16, signed=False), j=sem.parse_int(F.lit("12abc")), k=sem.parse_real(F.lit(" 1.5e2x")), l=M.truncate(-1.5), m=M.clamp(9, 1, 5),
        o=sem.scalar_max(1, None), p=S.real_text(F.lit(2.0)), q=S.real_text(F.lit(0.1)),
    )
    assert [got[k] for k in "abcdef"] == [-3, None, -1, None, 2.0, 3.0]
    assert got["g"] is None and got["h"] == 44 and got["i"] == 65535 and got["j"] == 12 and got["k"] == 150.0
    assert (got["l"], got["m"], got["o"], got["p"], got["q"]) == (-1.0, 5, None, "2", "0.1")
    with pytest.raises(ValueError):
        M.round_(1.0, mode="up")


def test_aggregates_of_nothing(db):
    q = db.table("t").where(F.lit(False))
    assert q.sum("n") == 0 and q.total("x") == 0.0 and q.count() == 0
    assert q.average("x", nullable=True) is None
    with pytest.raises(SequenceError):
        q.max("x")


def test_strings(spark):
    s = F.lit("héLLo wörld")
    got = one(
        spark, a=S.contains(s, "LLO W"), b=S.contains(s, "LLO W", ignore_case=False), c=S.to_upper(s), d=S.index_of(s, "o", 5), e=S.last_index_of(s, "l"), f=S.last_index_of(s, ""), g=S.insert(s, 0, "x"),
        h=S.remove(s, 2, -1), i=S.trim(F.lit(" \t x 　")), j=S.pad_left("abc", 2), k=S.compare(F.lit(None).cast("string"), "a"), l=S.substring(s, -2, 2), m=S.glob("h?LL*", s), n=S.glob("[a-g]*", s),
        o=S.contains("50% off", "0%"), p=S.char_of(128512), q=S.length(F.lit("a😀")), r=S.printf("%g|%d%%", F.lit(0.5), F.lit(3)),
    )
    assert got["a"] and not got["b"] and got["c"] == "HéLLO WöRLD" and got["d"] == -1 and got["e"] == 9 and got["f"] == 11
    assert got["g"].startswith("xh") and got["h"] == "héLLo wörld" and got["i"] == "x" and got["j"] == "abc" and got["k"] == -1 and got["l"] == "hé"
    assert got["m"] and not got["n"] and got["o"] and got["p"] == "😀" and got["q"] == 2 and got["r"] == "0.5|3%"


def test_dates(spark):
    ts = F.lit("2024-01-31 23:59:59.999999").cast("timestamp_ntz")
    got = one(
        spark, a=D.add(ts, "months", 1), b=D.day_of_week(ts), c=D.microsecond(ts), d=D.millisecond(ts), e=D.ticks(ts), f=D.date_text(ts, "start of month", "+1 month", "-1 day"), g=D.date_text(ts, "+1 month"),
        h=D.strftime("%j|%w|%I %p", ts), i=D.time_diff(F.lit("2024-03-01 00:00:00"), F.lit("2024-01-31 12:00:00")), j=D.add_time(F.lit(86_399_999_999), D.span("seconds", 1)), k=D.span_part(F.lit(-90_000_000), "minutes"),
    )
    assert got["a"] == dt.datetime(2024, 2, 29, 23, 59, 59, 999999) and got["b"] == 3 and (got["c"], got["d"]) == (999, 999)
    assert got["e"] == 638423423999999990 and got["f"] == "2024-01-31" and got["g"] == "2024-03-02"
    assert got["h"] == "031|3|11 PM" and got["i"] == "+0000-00-29 12:00:00.000" and got["j"] == 999_999 and got["k"] == -1


def test_json_and_arrays(spark):
    doc = F.lit('{"a":[1,2,{"b":null}],"c":"x"}')
    got = one(
        spark, a=J.set_(doc, "$.a[0]", 9), b=J.insert(doc, "$.c", 1), c=J.replace(doc, "$.z", 1), d=J.remove(doc, "$.a[#-1]"), e=J.patch(doc, {"c": None, "d": {"e": 1}}), f=J.type_of(doc, "$.a"), g=J.valid(F.lit("{")),
        h=A.find_last_index(F.array(F.lit(1), F.lit(2), F.lit(1)), lambda x: x == 1), i=A.contains(F.array(F.lit(1), F.lit(None)), F.lit(None).cast("int")), j=A.single(F.array(F.lit(1), F.lit(2))),
        k=A.order_by(F.array(F.lit(3), F.lit(None), F.lit(1)), lambda x: x),
    )
    assert got["a"] == '{"a":[9,2,{"b":null}],"c":"x"}' and got["b"] == got["c"] == '{"a":[1,2,{"b":null}],"c":"x"}'
    assert got["d"] == '{"a":[1,2],"c":"x"}' and got["e"] == '{"a":[1,2,{"b":null}],"d":{"e":1}}' and got["f"] == "array" and got["g"] is False
    assert got["h"] == 2 and got["i"] and got["j"] is None and got["k"] == [None, 1, 3]


def test_terminals(db):
    t = db.table("t").order_by("id")
    assert t.first().id == 1 and t.element_at(2).id == 3 and t.element_at_or_default(-1) is None
    assert t.single("id = 2").id == 2 and t.first_or_default("id > 9", "none") == "none"
    with pytest.raises(SequenceError):
        t.single()
    with pytest.raises(SequenceError):
        t.first("id > 9")
    assert [r.id for r in t.reverse().to_list()] == [4, 3, 2, 1]
    assert [r.id for r in t.order_by_descending("n").then_by("id").to_list()] == [2, 4, 3, 1]


def test_catalog(db, spark):
    db.validate("t")
    db.register("bad", "id string, s string", f"{db.path}/t.parquet")
    with pytest.raises(SchemaError):
        db.validate("bad")
    with pytest.raises(ValueError):
        db.from_sql("select 1; select 2")
    db._tables["t"].checks.append(F.col("x") >= 0)
    assert db.verify("t") == 1
    assert db.execute_scalar("SELECT count(*) FROM t WHERE id > :k", k=2) == 2


def test_window_exclusions(spark):
    df = spark.createDataFrame([(1, 1, 10), (2, 1, 20), (3, 2, None), (4, 3, 5)], "id int, g int, v int")
    for frame, want in (("current_row", [25, 15, 35, 30]), ("group", [5, 5, 35, 30]), ("ties", [15, 25, 35, 35])):
        got = W.apply(df, {"s": (W.sum_("v"), W.over(order=["g"], frame=W.range_(W.START, W.END, frame)))}).orderBy("id").collect()
        assert [r.s for r in got] == want, frame
    with pytest.raises(ValueError):
        W.row_number().filter(F.lit(True))


def test_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(U.add_or_update(old, new, ["k"])) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(U.add_or_update(old, new, ["k"], "ignore")) == [(1, "a"), (2, "b"), (3, "C")]
    with pytest.raises(ValueError):
        U.add_or_update(old, new, ["k"], "abort")
    assert rows(U.upsert(old, new, ["k"], "nothing", returning=True)) == [(3, "C")]
    assert rows(U.delete(old, F.col("v") == F.lit(None))) == rows(old)
    with pytest.raises(ValueError):
        U.insert_from(old, new.withColumn("z", F.lit(1)))


def test_recursion(db):
    edges = db.values([(1, 2), (2, 3), (3, 1), (4, 4)], "a int, b int")
    step = edges.select(p="a", q="b")
    got = db.with_recursive(edges, lambda t: t.join(step, [("b", "p")]).select(a="a", b="q"), distinct=True)
    assert len(got.to_list()) == 10
    with pytest.raises(RecursionError):
        db.with_recursive(db.values([(1,)], "x int"), lambda t: t.select(x=F.col("x") + 1), most=3)


def test_full_text(spark):
    df = spark.createDataFrame([(1, "Café crème, the best"), (2, "the best of the rest"), (3, None)], "id int, t string")
    hits = lambda q, **k: sorted(r.id for r in Index(df, ["t"], **k).match(q).collect())
    assert hits("cafe") == [1] and hits('"the best" NOT rest') == [1] and hits("NEAR(best rest, 2)") == [2] and hits("re* AND best") == [2]
    assert hits("cafe", tokenizer=Tokenizer("ascii")) == [] and hits("bests", tokenizer=Tokenizer("porter")) == [1, 2]
    ranked = Index(df, ["t"]).ranked("best OR rest").collect()
    assert len(ranked) == 2 and all(r["rank"] <= 0 for r in ranked)
    assert Index(df, ["t"]).highlight('"the best"', "t", "[", "]").first().highlight == "Café crème, [the best]"
    assert [porter(x) for x in ("caresses", "relational", "hopping")] == ["caress", "relat", "hop"]
    for bad in ("(a", '"open', "a )"):
        with pytest.raises(ValueError):
            parse(bad)


def test_plans(spark):
    """Filters and columns reach the files, and equi-joins are no products."""
    d = Database(spark, "/root/testdata/sf0.001")
    plan = queries()["filter_lineitem"](spark, d.path)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "l_extendedprice" not in plan
    for name in ("inner_join", "semi_exists", "cross_theta", "bbox_overlap"):
        assert "CartesianProduct" not in queries()[name](spark, d.path)._jdf.queryExecution().toString()


def test_every_query_has_a_name_and_most_have_sql():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) - len(oracle_sql()) <= 6
    assert misc.Functions().__class__.__name__ == "Functions"


def test_sums_of_excluded_frames_keep_their_type(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(i, big + i) for i in range(5)], "i int, v bigint")
    got = W.apply(df, {"s": (W.sum_("v"), W.over(order=["i"], frame=W.rows(-2, 2, "current_row")))})
    assert got.schema["s"].dataType.simpleString() == "bigint"
    values = {r.i: r.v for r in got.collect()}
    assert {r.i: r.s for r in got.collect()} == {i: sum(values[j] for j in range(max(0, i - 2), min(5, i + 3)) if j != i) for i in range(5)}


def test_sql_literals_and_session_views(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "r_regionkey int").createOrReplaceTempView("nation")
    db = Database(spark, SF)
    assert db.execute_scalar("SELECT ';' AS x -- a; b") == ";"
    assert db.query_first_or_default("SELECT * FROM region WHERE r_regionkey < 0") is None
    assert db.from_sql("SELECT count(*) AS n FROM nation").first().n == 25
    assert spark.table("nation").count() == 2  # the session's own view is back
    spark.catalog.dropTempView("nation")
    with pytest.raises(ValueError):
        db.from_sql("SELECT 1; SELECT 2")


def test_saved_tables(spark, tmp_path):
    db = Database(spark, str(tmp_path), {"t": "a int, b string"})
    db.save("t", spark.createDataFrame([(1, "x")], "a int, b string"))
    db.save("t", spark.createDataFrame([("y", 2)], "b string, a int"))
    assert sorted(map(tuple, db.table("t").to_list())) == [(1, "x"), (2, "y")]
    assert db.save("t", db.table("t").where("a = 2"), "overwrite") == 1
    assert [tuple(r) for r in db.table("t").to_list()] == [(2, "y")]
    db._tables["t"].read_only = True
    with pytest.raises(PermissionError):
        db.save("t", db.table("t"))


def test_weeks_of_the_year(spark):
    from datetime import datetime, timedelta

    days = [datetime(2019, 12, 25) + timedelta(days=i) for i in range(0, 760, 3)]
    df = spark.createDataFrame([(d,) for d in days], "t timestamp_ntz")
    for r in df.select("t", *[D.strftime(f"%{x}", F.col("t")).alias(x) for x in "WUVGg"]).collect():
        assert [r[x] for x in "WUVGg"] == [r.t.strftime(f"%{x}") for x in "WUVGg"], r.t


def test_search_marks(spark):
    df = spark.createDataFrame([(1, "the one two", "a"), (2, "say the one", "the"), (3, "one and two", "b")], "i int, x string, y string")
    index = Index(df, ["x", "y"])
    found = lambda q: sorted(r.i for r in index.match(q).collect())
    assert found("x : ^the") == [1] and found("^the") == [1, 2] and found("one + two") == [1] and found("-x : the") == [2] and found("one two") == [1, 3]


def test_terminals_that_refuse_and_run_aside(spark):
    import asyncio

    q = Database(spark, SF).table("nation")
    with pytest.raises(ValueError):
        q.to_dictionary("n_regionkey")
    assert len(q.to_dictionary("n_nationkey")) == 25 and len(q.select("n_regionkey").to_hash_set()) == 5
    assert len(asyncio.run(q.run_async("to_list"))) == 25
