"""Scalar functions: strings, characters, math, dates, JSON, arrays."""

from pyspark.sql import functions as F

from plait.functions import arrays as A
from plait.functions import dates as D
from plait.functions import jsons as J
from plait.functions import maths as M
from plait.functions import sem
from plait.functions import strings as S
from plait.functions.misc import Converter
from plait.queries import case

c = F.col


@case("str_search", """
SELECT p_partkey, length(p_name) AS n, contains(lower(p_type), 'brass') AS a, starts_with(lower(p_type), 'promo') AS b, ends_with(p_type, 'TIN') AS d,
  strpos(p_name, 'e') - 1 AS i, CASE WHEN strpos(substr(p_name, 4), 'e') > 0 THEN strpos(substr(p_name, 4), 'e') + 2 ELSE -1 END AS j,
  CASE WHEN contains(p_name, 'e') THEN length(p_name) - strpos(reverse(p_name), 'e') ELSE -1 END AS k, strpos(p_name, 'a') AS ins FROM part""")
def str_search(db):
    n, t = c("p_name"), c("p_type")
    return db.table("part").select(
        "p_partkey", n=S.length(n), a=S.contains(t, "Brass"), b=S.starts_with(t, "promo"), d=S.ends_with(t, "TIN", ignore_case=False),
        i=S.index_of(n, "e"), j=S.index_of(n, "e", 3), k=S.last_index_of(n, "e"), ins=S.instr(n, "a"),
    )


@case("str_edit", """
SELECT p_partkey, substr(p_name, 1, 2) || '--' || substr(p_name, 3) AS a, substr(p_name, 1, 3) AS b, substr(p_name, 1, 1) || substr(p_name, 4) AS d,
  replace(p_name, 'a', '') AS e, substr(p_name, 2, 1) AS f, substr(p_name, 3, 4) AS g, substr(p_name, 1, 2) AS h, upper(p_name) AS u, lower(p_type) AS l FROM part""")
def str_edit(db):
    n = c("p_name")
    return db.table("part").select(
        "p_partkey", a=S.insert(n, 2, "--"), b=S.remove(n, 3), d=S.remove(n, 1, 2), e=S.replace(n, "a", None), f=S.char_at(n, 1),
        g=S.substring(n, 2, 4), h=S.substring(n, -1, 2), u=S.to_upper(n), l=S.to_lower(c("p_type")),
    )


@case("str_pad_trim", """
SELECT p_partkey, lpad(p_brand, 12, '*') AS a, rpad(p_brand, 12, ' ') AS b, p_brand AS d, trim(p_name) AS e, trim('xy' || p_brand || 'x', 'xy') AS f,
  p_brand || chr(9) AS g, p_brand AS h FROM part""")
def str_pad_trim(db):
    b = c("p_brand")
    return db.table("part").select(
        "p_partkey", a=S.pad_left(b, 12, "*"), b=S.pad_right(b, 12), d=S.pad_left(b, 2), e=S.trim(F.concat(F.lit("\t "), c("p_name"), F.lit(" "))),
        f=S.trim(F.concat(F.lit("xy"), b, F.lit("x")), "xy"), g=S.trim_start(F.concat(F.lit(" "), b, F.lit("\t"))), h=S.trim_end(F.concat(b, F.lit("　"))),
    )


@case("str_compare", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'FURNITURE' THEN 0 WHEN c_mktsegment < 'FURNITURE' THEN -1 ELSE 1 END AS a,
  CASE WHEN nullif(c_mktsegment, 'BUILDING') IS NULL THEN -1 ELSE 1 END AS b, lower(c_mktsegment) = 'machinery' AS e,
  nullif(c_mktsegment, 'BUILDING') IS NULL AS empty, false AS blank FROM customer""")
def str_compare(db):
    s = c("c_mktsegment")
    maybe = F.nullif(s, F.lit("BUILDING"))
    return db.table("customer").select(
        "c_custkey", a=S.compare(s, "FURNITURE"), b=S.compare(maybe, ""), e=S.equals(s, "Machinery", ignore_case=True), empty=S.is_null_or_empty(maybe),
        blank=S.is_null_or_white_space(s),
    )


@case("str_concat", """
SELECT c_custkey, c_name || coalesce(nullif(c_mktsegment, 'BUILDING'), '') AS a, c_name || '|' || coalesce(nullif(c_mktsegment, 'BUILDING'), '') || '|' || c_nationkey AS b FROM customer""")
def str_concat(db):
    maybe = F.nullif(c("c_mktsegment"), F.lit("BUILDING"))
    return db.table("customer").select("c_custkey", a=S.concat(c("c_name"), maybe), b=S.join("|", c("c_name"), maybe, c("c_nationkey")))


@case("str_printf", """
SELECT p_partkey, printf('%05d|%.2f|%s', p_size, p_retailprice, p_brand) AS a, unicode(p_name) AS u, chr(65) || chr(8364) AS e FROM part""")
def str_printf(db):
    return db.table("part").select("p_partkey", a=S.printf("%05d|%.2f|%s", c("p_size"), c("p_retailprice"), c("p_brand")), u=S.unicode_of(c("p_name")), e=S.char_of(65, 8364))


@case("char_tests", """
SELECT p_partkey, regexp_matches(substr(p_name, 1, 1), '[a-z]') AS low, regexp_matches(substr(p_name, 1, 1), '[A-Z]') AS up, regexp_matches(substr(p_brand, 7, 1), '[0-9]') AS digit,
  false AS space, regexp_matches(substr(p_name, 1, 1), '[A-Za-z]') AS letter FROM part""")
def char_tests(db):
    first = S.char_at(c("p_name"), 0)
    return db.table("part").select(
        "p_partkey", low=S.is_ascii_lower(first), up=S.is_ascii_upper(first), digit=S.is_ascii_digit(S.char_at(c("p_brand"), 6)), space=S.is_white_space(first),
        letter=S.is_ascii_letter(first),
    )


@case("real_text", "SELECT p_partkey, printf('%.15g', p_size / 4.0) AS t FROM part")
def real_text(db):
    return db.table("part").select("p_partkey", t=S.real_text(c("p_size") / 4.0))


@case("parse_numbers", """
SELECT p_partkey, CAST(p_size AS BIGINT) AS a, CAST(p_size AS DOUBLE) + 0.5 AS b FROM part""")
def parse_numbers(db):
    text = F.concat(c("p_size").cast("string"), F.lit("abc"))
    return db.table("part").select("p_partkey", a=sem.parse_int(text), b=sem.parse_real(F.concat(c("p_size").cast("string"), F.lit(".5x"))))


@case("math_round", """
SELECT p_partkey, round_even(p_size / 4.0, 0) AS e, round(p_size / 4.0) AS a, ceil(p_size / 4.0) AS up, floor(p_size / 4.0) AS down, trunc(-p_size / 4.0) AS t,
  CAST(round(p_size / 4.0) AS INT) AS i, least(greatest(p_size, 10), 20) AS cl, CASE WHEN p_size > 25 THEN 1 WHEN p_size < 25 THEN -1 ELSE 0 END AS s, abs(25 - p_size) AS ab FROM part""")
def math_round(db):
    x = c("p_size") / 4.0
    return db.table("part").select(
        "p_partkey", e=M.round_(x), a=M.round_(x, mode="away_from_zero"), up=M.ceiling(x), down=M.floor(x), t=M.truncate(-x), i=M.to_int(x),
        cl=M.clamp(c("p_size"), 10, 20), s=M.sign(c("p_size") - 25), ab=M.abs_(25 - c("p_size")),
    )


_R = "round({}, 8)"


@case("math_power", f"""
SELECT p_partkey, {_R.format('pow(p_size, 2)')} AS p, {_R.format('sqrt(p_size)')} AS q, {_R.format('cbrt(p_size)')} AS cb, {_R.format('exp(p_size / 50.0)')} AS ex,
  {_R.format('ln(p_size)')} AS l, {_R.format('log10(p_size)')} AS l10, {_R.format('log2(p_size)')} AS l2, {_R.format('ln(p_size) / ln(3)')} AS l3,
  CASE WHEN p_size >= 25 THEN {_R.format('sqrt(greatest(p_size - 25, 0))')} END AS neg FROM part""")
def math_power(db):
    x, r = c("p_size"), lambda v: F.round(v, 8)
    return db.table("part").select(
        "p_partkey", p=r(M.pow_(x, 2)), q=r(M.sqrt(x)), cb=r(M.cbrt(x)), ex=r(M.exp(x / 50.0)), l=r(M.ln(x)), l10=r(M.log10(x)), l2=r(M.log2(x)), l3=r(M.log(x, 3)),
        neg=r(M.sqrt(x - 25)),
    )


@case("math_trig", f"""
SELECT p_partkey, {', '.join(f"{_R.format(f'{f}(p_size / 60.0)')} AS {f}" for f in 'sin cos tan asin acos atan sinh cosh tanh asinh atanh radians degrees'.split())},
  {_R.format('atan2(p_size, 10)')} AS atan2, {_R.format('acosh(p_size + 1.0)')} AS acosh FROM part""")
def math_trig(db):
    x = c("p_size") / 60.0
    one = {n: F.round(getattr(M, n)(x), 8) for n in "sin cos tan asin acos atan sinh cosh tanh asinh atanh radians degrees".split()}
    return db.table("part").select("p_partkey", **one, atan2=F.round(M.atan2(c("p_size"), 10), 8), acosh=F.round(M.acosh(c("p_size") + 1.0), 8))


@case("enum_functions", """
SELECT o_orderkey, (o_orderkey & 4) = 4 AS f, CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'None' WHEN 1 THEN 'Book' ELSE '2' END AS g,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS p, upper(hex(o_orderkey)) AS x FROM orders""")
def enum_functions(db):
    k = c("o_orderkey")
    return db.table("orders").select(
        "o_orderkey", f=M.has_flag(k, F.lit(4).cast("bigint")), g=M.enum_name((k % 3).cast("int"), {0: "None", 1: "Book"}),
        p=M.enum_value(c("o_orderstatus"), {1: "F", 2: "O"}), x=F.hex(k),
    )


@case("date_parts", """
SELECT event_id, CAST(year(ts) AS INT) AS y, CAST(month(ts) AS INT) AS m, CAST(day(ts) AS INT) AS d, CAST(hour(ts) AS INT) AS h, CAST(minute(ts) AS INT) AS mi, CAST(second(ts) AS INT) AS s,
  CAST(dayofweek(ts) AS INT) AS dow, CAST(dayofyear(ts) AS INT) AS doy, date_trunc('day', ts)::TIMESTAMP AS date, epoch_us(ts) - epoch_us(date_trunc('day', ts)::TIMESTAMP) AS tod,
  CAST(epoch_us(ts) * 10 + 621355968000000000 AS BIGINT) AS ticks, CAST(epoch_us(ts) % 1000000 // 1000 AS INT) AS ms, CAST(epoch_us(ts) % 1000 AS INT) AS us,
  CAST(date_diff('day', DATE '1970-01-01', ts::DATE) AS BIGINT) + 719162 AS dn FROM events""")
def date_parts(db):
    t = c("ts")
    return db.table("events").select(
        "event_id", y=D.year(t), m=D.month(t), d=D.day(t), h=D.hour(t), mi=D.minute(t), s=D.second(t), dow=D.day_of_week(t), doy=D.day_of_year(t), date=D.date_part(t),
        tod=D.time_of_day(t), ticks=D.ticks(t), ms=D.millisecond(t), us=D.microsecond(t), dn=D.day_number(t.cast("date")).cast("bigint"),
    )


@case("date_add", """
SELECT event_id, ts + INTERVAL 1 MONTH AS a, ts - INTERVAL 1 YEAR AS b, ts + INTERVAL 3 DAY AS d, ts + INTERVAL 90 MINUTE AS e, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS f,
  (epoch_us(ts) + 5400000000) % 86400000000 AS g FROM events""")
def date_add(db):
    t = c("ts")
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return db.table("events").select(
        "event_id", a=D.add(t, "months", 1), b=D.add(t, "years", -1), d=D.add(t, "days", 3), e=D.add(t, "hours", 1.5), f=D.subtract(t, base),
        g=D.add_time(D.time_of_day(t), D.span("minutes", 90)),
    )


@case("spans", """
SELECT event_id, CAST(event_id * 1234567 // 86400000 AS BIGINT) AS d, CAST(event_id * 1234567 // 3600000 % 24 AS BIGINT) AS h, CAST(event_id * 1234567 // 60000 % 60 AS BIGINT) AS m,
  CAST(event_id * 1234567 % 1000 AS BIGINT) AS ms, round(event_id * 1234567 / 3600000.0, 9) AS total FROM events""")
def spans(db):
    s = D.span("milliseconds", c("event_id") * 1234567)
    return db.table("events").select(
        "event_id", d=D.span_part(s, "days"), h=D.span_part(s, "hours"), m=D.span_part(s, "minutes"), ms=D.span_part(s, "milliseconds"), total=F.round(D.span_total(s, "hours"), 9)
    )


@case("date_strftime", """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS a, strftime(ts, '%H:%M:%S') AS b, strftime(ts, '%Y/%j %w %%') AS d, strftime(date_trunc('month', ts)::TIMESTAMP + INTERVAL 1 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS e,
  CAST(floor(epoch(ts)) AS BIGINT) AS u, round(julian(ts) - 0.5, 6) AS jd, strftime(ts, '%Y-%m-%d %H:%M:%S') AS f FROM events""")
def date_strftime(db):
    t = c("ts")
    return db.table("events").select(
        "event_id", a=D.date_text(t), b=D.time_text(t), d=D.strftime("%Y/%j %w %%", t), e=D.date_text(t, "start of month", "+1 month", "-1 day"),
        u=D.unix_epoch(t), jd=F.round(D.julian_day(t), 6), f=D.datetime_text(t),
    )


@case("date_modifiers", """
SELECT event_id, strftime(date_trunc('day', ts)::TIMESTAMP + INTERVAL (CAST((8 - dayofweek(ts)) % 7 AS INT)) DAY, '%Y-%m-%d') AS monday, strftime(date_trunc('year', ts)::TIMESTAMP, '%Y-%m-%d') AS y,
  strftime(make_timestamp(event_id * 1000000), '%Y-%m-%d %H:%M:%S') AS unix FROM events""")
def date_modifiers(db):
    t = c("ts")
    return db.table("events").select("event_id", monday=D.date_text(t, "weekday 1"), y=D.date_text(t, "start of year"), unix=D.datetime_text(c("event_id"), "unixepoch"))


@case("date_timediff")
def date_timediff(db):
    return db.table("events").select("event_id", d=D.time_diff(c("ts"), F.lit("2024-01-31 12:00:00")))


@case("json_extract", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, json_valid(props) AS ok, json_type(props) IS NOT NULL AS t, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS next FROM events""")
def json_extract(db):
    p = c("props")
    return db.table("events").select("event_id", k=J.extract(p, "$.k", "int"), ok=J.valid(p), t=J.type_of(p).isNotNull(), next=J.extract(p, "$.k", "bigint") + 1)


@case("json_change", """
SELECT event_id, '{"k":' || k || ',"n":1}' AS a, '{"k":' || k || '}' AS b, '{"k":0}' AS d, '{}' AS e, '{"k":' || k || ',"x":{"y":[1]}}' AS f, '{"k":' || k || '}' AS g, 'integer' AS t,
  'object' AS o FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)""")
def json_change(db):
    p = c("props")
    return db.table("events").select(
        "event_id", a=J.set_(p, "$.n", 1), b=J.insert(p, "$.k", 5), d=J.replace(p, "$.k", 0), e=J.remove(p, "$.k"), f=J.patch(p, {"x": {"y": [1]}, "z": None}), g=J.minify(p),
        t=J.type_of(p, "$.k"), o=J.type_of(p),
    )


@case("json_arrays", "SELECT event_id, CAST(event_id % 5 + 1 AS INT) AS n, CAST(user_id % 3 + 1 AS INT) AS m, event_type AS x FROM events")
def json_arrays(db):
    upto = lambda n: F.to_json(F.sequence(F.lit(0).cast("bigint"), n))
    doc = F.concat(F.lit('{"a": ["a", "'), c("event_type"), F.lit('"], "o": '), upto(c("user_id") % 3), F.lit("}"))
    return db.table("events").select("event_id", n=J.array_length(upto(c("event_id") % 5)), m=J.array_length(doc, "$.o"), x=J.extract(doc, "$.a[1]"))


def _lists(db):
    """Each customer's order keys in order."""
    q = db.table("orders").group_by("o_custkey")
    return q.select(ks=F.sort_array(F.collect_list("o_orderkey")))


_LISTS = "WITH l AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS ks FROM orders GROUP BY 1) "


@case("array_scalars", _LISTS + """
SELECT o_custkey, len(ks) AS n, ks[1] AS f, ks[len(ks)] AS l, list_min(ks) AS lo, list_max(ks) AS hi, CAST(list_sum(ks) AS BIGINT) AS s, list_avg(ks) AS a, ks[2] AS e,
  list_contains(ks, ks[1]) AS has, len(ks) > 0 AS some, list_position(ks, ks[1]) - 1 AS i FROM l""")
def array_scalars(db):
    k = c("ks")
    return _lists(db).select(
        "o_custkey", n=A.count(k), f=A.first(k), l=A.last(k), lo=A.min_(k), hi=A.max_(k), s=A.sum_(k), a=A.average(k), e=A.element_at(k, 1), has=A.contains(k, F.get("ks", F.lit(0))),
        some=A.any_(k), i=A.index_of(k, F.get("ks", F.lit(0))),
    )


@case("array_lambdas", _LISTS + """
SELECT o_custkey, len(list_filter(ks, lambda x: x % 2 = 0)) AS even, list_sum(list_transform(list_filter(ks, lambda x: x % 2 = 0), lambda x: x * 2))::BIGINT AS twice,
  len(list_filter(ks, lambda x: x > 5000)) > 0 AS any_big, len(list_filter(ks, lambda x: x <= 0)) = 0 AS all_pos, array_to_string(list_reverse(ks)[1:3], ',') AS top,
  array_to_string(ks[2:3], ',') AS part, coalesce(list_position(list_transform(ks, lambda x: x % 3 = 0), true), 0) - 1 AS at FROM l""")
def array_lambdas(db):
    k = c("ks")
    even = A.where(k, lambda x: x % 2 == 0)
    return _lists(db).select(
        "o_custkey", even=A.count(k, lambda x: x % 2 == 0), twice=F.nullif(A.sum_(A.select(even, lambda x: x * 2)), F.lit(0).cast("bigint")), any_big=A.any_(k, lambda x: x > 5000),
        all_pos=A.all_(k, lambda x: x > 0), top=F.array_join(A.take(A.order_by(k, (lambda x: x, True)), 3), ","), part=F.array_join(A.get_range(k, 1, 2), ","),
        at=A.find_index(k, lambda x: x % 3 == 0),
    )


@case("array_sets", _LISTS + """
SELECT o_custkey, len(list_distinct(list_transform(ks, lambda x: x % 3))) AS d, len(list_distinct(list_concat(ks, [1, 2]))) AS u, len(list_intersect(ks, [1, 2, 3, 4, 5, 6, 7])) AS i,
  len(list_filter(ks, lambda x: x NOT IN (1, 2, 3))) AS e, array_to_string(list_concat([0], list_concat(ks, [-1])), ',') AS ap FROM l""")
def array_sets(db):
    k = c("ks")
    of = lambda *xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    return _lists(db).select(
        "o_custkey", d=A.count(A.distinct(A.select(k, lambda x: x % 3))), u=A.count(A.union(k, of(1, 2))), i=A.count(A.intersect(k, of(1, 2, 3, 4, 5, 6, 7))),
        e=A.count(A.except_(k, of(1, 2, 3))), ap=F.array_join(A.prepend(A.append(k, F.lit(-1).cast("bigint")), F.lit(0).cast("bigint")), ","),
    )


@case("array_group_by", _LISTS + """
SELECT o_custkey, string_agg(g || ':' || n, ',' ORDER BY g) AS gs FROM (SELECT o_custkey, x % 3 AS g, count(*) AS n FROM (SELECT o_custkey, unnest(ks) AS x FROM l) GROUP BY 1, 2) GROUP BY 1""")
def array_group_by(db):
    groups = A.group_by(c("ks"), lambda x: x % 3)
    text = A.select(groups, lambda g: F.concat_ws(":", g["key"].cast("string"), F.size(g["values"]).cast("string")))
    return _lists(db).select("o_custkey", gs=F.array_join(F.sort_array(text), ","))


@case("array_select_many", _LISTS + "SELECT o_custkey, CAST(2 * len(ks) AS INT) AS n, CAST(2 * list_sum(ks) + len(ks) AS BIGINT) AS s FROM l")
def array_select_many(db):
    many = A.select_many(c("ks"), lambda x: F.array(x, x + 1))
    return _lists(db).select("o_custkey", n=A.count(many), s=A.sum_(many))


@case("map_functions", "SELECT event_id, true AS has, json_extract_string(props, '$.k') AS v, 1 AS n FROM events")
def map_functions(db):
    m = F.from_json("props", "map<string,string>")
    return db.table("events").select("event_id", m=m).select("event_id", has=A.contains_key(c("m"), "k"), v=F.try_element_at("m", F.lit("k")), n=F.size(A.keys(c("m"))))


@case("array_literal", "SELECT n_nationkey FROM nation WHERE n_name IN ('FRANCE', 'GERMANY') OR n_nationkey IN (1, 2, 3)")
def array_literal(db):
    names = F.array(F.lit("FRANCE"), F.lit("GERMANY"))
    return db.table("nation").where(A.contains(names, c("n_name")) | A.contains(F.array(*map(F.lit, (1, 2, 3))), c("n_nationkey"))).select("n_nationkey")


@case("explode_array", _LISTS + "SELECT o_custkey, unnest(ks) AS k FROM l")
def explode_array(db):
    return _lists(db).select("o_custkey", k=F.explode("ks"))


@case("custom_function", "SELECT p_partkey, p_retailprice * 1.5 AS price, p_size * 10 AS mm FROM part")
def custom_function(db):
    db.fn.add("marked_up", lambda price: price * 1.5)
    db._tables["part"].converters["p_size"] = Converter(lambda cm: cm, lambda col: col * 10)
    return db.table("part").select("p_partkey", price=db.fn.marked_up(c("p_retailprice")), mm="p_size")
