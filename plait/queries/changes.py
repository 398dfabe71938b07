"""Set-based changes: the table's rows after them, or the rows touched."""

from pyspark.sql import functions as F

from plait.operators import mutate as U
from plait.queries import case

c = F.col


def _part(db):
    return db.frame("part").select("p_partkey", "p_name", "p_size")


@case("update_where", "SELECT p_partkey, p_name, CASE WHEN p_size > 40 THEN p_size + 1 ELSE p_size END AS p_size FROM part")
def update_where(db):
    return U.update(_part(db), {"p_size": c("p_size") + 1}, c("p_size") > 40)


@case("update_returning", "SELECT p_partkey, p_name, p_size + 1 AS p_size FROM part WHERE p_size > 40")
def update_returning(db):
    return U.update(_part(db), {"p_size": c("p_size") + 1}, c("p_size") > 40, returning=True)


@case("update_from", """
SELECT c_custkey, CASE WHEN n_name IS NOT NULL AND n_regionkey = 1 THEN n_name ELSE c_name END AS c_name, c_nationkey
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def update_from(db):
    target = db.frame("customer").select("c_custkey", "c_name", "c_nationkey")
    return U.update_from(target, db.frame("nation"), [("c_nationkey", "n_nationkey")], lambda t: {"c_name": t["n_name"]}, lambda t: t["n_regionkey"] == 1)


@case("delete_where", "SELECT p_partkey, p_name, p_size FROM part WHERE NOT coalesce(nullif(p_size, 10) > 20, false)")
def delete_where(db):
    return U.delete(_part(db), F.nullif(c("p_size"), F.lit(10)) > 20)


@case("delete_returning", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 20")
def delete_returning(db):
    return U.delete(_part(db), c("p_size") > 20, returning=True)


@case("insert_from_query", "SELECT p_partkey, p_name, p_size FROM part UNION ALL SELECT s_suppkey + 1000000, s_name, NULL FROM supplier")
def insert_from_query(db):
    new = db.frame("supplier").select((c("s_suppkey") + 1000000).alias("p_partkey"), c("s_name").alias("p_name"))
    return U.insert_from(_part(db), new)


def _new(db):
    """Rows for parts 1 to 5, and as many new keys."""
    some = _part(db).filter("p_partkey BETWEEN 1 AND 5")
    return some.withColumn("p_size", c("p_size") + 100).union(some.select(-c("p_partkey"), "p_name", "p_size"))


_NEW = "new AS (SELECT p_partkey, p_name, p_size + 100 AS p_size FROM part WHERE p_partkey BETWEEN 1 AND 5 UNION ALL SELECT -p_partkey, p_name, p_size FROM part WHERE p_partkey BETWEEN 1 AND 5)"


@case("add_or_replace", f"WITH {_NEW} SELECT * FROM new UNION ALL SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM new)")
def add_or_replace(db):
    return U.add_or_update(_part(db), _new(db), ["p_partkey"])


@case("add_or_ignore", f"WITH {_NEW} SELECT p_partkey, p_name, p_size FROM part UNION ALL SELECT * FROM new WHERE p_partkey NOT IN (SELECT p_partkey FROM part)")
def add_or_ignore(db):
    return U.add_or_update(_part(db), _new(db), ["p_partkey"], "ignore")


@case("upsert_nothing", f"WITH {_NEW} SELECT p_partkey, p_name, p_size FROM part UNION ALL SELECT * FROM new WHERE p_partkey < 0")
def upsert_nothing(db):
    return U.upsert(_part(db), _new(db), ["p_partkey"], "nothing")


@case("upsert_all", f"WITH {_NEW} SELECT * FROM new UNION ALL SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey NOT BETWEEN 1 AND 5")
def upsert_all(db):
    return U.upsert(_part(db), _new(db), ["p_partkey"])


@case("upsert_update", f"""
WITH {_NEW} SELECT p_partkey, p_name, CASE WHEN p_partkey BETWEEN 1 AND 5 AND p_size < 30 THEN p_size * 2 + 100 ELSE p_size END AS p_size FROM part UNION ALL SELECT * FROM new WHERE p_partkey < 0""")
def upsert_update(db):
    return U.upsert(_part(db), _new(db), ["p_partkey"], "update", {"p_size": lambda o, n: o["p_size"] + n["p_size"]}, where=lambda o, n: o["p_size"] < 30)


@case("upsert_returning", f"WITH {_NEW} SELECT * FROM new")
def upsert_returning(db):
    return U.upsert(_part(db), _new(db), ["p_partkey"], returning=True)


@case("update_from_many", """
SELECT c_custkey, coalesce(min(CASE WHEN o_totalprice > 100000 THEN o_orderkey END), c_custkey) AS c_best FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def update_from_many(db):
    target = db.frame("customer").select("c_custkey", c("c_custkey").alias("c_best"))
    return U.update_from(target, db.frame("orders"), [("c_custkey", "o_custkey")], lambda t: {"c_best": t["o_orderkey"]}, lambda t: t["o_totalprice"] > 100000)


_AGAIN = "new AS (SELECT p_partkey, p_name, p_size + x AS p_size FROM part, (VALUES (1), (7), (3)) v(x) WHERE p_partkey % 3 = 0), one AS (SELECT p_partkey, p_name, max(p_size) AS p_size FROM new GROUP BY 1, 2)"


def _again(db):
    """New rows of which three share a key."""
    parts = _part(db).filter("p_partkey % 3 = 0")
    return parts.withColumn("p_size", F.explode(F.array(*[c("p_size") + x for x in (1, 7, 3)])))


@case("add_or_replace_again", f"WITH {_AGAIN} SELECT * FROM one UNION ALL SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 3 <> 0")
def add_or_replace_again(db):
    return U.add_or_update(_part(db), _again(db), ["p_partkey"], order=c("p_size"))


@case("upsert_again", f"WITH {_AGAIN} SELECT * FROM one UNION ALL SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 3 <> 0")
def upsert_again(db):
    return U.upsert(_part(db), _again(db), ["p_partkey"], order=c("p_size"))
