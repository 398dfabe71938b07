"""Operator 5: secret scans with corpus-wide ownership frequency.

Spans of secrets are found in every whole text with built-in regular
expressions. Every value found is hashed; its rows are counted by distinct
repository and owner over the whole corpus. A value that many owners hold is a
widely copied example; one that few hold is a live-looking credential. Base
kinds (assign, access, hex) are always reported; the further kinds (known
prefixes, private key headers, mixed strings) only where they look live.

The plan: one scan of the texts writes the few spans and no text; counts are
taken in two levels of partial aggregation (value and holder, then value), so a
value in a third of all rows is summed before it is shuffled; the join back of
the verdicts is one that adaptive execution can split.

Defined edge cases: a null text counts as empty; a document without a span has
counts of 0, the hash of the empty string and empty spans; repeated rows (same
doc_id and text) each get the same result; a null doc_id or source is carried
along, and a null holder is one holder; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plait.llm.common import materialize, table


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    group: int = 0
    least: int = 1  # characters of the group
    needs: tuple[str, ...] = ()  # patterns the group must hold


#: The base kinds, in the order in which spans of one start are listed. Runs
#: are greedy, so a least length within the pattern drops the same matches as
#: a filter after it; only assign can eat a later keyword and is filtered.
BASE = (
    Kind("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    Kind("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Kind("hex", r"[0-9a-f]{32,}", 0, 32),
)
FURTHER = (
    Kind("prefix", r"(?:gh[pousr]_|glpat-|xox[abprs]-|sk-|AIza)[A-Za-z0-9_-]{16,}", 0, 20),
    Kind("header", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Kind("mixed", r"[A-Za-z0-9+/_-]{24,}", 0, 24, (r"[0-9].*[0-9].*[0-9]", r"[A-Z].*[A-Z]", r"[a-z].*[a-z]")),
)
SPAN = "array<struct<s:bigint,o:int,e:bigint,k:string,v:string>>"


def find(text: Column, kind: Kind, order: int) -> Column:
    """Leftmost non-overlapping spans of a kind, in code points, as SPAN.

    The pieces between matches and the matches alternate, so the sum of the
    lengths before a match is its start."""
    pattern = F.lit(kind.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(kind.group))
    gaps = F.split(text, kind.pattern, -1)
    steps = F.arrays_zip(gaps.alias("g"), whole.alias("w"), value.alias("v"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["g"])
        e = s + F.coalesce(F.length(x["w"]), F.lit(0))
        ok = x["w"].isNotNull() & (F.length(x["v"]) >= kind.least)
        for need in kind.needs:
            ok = ok & x["v"].rlike(need)
        one = F.struct(s.alias("s"), F.lit(order).alias("o"), e.alias("e"), F.lit(kind.name).alias("k"), x["v"].alias("v"))
        return F.struct(e.alias("at"), F.when(ok, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(steps, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(kind.pattern), found).otherwise(F.expr(f"cast(array() as {SPAN})"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """From doc_id and text: doc_id, row_hash, keep columns, base and further spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    got = df.select(
        "doc_id", *keep, F.xxhash64(text).alias("row_hash"),
        F.concat(*[find(text, k, i) for i, k in enumerate(BASE)]).alias("base"),
        F.concat(*[find(text, k, i + len(BASE)) for i, k in enumerate(FURTHER)]).alias("more"),
    )
    alone = F.filter("more", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    first = F.filter("more", lambda x: ~F.exists("more", lambda b: (b["o"] < x["o"]) & (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return got.withColumn("more", first).withColumn("more", alone).withColumn("base", F.array_sort("base"))


def ownership(spans: DataFrame, repo: str, owner: str) -> DataFrame:
    """From rows (value_hash, repo, owner): value_hash, n_repos, n_owners. Both
    counts are over distinct holders, summed in two levels."""

    def holders(col: str, name: str) -> DataFrame:
        return spans.groupBy("value_hash", col).agg(F.lit(1).alias("one")).groupBy("value_hash").agg(F.count("one").alias(name))

    return holders(repo, "n_repos").join(holders(owner, "n_owners"), "value_hash")


def scan_secrets(df: DataFrame, repo: str = "doc_id", owner: str = "source", example_owners: int = 5, example_repos: int = 5) -> DataFrame:
    """One row per input row: doc_id, base and spans (SPAN arrays; spans has the
    further live ones), n_live, n_example. A value that example_owners owners
    and example_repos repositories hold at least is an example."""
    cols = tuple(dict.fromkeys(c for c in (repo, owner) if c != "doc_id"))
    found = materialize(scan(df.select("doc_id", "text", *cols), cols), "secrets")
    some = found.filter((F.size("base") > 0) | (F.size("more") > 0))
    each = some.select(
        "doc_id", "row_hash", F.col(repo).alias("r"), F.col(owner).alias("w"), F.explode(F.concat("base", "more")).alias("x")
    ).withColumn("value_hash", F.sha2("x.v", 256))
    counts = ownership(each.select("value_hash", "r", "w"), "r", "w")
    judged = each.join(counts, "value_hash").withColumn("example", (F.col("n_owners") >= example_owners) & (F.col("n_repos") >= example_repos))
    per_doc = judged.groupBy("doc_id", "row_hash").agg(F.collect_set(F.struct("x", "example")).alias("judged"))
    has = F.coalesce("judged", F.expr(f"cast(array() as array<struct<x:{SPAN[6:-1]},example:boolean>>)"))
    kept = F.filter(has, lambda j: (j["x"]["o"] < len(BASE)) | ~j["example"])
    a, b = found.alias("a"), per_doc.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.row_hash") == F.col("b.row_hash"))
    return a.join(b, same, "left").select(
        "a.doc_id", "a.base",
        F.array_sort(F.transform(kept, lambda j: j["x"])).alias("spans"),
        F.size(F.filter(has, lambda j: ~j["example"])).cast("long").alias("n_live"),
        F.size(F.filter(has, lambda j: j["example"])).cast("long").alias("n_example"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of op5. A document counts as a repository, its source as the owner."""
    got = scan_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long").alias(f"n_{kind}")

    n = [count(k.name) for k in BASE]
    return got.select("doc_id", *n, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "n_live", "n_example")


def _oracle() -> str:
    parts = []
    for i, k in enumerate((*BASE, *FURTHER)):
        pattern = k.pattern.replace("'", "''")
        ok = " AND ".join([f"length(v) >= {k.least}", *[f"regexp_matches(v, '{n}')" for n in k.needs]])
        parts.append(f"""
SELECT rid, {i} AS o, '{k.name}' AS k, s, s + length(w) AS e, v FROM (
  SELECT rid, ms[i] AS w, vs[i] AS v,
    coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0)
    + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT rid, ms, vs, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT rid, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {k.group}) AS vs,
      regexp_split_to_array(t, '{pattern}') AS gs
    FROM d WHERE regexp_matches(t, '{pattern}')))) WHERE {ok}""")
    n = len(BASE)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
a AS MATERIALIZED ({" UNION ALL ".join(parts)}),
m AS (SELECT * FROM a WHERE o >= {n} AND NOT EXISTS (SELECT 1 FROM a b WHERE b.rid = a.rid AND b.o >= {n} AND b.o < a.o AND b.s < a.e AND a.s < b.e)),
x AS (SELECT * FROM a WHERE o < {n} UNION ALL
  SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.rid = m.rid AND b.o < {n} AND b.s < m.e AND m.s < b.e)),
f AS (SELECT v, count(DISTINCT doc_id) >= 5 AND count(DISTINCT source) >= 5 AS example FROM x JOIN d USING (rid) GROUP BY v),
g AS (SELECT rid, count(*) FILTER (o = 0) AS a0, count(*) FILTER (o = 1) AS a1, count(*) FILTER (o = 2) AS a2,
    string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o < {n}) AS base,
    string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o < {n} OR NOT example) AS spans,
    count(*) FILTER (NOT example) AS n_live, count(*) FILTER (example) AS n_example
  FROM x JOIN f USING (v) GROUP BY rid)
SELECT doc_id, coalesce(a0, 0) AS n_assign, coalesce(a1, 0) AS n_access, coalesce(a2, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN g USING (rid)
"""


ORACLE = _oracle()
