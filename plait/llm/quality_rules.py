"""Operator 9: quality rules.

A table of thresholds is compiled into one Spark projection over length,
symbol, stop-word, case and line measures. Everything is a built-in column
expression: no user function, no shuffle, one pass over the text.

Defined edge cases: a null or empty text has no words, so every count is 0 and
it fails; repeated rows each get the same result; a null doc_id is carried
along; other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plait.llm.common import let, table, word_array

#: Frequent function words of the languages served; fixed values.
STOP_WORDS = (
    "the of and to in is that it for was on are be with this from by "
    "de la le les des et en un une du que qui est pour dans "
    "der die und das den von mit ist dem nicht ein eine auf "
    "el los las y por con se del al para no una"
).split()


@dataclass(frozen=True)
class Rule:
    """1000 * num must lie in [low * den, high * den]; None: no bound.
    Integers only, so every engine agrees on the verdict."""

    name: str
    num: str
    den: str
    low: int | None = None
    high: int | None = None


RULES = (
    Rule("few_words", "n_words", "one", low=50_000),
    Rule("repeated_words", "n_repeat_words", "n_words", high=500),
    Rule("word_length", "word_chars", "n_words", low=2_000, high=15_000),
    Rule("symbols", "n_symbols", "n_words", high=200),
    Rule("exclamations", "n_exclaim", "n_words", high=300),
    Rule("capitals", "n_upper", "word_chars", high=400),
    Rule("no_stop_words", "n_stop_words", "n_words", low=20),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=800),
    Rule("ellipsis_lines", "n_ellipsis", "n_lines", high=300),
    Rule("bullet_lines", "n_bullets", "n_lines", high=900),
)
#: The rules that the output column base_failed stands for.
BASE = ("few_words", "repeated_words")


def _drop(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def repeat_words(words: Column, n: int = 3) -> Column:
    """Words that lie in an n-word window found twice or more in the text.

    Windows are sorted with their positions; equal neighbours mark the
    positions, whose covered words are then counted: O(w log w) a document.
    """

    def count(ws: Column) -> Column:
        wins = F.transform(
            F.sequence(F.lit(0), F.size(ws) - n),
            lambda i: F.struct(F.concat_ws(" ", *[F.get(ws, i + k) for k in range(n)]).alias("w"), i.alias("p")),
        )

        def marked(s: Column) -> Column:
            hit = F.filter(
                s,
                lambda x, i: F.coalesce(x["w"] == F.get(s, i - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get(s, i + 1)["w"], F.lit(False)),
            )
            return F.sort_array(F.transform(hit, lambda x: x["p"]))

        def covered(ps: Column) -> Column:
            return F.aggregate(
                F.transform(ps, lambda p, i: F.least(F.lit(n), F.coalesce(F.get(ps, i + 1) - p, F.lit(n)))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            )

        return F.when(F.size(ws) > n, let(let(F.sort_array(wins), marked), covered)).otherwise(F.lit(0).cast("long"))

    return let(words, count)


def measures(text: Column) -> dict[str, Column]:
    """Every measure of the table, from one text column without nulls."""
    words = word_array(text)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stop = F.array(*[F.lit(w) for w in sorted(set(STOP_WORDS))])
    return {
        "one": F.lit(1).cast("long"),
        "n_words": F.size(words).cast("long"),
        "word_chars": _drop(text, r"[\x20\x09-\x0D]+").cast("long"),
        "n_symbols": (F.length(text) - _drop(text, "[#*$%&|<>]+")).cast("long"),
        "n_exclaim": (F.length(text) - _drop(text, "!+")).cast("long"),
        "n_upper": (F.length(text) - _drop(text, r"\p{Lu}+")).cast("long"),
        "n_stop_words": F.size(F.filter(F.split(F.lower(text), r"[^\p{L}]+", -1), lambda w: F.array_contains(stop, w))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_ellipsis": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long"),
        "n_bullets": F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("long"),
        "n_repeat_words": repeat_words(words),
    }


def passes(rule: Rule) -> Column:
    num, den = F.col(rule.num) * F.lit(1000), F.col(rule.den)
    ok = F.lit(True)
    if rule.low is not None:
        ok = ok & (num >= den * F.lit(rule.low))
    if rule.high is not None:
        ok = ok & (num <= den * F.lit(rule.high))
    return ok


def apply_rules(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, every measure, failed (names of the rules broken) and kept."""
    got = measures(F.coalesce(F.col(text_col), F.lit("")))
    out = df.select(*keep, *[c.alias(k) for k, c in got.items()])
    failed = F.array_compact(F.array(*[F.when(~passes(r), F.lit(r.name)) for r in rules]))
    return out.withColumn("failed", failed).withColumn("kept", F.size("failed") == 0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of op9: one per document."""
    got = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.lit(False)
    for name in BASE:
        base = base | F.array_contains("failed", name)
    return got.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", F.array_join("failed", ",").alias("failed"),
    )


def _oracle() -> str:
    def bad(r: Rule) -> str:
        parts = []
        if r.low is not None:
            parts.append(f"1000 * {r.num} < {r.low} * {r.den}")
        if r.high is not None:
            parts.append(f"1000 * {r.num} > {r.high} * {r.den}")
        return "(" + " OR ".join(parts) + ")"

    fails = ", ".join(f"CASE WHEN {bad(r)} THEN '{r.name}' END" for r in RULES)
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    base = " OR ".join(bad(r) for r in RULES if r.name in BASE)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS p, ws FROM w WHERE len(ws) >= 3),
win2 AS (SELECT rid, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS g FROM win),
rep AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c FROM win2) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM rep) GROUP BY rid),
m AS (SELECT doc_id, 1 AS one, len(ws) AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
    length(t) - length(replace(t, '!', '')) AS n_exclaim,
    length(t) - length(regexp_replace(t, '\p{{Lu}}+', '', 'g')) AS n_upper,
    len(list_filter(regexp_extract_all(lower(t), '\p{{L}}+'), lambda x: x IN ({stops}))) AS n_stop_words,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullets,
    coalesce(cov.n, 0) AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) AS base_failed,
       failed = '' AS kept, failed
FROM (SELECT *, concat_ws(',', {fails}) AS failed FROM m)
"""


ORACLE = _oracle()
