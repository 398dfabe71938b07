"""Operator 7: URL filters by host word segmentation.

Rules on hosts and paths decide first. Every other url is judged by words: each
host label and path token is split into words by a unigram Viterbi search, and
a multinomial naive Bayes model scores the words.

Unigrams are counted in Spark over all the words of the documents, and of the
urls' paths by distinct hosts; every word met twice counts. The words of the
fixed lists below have a fixed share besides, so that they are known where the
corpus lacks them. The naive Bayes counts are of two sources: the urls that a
rule decides, by distinct hosts, without the words that the rules themselves
test; and the fixed lists as prior counts, for no url has a label.

No table of words is held whole anywhere. Each distinct run of letters of the
urls is split once: its parts of up to MAX_WORD letters are joined with the
counted words, and the words it is split into with the naive Bayes counts; then
the urls are joined with their runs. Only sums come to the driver.

Defined edge cases: a null url, or one without "://", has an empty host and
path, matches no rule and is allowed; repeated rows each get the same result;
very long labels are segmented in linear time (words are at most MAX_WORD
letters); a run of digits is a word that says nothing; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plait.llm.common import discard, fresh, materialize, slices, table, word_array

#: Rules of the query as (verdict, host, path).
RULES = (
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
)

#: Words of unwanted and of wanted hosts and paths, most telling
#: first. They are prior counts of the naive Bayes model and, with COMMON, of the
#: segmenter.
UNWANTED = (
    "casino pills viagra porn xxx sex bet bets betting poker slots jackpot loan loans payday cheap spam farm ads ad track tracker "
    "tracking click clicks banner popup win winner winners prize prizes free bonus replica pharmacy escort dating adult cam cams "
    "warez crack torrent malware phish scam lottery gamble gambling crypto discount deals buy now hot nude weight loss miracle"
).split()
WANTED = (
    "news blog wiki docs documentation help support science school university library museum journal health weather travel food "
    "recipes music art books history sport sports tech developer forum community learn education research government city local "
    "world people family home garden story stories review reviews photo video radio press article articles about contact"
).split()
COMMON = (
    "example www com net org en de fr es it info online shop store web site page the my best top mail app data cloud link links "
    "world wide game games money bank car cars real estate hotel hotels phone mobile"
).split()
MAX_WORD = 16
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+")
#: The same runs of letters, for Spark.
LETTERS = r"\p{L}+"
#: Fixed value: the lists' share of the unigrams.
LISTED = 0.2


def _runs(text, pattern: str = LETTERS):
    """The runs of letters of a text column in lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def word_counts(parts: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Words (w) of texts (text) and, by distinct hosts, of the paths of parts
    (host, path), with their counts (n): all that are met twice."""
    fits = F.length("w") <= MAX_WORD
    counts = parts.select("host", F.explode(_runs(F.col("path"))).alias("w")).filter(fits).distinct().groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    if texts is not None:
        # distinct raw words are far fewer than words: the pattern runs on those
        raw = texts.select(F.explode(word_array(F.col("text"))).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
        counts = counts.union(raw.select(F.explode(_runs(F.col("x"))).alias("w"), "n").filter(fits))
    return counts.groupBy("w").agg(F.sum("n").alias("n")).filter("n > 1")


def count_words(parts: DataFrame, texts: DataFrame | None = None) -> dict[str, int]:
    """word_counts of small tables, as a dict."""
    return dict(map(tuple, word_counts(parts, texts).collect()))


def unigrams(counts: dict[str, int] | None = None, met: int | None = None) -> dict[str, float]:
    """log probability of each known word: its share of the counts, and of the
    lists, Zipf by rank in its list. Without counts the lists are all there is.
    met: the sum of all counts, if counts has only some of the words."""
    weight: dict[str, float] = {}
    for words in (UNWANTED, WANTED, COMMON):
        for i, w in enumerate(words):
            weight[w] = max(weight.get(w, 0.0), 1.0 / (i + 10))
    total = sum(weight.values()) / 0.9  # a tenth is left for unknown words
    counts = counts or {}
    met = sum(counts.values()) if met is None else met
    if not met:
        return {w: math.log(v / total) for w, v in weight.items()}
    met, listed = met / 0.9 / (1 - LISTED), total / LISTED
    return {w: math.log(counts.get(w, 0) / met + weight.get(w, 0.0) / listed) for w in sorted({*counts, *weight})}


def segment(name: str, logp: dict[str, float], unknown: float = -4.0) -> list[str]:
    """The likeliest split of a run of letters. An unknown letter costs as much
    as `unknown`, and adjoining unknown letters make one word."""
    n = len(name)
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        best[j], back[j] = best[j - 1] + unknown, -1
        for i in range(max(0, j - MAX_WORD), j):
            p = logp.get(name[i:j])
            if p is not None and best[i] + p > best[j]:
                best[j], back[j] = best[i] + p, i
    words: list[str] = []
    j, open_end = n, None
    while j:
        if back[j] == -1:
            open_end = j if open_end is None else open_end
            j -= 1
            if j == 0:
                words.append(name[0:open_end])
        else:
            if open_end is not None:
                words.append(name[j:open_end])
                open_end = None
            words.append(name[back[j] : j])
            j = back[j]
    return words[::-1]


def _parts_of(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run (id, t): its distinct parts of up to MAX_WORD letters, as (id, w)."""
    for batch in source:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = list({t[a:b] for a in range(len(t)) for b in range(a + 1, min(a + MAX_WORD, len(t)) + 1)})
            for at in range(0, len(found), 1 << 14):
                some = found[at : at + (1 << 14)]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(some), pa.int64()), pa.array(some, pa.string())], ["id", "w"])


def split_runs(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """runs (id, t: distinct runs of letters) as t and the words it is split
    into by the unigrams of counts (w, n)."""
    met = counts.agg(F.sum("n")).first()[0] or 0

    def split(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in slices(batch):
                rows = part.to_pylist()
                # a run's own parts are all that its split can use, so other runs' words change nothing
                logp = unigrams({k["w"]: k["n"] for r in rows for k in r["known"] or ()}, met)
                words = pa.array([segment(r["t"], logp) for r in rows], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([r["t"] for r in rows], pa.string()), words], ["t", "words"])

    known = runs.mapInArrow(_parts_of, "id bigint, w string").join(counts, "w")
    known = known.groupBy("id").agg(F.collect_list(F.struct("w", "n")).alias("known"))
    return runs.join(known, "id", "left").select("t", "known").mapInArrow(split, "t string, words array<string>")


def count_decided(parts: DataFrame, split: DataFrame, rules) -> DataFrame:
    """Words (w) of the urls that a rule decides, by distinct hosts, without the
    words of the rules: counts in blocked (bad) and in allowed (good) urls."""
    own = sorted({t for _, h, p in rules for t in TOKEN.findall(f"{h} {p}".lower())})
    tokens = parts.filter("verdict is not null").select("verdict", "host", F.explode(_runs(F.concat_ws(" ", "host", "path"))).alias("t"))
    tokens = tokens.filter(~F.col("t").isin(own)).distinct().groupBy("verdict", "t").agg(F.count(F.lit(1)).alias("n"))
    words = tokens.join(split, "t").select("verdict", "n", F.explode(F.array_distinct("words")).alias("w")).filter(~F.col("w").isin(own))
    of = lambda kind: F.sum(F.when(F.col("verdict") == kind, F.col("n")).otherwise(0))
    return words.groupBy("w").agg(of("block").alias("bad"), of("allow").alias("good"))


def word_weights(seen: DataFrame, bad: list[str], good: list[str]) -> DataFrame:
    """Multinomial naive Bayes, add-one smoothed: of each word (w) how much it
    adds to the log odds of the unwanted class (weight). Other words are as
    likely under either class and cancel out. The lists are prior counts; seen
    has the words counted in either class (w, bad, good), and the larger class
    is scaled to the smaller: how often rules block says nothing of other urls."""
    prior = {w: [0.0, 0.0] for w in sorted({*bad, *good})}
    for side, words in enumerate((bad, good)):
        for i, w in enumerate(words):
            prior[w][side] += 2.0 + 20.0 / (i + 10)
    sums = seen.agg(F.sum("bad"), F.sum("good"), F.count(F.when(~F.col("w").isin(sorted(prior)), 1))).first()
    mass, vocabulary = [x or 0 for x in sums[:2]], len(prior) + sums[2]
    listed = seen.sparkSession.createDataFrame([(w, *p) for w, p in prior.items()], "w string, prior_bad double, prior_good double")

    def log(side: int, name: str):
        scale = min(mass) / max(1, mass[side])
        total = mass[side] * scale + sum(p[side] for p in prior.values()) + vocabulary
        count = F.coalesce(F.col(name), F.lit(0)) * F.lit(scale) + F.coalesce(F.col(f"prior_{name}"), F.lit(0.0))
        return F.log((count + 1.0) / F.lit(float(total)))

    return seen.join(listed, "w", "full").select("w", (log(0, "bad") - log(1, "good")).alias("weight"))


def judge(parts: DataFrame, row: str, split: DataFrame, weights: DataFrame, prior_bad: float = 0.2, threshold: float = 0.5) -> DataFrame:
    """Adds words and bad_score to a frame with host and path, and row to tell its rows."""
    each = split.select("t", F.posexplode("words").alias("i", "w")).join(weights, "w", "left")
    words = F.sort_array(F.collect_list(F.struct("i", "w", F.coalesce("weight", F.lit(0.0)).alias("weight"))))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda z, x: z + x["weight"])
    runs = each.groupBy("t").agg(words.alias("x")).select("t", F.array_join("x.w", " ").alias("w"), add(F.col("x")).alias("weight"))
    text = F.concat_ws(" ", "host", "path")
    found = parts.select(row, F.posexplode(_runs(text, f"{LETTERS}|[0-9]+")).alias("i", "t")).join(runs, "t", "left")
    found = found.select(row, F.struct("i", F.coalesce("w", "t").alias("w"), F.coalesce("weight", F.lit(0.0)).alias("weight")).alias("x"))
    found = found.groupBy(row).agg(F.sort_array(F.collect_list("x")).alias("__x"))
    # the sum is taken in the words' order: the same to the last bit whatever the partitions
    z = F.lit(math.log(prior_bad / (1 - prior_bad))) + F.coalesce(add(F.col("__x")), F.lit(0.0))
    score = 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))
    joined = parts.join(found, row, "left")
    joined = joined.select(*parts.columns, F.coalesce(F.array_join("__x.w", " "), F.lit("")).alias("words"), score.alias("bad_score"))
    return joined.withColumn("unwanted", F.col("bad_score") >= threshold)


def split_url(url):
    """Columns host and path of a url column."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.when(has, lower).otherwise(""), F.when(has, path).otherwise("")


def match_rule(host, path, rules=RULES):
    """The longest rule (as host and path text) that fits, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a later, longer one wins
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def filter_urls(df: DataFrame, url_col: str = "url", keep: tuple[str, ...] = (), rules=RULES, texts: DataFrame | None = None) -> DataFrame:
    """keep columns, host, path, rule, verdict, words, bad_score. Words are
    counted over df's urls and texts (text)."""
    host, path = split_url(F.col(url_col))
    row = fresh(df, "__r")
    parts = df.select(*keep, host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias(row))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    parts = materialize(parts.withColumns({"rule": rule, "verdict": verdict}), "urls")
    counts = materialize(word_counts(parts, texts), "words")
    runs = parts.select(F.explode(_runs(F.concat_ws(" ", "host", "path"))).alias("t")).distinct()
    runs = materialize(runs.select(F.monotonically_increasing_id().alias("id"), "t"), "runs")
    split = materialize(split_runs(runs, counts), "split")
    discard(counts, runs)
    seen = materialize(count_decided(parts, split, rules), "seen")
    judged = judge(parts, row, split, word_weights(seen, UNWANTED, WANTED + COMMON))
    model = F.when(F.col("unwanted"), "block").otherwise("allow")
    return judged.select(*keep, "host", "path", "rule", F.coalesce("verdict", model).alias("verdict"), "words", "bad_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of op7: one per page."""
    texts = table(spark, sf_dir, "documents").select("text")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), keep=("page_id",), texts=texts)
