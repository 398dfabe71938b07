"""Operator 8: repeated runs of lines, by a suffix order of line ids.

Every text is a sequence of line ids (128-bit hashes of its non-blank lines;
words are those of the shared pattern WORD). A run of lines is repeated if it
occurs at an earlier place too, in the order of (doc_id, text hash, line). All
later copies of repeated runs of `min_words` words or more are deleted; the
first copy stays, and so do repeated runs that are shorter.

1. Only lines that occur twice can lie in a repeated run, so the corpus shrinks
   to stretches of those, of min_words words at least.
2. Distributed prefix doubling: rank r_k orders the places by their first 2^k
   lines. r_0 sorts the line ids; r_k+1 sorts the pairs (r_k at p, r_k at
   p + 2^k). Sorting is by range exchange of the distinct pairs, each partition
   numbered on its own (ids ascend with the order), so no task sees all. Places
   whose prefix occurs once leave the order.
3. Places that share a prefix are an interval of the suffix order. From every
   place the shortest run of min_words words forward, and the shortest that
   ends there, are looked up in it: two overlapping r_k give any length. A run
   of min_words or more with an earlier copy is exactly covered by these
   shortest runs (for any line of it, one of the two lies within the run), so
   the union of those with an earlier copy is the union of the maximal repeated
   runs. They hold at most min_words lines: log2(min_words) rounds suffice for
   texts of any length.

Everything is built-in DataFrame operations. Intervals are reduced to their
first place by partial aggregation, so a passage in a third of all texts meets
in no task; the texts themselves move once, when the deletions are joined back.
Joins are sort-merge joins whatever the size: a small table is joined as a large
one will be, so its shuffles tell those of the large one, and nothing is broadcast.

Defined edge cases: null text stays null, empty text empty; rows of one doc_id
and text are one document and get one result; null doc_ids order last; a text
whose lines all go becomes ''; blank lines stay where they are and don't break
a run; extra columns are kept whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plait.llm.common import WORD, materialize, table

_PLACE = ("doc_id", "row_hash")


def _lines(text: Column) -> Column:
    """Non-blank lines as structs (i: number of the line, x: the line)."""
    every = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    return F.filter(every, lambda s: s["x"].rlike(r"[^\x20\x09-\x0D]"))


def _ordered_ids(keys: DataFrame, cols: list[str], name: str) -> DataFrame:
    """Distinct keys with ids that ascend in their order, without one task for all."""
    return materialize(keys.orderBy(*cols).withColumn(name, F.monotonically_increasing_id()), "ranks")


def _stretches(df: DataFrame, min_words: int) -> DataFrame:
    """Places of lines that occur twice, in stretches without a gap of min_words
    words: doc_id, row_hash, pos, line, r0, and first and last place of the
    shortest runs forward (to) and backward (since); null if there is none."""
    text = F.col("text")
    lines = df.filter("text is not null").select("doc_id", F.xxhash64(text).alias("row_hash"), F.posexplode(_lines(text)).alias("pos", "s"))
    x = F.col("s.x")
    lines = lines.select(
        "doc_id", "row_hash", "pos", F.col("s.i").alias("line"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"),
        F.regexp_count(x, F.lit(f"{WORD}+")).cast("long").alias("w"),
    )
    lines = materialize(lines, "lines")
    again = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a", "b")
    ids = _ordered_ids(again, ["a", "b"], "r0")
    active = lines.join(ids.hint("merge"), ["a", "b"]).select("doc_id", "row_hash", "pos", "line", "w", "r0").distinct()
    doc = Window.partitionBy(*_PLACE)
    runs = active.withColumn("seg", F.col("pos") - F.row_number().over(doc.orderBy("pos")))
    seg = Window.partitionBy(*_PLACE, "seg")
    runs = runs.withColumn("c", F.sum("w").over(seg.orderBy("pos"))).withColumn("b", F.col("c") - F.col("w"))
    runs = runs.withColumn("total", F.sum("w").over(seg)).filter(F.col("total") >= min_words)
    ahead = seg.orderBy("b").rangeBetween(0, min_words - 1)
    behind = seg.orderBy("c").rangeBetween(1 - min_words, 0)
    runs = runs.withColumn("to", F.when(F.max("c").over(ahead) - F.col("b") >= min_words, F.max("pos").over(ahead)))
    runs = runs.withColumn("since", F.when(F.col("c") - F.min("b").over(behind) >= min_words, F.min("pos").over(behind)))
    return materialize(runs.select(*_PLACE, "seg", "pos", "line", "r0", "to", "since"), "stretches")


def repeated_lines(df: DataFrame, min_words: int = 50) -> DataFrame:
    """From doc_id and text: doc_id, row_hash, gone (numbers of the lines to delete)."""
    places = _stretches(df, min_words)
    ahead = places.filter("`to` is not null").select(*_PLACE, F.col("pos").alias("p"), (F.col("to") - F.col("pos") + 1).alias("n"))
    behind = places.filter("since is not null").select(*_PLACE, F.col("since").alias("p"), (F.col("pos") - F.col("since") + 1).alias("n"))
    runs = materialize(ahead.union(behind).distinct(), "runs")
    longest = runs.agg(F.max("n")).first()[0] or 0
    ranks = places.select(*_PLACE, "pos", F.col("r0").alias("r"))
    later, k = None, 0
    while 1 << k <= longest:
        size = 1 << k
        mine = runs.filter((F.col("n") >= size) & (F.col("n") < 2 * size))
        start = ranks.select(*_PLACE, F.col("pos").alias("p"), F.col("r").alias("x"))
        end = ranks.select(*_PLACE, (F.col("pos") + size).alias("e"), F.col("r").alias("y"))
        keyed = _join(_join(mine, start, "p").withColumn("e", F.col("p") + F.col("n")), end, "e")
        place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row_hash", "p")
        keyed = materialize(keyed.select(*_PLACE, "p", "n", "x", "y", place.alias("place")), "keyed")
        first = materialize(keyed.groupBy("n", "x", "y").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1"), "first")
        part = keyed.join(first.hint("merge"), ["n", "x", "y"]).filter("place > first").select(*_PLACE, "p", "n")
        later = part if later is None else later.union(part)
        if 2 * size <= longest:
            nxt = ranks.select(*_PLACE, (F.col("pos") - size).alias("pos"), F.col("r").alias("s"))
            pairs = materialize(_join(ranks, nxt, "pos"), "pairs")
            twice = pairs.groupBy("r", "s").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("r", "s")
            ids = _ordered_ids(twice, ["r", "s"], "t")
            ranks = materialize(pairs.join(ids.hint("merge"), ["r", "s"]).select(*_PLACE, "pos", F.col("t").alias("r")), "order")
        k += 1
    if later is None:
        later = runs.select(*_PLACE, "p", "n").limit(0)
    cut = later.select(*_PLACE, F.explode(F.sequence("p", F.col("p") + F.col("n") - 1)).alias("pos")).distinct()
    lines = _join(cut, places.select(*_PLACE, "pos", "line"), "pos")
    return lines.groupBy(*_PLACE).agg(F.collect_set("line").alias("gone"))


def _join(a: DataFrame, b: DataFrame, *cols: str, how: str = "inner") -> DataFrame:
    """a with b by place (null doc_ids are equal) and cols."""
    b = b.withColumnsRenamed({c: f"__{c}" for c in (*_PLACE, *cols)})
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) if c == "doc_id" else F.col(c) == F.col(f"__{c}") for c in (*_PLACE, *cols)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return a.join(b.hint("merge"), cond, how).drop(*[f"__{c}" for c in (*_PLACE, *cols)])


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """df with the text cut, then __n_lines and __n_removed (non-blank lines)."""
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    gone = materialize(repeated_lines(src, min_words), "gone")
    rows = df.select(F.struct("*").alias("__row"), F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row_hash"))
    out = _join(rows, gone, how="left")
    text = F.col(f"__row.`{text_col}`")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("gone", i)), "\n")
    cut = F.when(F.col("gone").isNull(), text).when(F.size("gone") == F.size(_lines(text)), "").otherwise(kept)
    return out.select(
        *[cut.alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in df.columns],
        F.size(_lines(F.coalesce(text, F.lit("")))).alias("__n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("__n_removed"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of op8: one per document."""
    got = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.col("__n_lines").cast("long").alias("n_lines"), F.col("__n_removed").cast("long").alias("n_removed"), "text")
