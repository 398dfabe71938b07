"""Operator 6: benchmark decontamination by BM25 with block-max pruning.

The test items are indexed as units: the whole item, and its question and its
answer where they have `least_half` words (a shorter one, such as a name, is no
evidence by itself). The index has an impact for each term of each unit, in
blocks of units. Every passage of every training text (windows of 2 L words,
one each L words, L the longest unit of the index shard, so a unit lies whole
in one) is a query that retrieves all units above the unit's own threshold. As
in WAND, sums of block maxima are upper bounds: over the essential (rare)
terms, with the most that a unit's other terms can add; only blocks that may
reach a threshold are scored. The bounds are summed sparsely for many passages
at once by numpy. Hits are verified by 5-word shingles: an item leaks where 0.8
of the shingles of one of its units, so of all of it, of its question or of its
answer, lie in one passage. Words are folded to lower case (all scripts) and
parted at white space.

A unit's threshold is its own score less its floor(0.2 m) largest impacts (m
its shingles): a passage that holds 0.8 of the shingles misses no more words
than that, so retrieval loses nothing that verification would keep.

The index grows with the test items alone. They are cut in shards of at most
`shard` items by length class and id; one pass over the texts searches the
shards of `per_pass` items, all there mostly are. The texts are never shuffled.

Defined edge cases: null or empty texts leak nothing; an item without words
never is found; an item of 1 to 4 words has its whole sequence as one shingle,
found only as a text of just those words or by its longer form's shingles;
repeated rows of a text each give their rows; items that repeat an id are
separate items; a null doc_id is carried along; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plait.llm.common import release, slices, table
from plait.llm.textvec import U, Words, batches, grams

_BLOCK = 16
#: Bounds summed at once.
_HITS = 1 << 20


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the last line if there are several, else the last sentence."""
    for mark in ("\n", ". ", "? "):
        head, _, tail = text.rstrip().rpartition(mark)
        if head.split() and tail.split():
            return head, tail
    return text, ""


def folded(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def _spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


class Index:
    """Impacts of the terms of the units of some items, with block maxima."""

    def __init__(self, items: list[tuple[int, str]], k1: float = 1.2, b: float = 0.75, k: int = 5, share: float = 0.8, least_half: int = 13):
        items = sorted((i, t) for i, t in items if t and t.split())
        self.ids, self.k, self.share = [i for i, _ in items], k, share
        units: list[tuple[int, int, int, str]] = []  # words, item, kind (whole, question, answer), text
        for i, (_, t) in enumerate(items):
            units.append((len(t.split()), i, 0, t))
            units += [(len(x.split()), i, 1 + side, x) for side, x in enumerate(split_item(t)) if len(x.split()) >= least_half]
        units.sort()
        self.unit_item = np.array([u[1] for u in units], np.int64)
        w = Words([folded(u[3]) for u in units])
        h = w.hashes()
        n_units, length = len(units), np.diff(w.first)
        self.window = int(length.max()) if n_units else 1
        g, at = grams(h, w.first, k)
        self.shingles = [np.unique(g[at[u] : at[u + 1]]) for u in range(n_units)]
        # the shares that are reported, of halves too short to be units too
        self.parts = [[], [], []]
        for side, texts in enumerate(([t for _, t in items], *zip(*[split_item(t) for _, t in items], strict=True)) if items else ()):
            v = Words([folded(x) for x in texts])
            q, qa = grams(v.hashes(), v.first, k)
            self.parts[side] = [np.unique(q[qa[i] : qa[i + 1]]) for i in range(len(items))]
        # (unit, term) with its number of occurrences
        self.terms, term = np.unique(h, return_inverse=True)
        n_terms = max(1, len(self.terms))
        pair, tf = np.unique(w.doc.astype(np.int64) * n_terms + term, return_counts=True)
        unit, term = pair // n_terms, pair % n_terms
        df = np.bincount(term, minlength=n_terms)
        idf = np.log1p((n_units - df + 0.5) / (df + 0.5))
        norm = k1 * (1 - b + b * length / max(1.0, length.mean() if n_units else 1.0))
        impact = idf[term] * tf * (k1 + 1) / (tf + norm[unit])
        order = np.lexsort((-impact, unit))
        begin = np.searchsorted(unit, np.arange(n_units + 1))
        run = np.concatenate([[0.0], np.cumsum(impact[order])])
        m = np.fromiter(map(len, self.shingles), np.int64, n_units)
        lost = m - np.array([math.ceil(share * x - 1e-9) for x in m.tolist()], np.int64) if n_units else m
        self.threshold = run[begin[1:]] - run[np.minimum(begin[:-1] + lost, begin[1:])]
        scaled = impact / np.maximum(self.threshold[unit], 1e-9)
        # terms of more than a twentieth of the units are not essential
        rare = df <= max(2, n_units // 20)
        rest = np.bincount(unit, weights=np.where(rare[term], 0.0, scaled), minlength=n_units)
        block = np.arange(n_units) // _BLOCK
        self.n_blocks = n_units // _BLOCK + 1
        # postings by block: all of a block's are scored at once
        self.unit, self.term, self.weight = unit, term, scaled
        self.at = np.searchsorted(unit // _BLOCK, np.arange(self.n_blocks + 1))
        # block maxima of the essential terms; need: what they must reach in a block
        e = np.flatnonzero(rare[term])
        key, inv = np.unique(term[e] * self.n_blocks + block[unit[e]], return_inverse=True)
        top = np.zeros(len(key))
        np.maximum.at(top, inv, scaled[e])
        self.e_block, self.e_top = key % self.n_blocks, top
        self.e_at = np.searchsorted(key // self.n_blocks, np.arange(n_terms + 1))
        most = np.zeros(self.n_blocks)
        np.maximum.at(most, block, rest)
        self.need = 1.0 - most - 1e-9
        self.always = np.flatnonzero((self.need <= 0) & (np.diff(self.at) > 0))

    def _open(self, t: np.ndarray, stride: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Windows (number of their first stride) with the blocks that may reach a threshold in them."""
        n = self.e_at[t + 1] - self.e_at[t]
        total = np.cumsum(n)
        i = done = 0
        while i < len(t):
            # the windows that begin before a stride: their words, and those of one stride more
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + _HITS)))
            stop = int(stride[min(j, len(t) - 1)]) + (j >= len(t))
            if stop <= stride[i]:
                stop = int(stride[i]) + 1
            last = int(np.searchsorted(stride, stop, "right"))
            first = max(done, int(stride[i]) - 1)
            k = n[i:last]
            spot = _spans(self.e_at[t[i:last]], k)
            s, b = np.repeat(stride[i:last], k), self.e_block[spot]
            cell = np.concatenate([s * self.n_blocks + b, (s - 1) * self.n_blocks + b])
            weight = np.concatenate([self.e_top[spot]] * 2)
            order = np.argsort(cell, kind="stable")
            cell, weight = cell[order], weight[order]
            edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
            bound = np.add.reduceat(weight, edge) if len(edge) else np.zeros(0)
            cell = cell[edge]
            hit = (bound >= self.need[cell % self.n_blocks]) & (cell // self.n_blocks < stop) & (cell // self.n_blocks >= first)
            cell = cell[hit]
            if len(self.always):
                here = np.unique(np.concatenate([stride[i:last], stride[i:last] - 1]))
                here = here[(here >= first) & (here < stop)]
                cell = np.unique(np.concatenate([cell, (here[:, None] * self.n_blocks + self.always).ravel()]))
            window, blocks = cell // self.n_blocks, cell % self.n_blocks
            edge = [*np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]])), len(window)] if len(window) else []
            for a, z in pairwise(edge):
                yield int(window[a]), blocks[a:z]
            i, done = int(np.searchsorted(stride, stop)), stop

    def search(self, texts: list[bytes | None]) -> list[tuple[int, int, float, float, float, float]]:
        """(text, item's position, score as a share of its unit's threshold,
        shares of the shingles of item, question and answer found), best passage each."""
        w = Words(texts)
        h = w.hashes()
        if not len(h) or not self.ids:
            return []
        t = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        at = np.flatnonzero(self.terms[t] == h)
        t = t[at]
        # strides of L words, numbered through; a gap between texts, so no window joins two
        L = self.window
        base = np.concatenate([[0], np.cumsum(np.diff(w.first) // L + 3)])
        doc = w.doc[at]
        stride = (at - w.first[doc]) // L + base[doc] + 1  # window j holds strides j and j + 1
        found: dict[tuple[int, int], tuple] = {}
        mark = np.zeros(len(self.terms), bool)
        for j, blocks in self._open(t, stride):
            terms = t[np.searchsorted(stride, j) : np.searchsorted(stride, j + 1, "right")]
            if not len(terms):
                continue
            mark[terms] = True
            spot = _spans(self.at[blocks], self.at[blocks + 1] - self.at[blocks])
            spot = spot[mark[self.term[spot]]]
            mark[terms] = False
            score = np.bincount(self.unit[spot], weights=self.weight[spot])
            units = np.flatnonzero(score >= 1 - 1e-9)
            if not len(units):
                continue
            d = int(np.searchsorted(base, j, "right")) - 1
            lo, hi = int(w.first[d]), int(w.first[d + 1])
            s, e = lo + max(0, j - int(base[d]) - 1) * L, min(hi, lo + (j - int(base[d]) + 1) * L)
            if e - s < self.k and hi - lo > e - s:
                continue
            here, _ = grams(h[s:e], np.array([0, e - s]), self.k)
            for u in units:
                if np.isin(self.shingles[u], here).mean() < self.share - 1e-9:
                    continue
                i = int(self.unit_item[u])
                part = [float(np.isin(x[i], here).mean()) if len(x[i]) else 0.0 for x in self.parts]
                row = (max(part), part[0], float(score[u]), part[1], part[2])
                found[d, i] = max(found.get((d, i), row), row)
        return [(d, i, s, p, q, a) for (d, i), (_, p, s, q, a) in sorted(found.items())]


def _shards(items: DataFrame, shard: int) -> Iterator[list[tuple[int, str]]]:
    """The items in bounded lists, by length class (a power of 2 of words) and hash."""
    words = F.size(F.split("text", r"[\x20\x09-\x0D]+"))
    keyed = items.filter("text is not null").withColumn("c", F.ceil(F.log2(F.greatest(words, F.lit(16)))))
    for c, n in sorted((r["c"], r["count"]) for r in keyed.groupBy("c").count().collect()):
        parts = -(-n // shard)
        for i in range(parts):
            mine = keyed.filter((F.col("c") == c) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i))
            yield [(r["item_id"], r["text"]) for r in mine.select("item_id", "text").collect()]


def _passes(items: DataFrame, shard: int, per_pass: int, **how) -> Iterator[list[Index]]:
    """Indexes of the items, as many at once as one pass over the texts searches."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    now: list[Index] = []
    for some in _shards(items, shard):
        if now and sum(len(x.ids) for x in now) + len(some) > per_pass:
            yield now
            now = []
        now.append(Index(some, **how))
    if now:
        yield now


_OUT = "doc_id bigint, row_hash bigint, item_id bigint, score double, overlap double, question double, answer double"


def find_leaks(docs: DataFrame, items: DataFrame, share: float = 0.8, k: int = 5, least_half: int = 13, shard: int = 20_000, per_pass: int = 200_000) -> DataFrame:
    """One row per text and item found in it: doc_id, row_hash, item_id, score
    (BM25 as a share of the unit's threshold), overlap, question, answer."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("row_hash"))
    spark, out = docs.sparkSession, None
    for indexes in _passes(items, shard, per_pass, k=k, share=share, least_half=least_half):
        sent = spark.sparkContext.broadcast(indexes)

        def run(source: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for whole in source:
                for b in slices(whole):
                    ids, texts, keys = b.column(0).to_pylist(), [folded(x) for x in b.column(1).to_pylist()], b.column(2).to_pylist()
                    rows = []
                    for part in batches(texts):
                        for index in sent.value:
                            rows += [(ids[part.start + d], keys[part.start + d], index.ids[i], s, p, q, a) for d, i, s, p, q, a in index.search(texts[part])]
                    if rows:
                        kinds = [pa.int64()] * 3 + [pa.float64()] * 4
                        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _OUT.split(", ")])
            release()

        got = src.mapInArrow(run, _OUT)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], _OUT)


def _leaks(sent):
    @F.arrow_udf("boolean")
    def leaks(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            hit = np.zeros(len(texts), bool)
            for i in range(0, len(texts), 512):
                raw = [folded(x) for x in texts.slice(i, 512).to_pylist()]
                for part in batches(raw):
                    for index in sent.value:
                        hit[[i + part.start + r[0] for r in index.search(raw[part])]] = True
            yield pa.array(hit)
        release()

    return leaks


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", share: float = 0.8, k: int = 5, least_half: int = 13, shard: int = 20_000, per_pass: int = 200_000) -> DataFrame:
    """docs without the rows whose text holds an item, or a half of one. No join: a pass is a filter."""
    for indexes in _passes(items, shard, per_pass, k=k, share=share, least_half=least_half):
        docs = docs.filter(~_leaks(docs.sparkSession.sparkContext.broadcast(indexes))(F.col(text_col).cast("string")))
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of op6: one per document and benchmark item that leaks in it."""
    got = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "item_id", *[F.round(c, 6).alias(c) for c in ("score", "overlap", "question", "answer")])
