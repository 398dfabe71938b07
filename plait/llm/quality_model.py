"""Operator 10: quality classifier, histogram gradient-boosted trees.

Each whole text is turned into statistics (lengths, byte classes, repetition)
by numpy over batches of texts. Trees are grown on at most `sample` labelled
rows (those with the least hashes of their doc_id, so the sample is the same on
every run and needs no pass in one task), with logistic loss over quantile
bins. A trained model is four arrays; scoring walks all trees of a batch of
documents level by level, no tree or row at a time in Python, and the model
(some tens of KB) travels with the function. Nothing is shuffled to score.

Defined edge cases: null text counts as empty, and an empty text is scored like
any other; without labels every score is 0.5, with one class only the (smoothed)
share of label 1; labels without a quality, or of a null doc_id, teach nothing;
a doc_id with several labels or texts teaches each; repeated rows each get the
same result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plait.llm.common import fold, slices, table
from plait.llm.textvec import U, Words, batches, mix

#: Classes of bytes, each a feature as a share of the bytes that aren't white space.
_CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&", b"|<>{}[]\\^~_=+", b"!?", b".", b",;:", b"\"'()-/@`",
    bytes(range(128, 256)),
)
FEATURES = (
    "log_words", "log_lines", "word_bytes", "short_words", "long_words", "distinct_words", "next_same", "top_word",
    "words_per_line", "distinct_lines", *[f"class_{i}" for i in range(len(_CLASSES))],
)


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """A row of FEATURES for each text; shares are of 0 where there is nothing."""
    w = Words(texts, lower=False)
    n_docs, h = len(texts), w.hashes()
    n = np.diff(w.first).astype(float)
    one = np.maximum(n, 1.0)
    size = (w.end - w.start).astype(float)

    def per_doc(values: np.ndarray) -> np.ndarray:
        return np.bincount(w.doc, weights=values, minlength=n_docs)

    total = per_doc(size)
    order = np.argsort(mix(h ^ (w.doc.astype(U) * U(0x9E3779B97F4A7C15))), kind="stable")
    hs, ds = h[order], w.doc[order]
    new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])]) if len(hs) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    times = np.diff(np.concatenate([at, [len(hs)]]))
    distinct = np.bincount(ds[at], minlength=n_docs)
    top = np.zeros(n_docs)
    np.maximum.at(top, ds[at], times)
    same = np.zeros(len(h))
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    breaks = np.flatnonzero(w.buf == 10)
    line_of = np.searchsorted(breaks, w.start)
    if len(h):  # a line's hash: the sum of its words' hashes
        first = np.flatnonzero(np.concatenate([[True], line_of[1:] != line_of[:-1]]))
        line_hash, line_doc = np.add.reduceat(mix(h), first), w.doc[first]
        lines = np.bincount(line_doc, minlength=n_docs)
        pair = np.unique(np.stack([line_doc.astype(U), line_hash]), axis=1)[0].astype(np.int64)
        distinct_lines = np.bincount(pair, minlength=n_docs)
    else:
        lines = distinct_lines = np.zeros(n_docs, np.int64)
    some_lines = np.maximum(lines, 1)
    cols = [
        np.log1p(n), np.log1p(lines), total / one, per_doc(size <= 3) / one, per_doc(size > 20) / one, distinct / one,
        per_doc(same) / one, top / one, n / some_lines, distinct_lines / some_lines,
    ]
    for chars in _CLASSES:
        flag = np.zeros(256, np.int64)
        flag[list(chars)] = 1
        run = np.concatenate([[0], np.cumsum(flag[w.buf])])
        cols.append((run[w.at[1:]] - run[w.at[:-1]]) / np.maximum(total, 1.0))
    return np.stack(cols, axis=1)


class Trees:
    """Perfect binary trees of one depth in flat arrays: feature and threshold
    of the inner nodes, value of the leaves. An unsplit node sends all left."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            z += v[at - inner]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Gradient boosting with logistic loss over histograms of quantile bins."""
    p0 = (y.sum() + 1.0) / (len(y) + 2.0)
    base = float(np.log(p0 / (1 - p0)))
    inner = 2**depth - 1
    if len(y) < 2 or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    n_feat = x.shape[1]
    z = np.full(len(y), base)
    all_f, all_t, all_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            cut = np.full(width, -1)
            which = np.zeros(width, np.int64)
            for j in range(n_feat):
                key = (at - first) * bins + binned[:, j]
                g = np.bincount(key, grad, width * bins).reshape(width, bins).cumsum(1)
                h = np.bincount(key, hess, width * bins).reshape(width, bins).cumsum(1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
                gain[(h < least / 4) | (ht - h < least / 4)] = 0.0
                gain[:, len(edges[j]) :] = 0.0
                k = gain.argmax(1)
                got = gain[np.arange(width), k]
                better = got > best
                best[better], cut[better], which[better] = got[better], k[better], j
            for i in np.flatnonzero(cut >= 0):
                feature[first + i], threshold[first + i] = which[i], edges[which[i]][cut[i]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        g = np.bincount(at - inner, grad, inner + 1)
        h = np.bincount(at - inner, hess, inner + 1)
        value = rate * g / (h + ridge)
        z += value[at - inner]
        all_f.append(feature)
        all_t.append(threshold)
        all_v.append(value)
    return Trees(base, np.array(all_f), np.array(all_t), np.array(all_v))


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, **how) -> Trees:
    """Trees grown on at most `sample` rows of labels (doc_id, y) joined to docs (doc_id, text)."""
    some = labels.filter("doc_id is not null and y is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(some.select(F.col("doc_id").alias("__id"), "y")), F.col("doc_id") == F.col("__id"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in source:
            for b in slices(whole):
                texts = _texts(b, "text")
                for part in batches(texts):
                    n = part.stop - part.start
                    x = statistics(texts[part])
                    cols = [b.column("doc_id").slice(part.start, n), pa.array(x.tolist(), pa.list_(pa.float64())), b.column("y").slice(part.start, n)]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "x", "y"])

    got = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("y").cast("double").alias("y")).mapInArrow(run, "doc_id bigint, x array<double>, y double")
    # rows that repeat a doc_id count towards the bound too
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", "x", "y").limit(sample).collect()
    got.sort(key=lambda r: (r["x"], r["y"]))
    x = np.array([r["x"] for r in got], float).reshape(len(got), len(FEATURES))
    return grow(x, np.array([r["y"] for r in got], float), **how)


def score(docs: DataFrame, model: Trees, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs without the text, and the score of each."""
    keep = [c for c in docs.columns if c != text_col]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in source:
            for b in slices(whole):
                texts = _texts(b, text_col)
                got = [model.score(statistics(texts[part])) for part in batches(texts)]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(np.concatenate(got) if got else [], pa.float64())], [*keep, name])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text_col]
    return docs.mapInArrow(run, ", ".join([*fields, f"`{name}` double"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of op10: one per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    model = train(docs, labels.filter(fold(F.col("doc_id"), 4) != 2))
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    got = score(docs, model)
    return got.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
