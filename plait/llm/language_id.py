"""Operator 4: language identification by a linear-chain conditional random field.

Every word of a text is labelled. A word's features are its first and last
bytes (affixes), its byte 3-grams and the word itself (lexicon), each hashed to
a weight per language; learned transitions say how likely a text switches.
Forward-backward gives every word's probabilities within its whole text, and a
text's language is the one with the most letters in expectation. So a
code-switched text is read word by word.

Batches of texts are one chain whose links between texts are cut. The chain is
folded into blocks; a block's transfer matrix is a product of its links, the
blocks are joined in turn, and then all blocks step at once. This is exact for
a text of any length, with no Python step per word.

The model is learned on at most `per_language` whole documents of each language
(the least hashes of doc_id). They are cut in stretches of about `stretch`
words, and stretches of any languages are joined to chains, so switches are
seen and their transitions are learned like all else. The model is a few MB,
and travels to the executors as a broadcast. Scoring shuffles nothing.

Defined edge cases: a null text or one without a letter (a character of the
Unicode classes L) is `und` with score 0;
where no language can be learned all are `und`; with one language it has score
1; repeated rows each get the same result; a null doc_id is not held out and
teaches nothing; extra columns are not read, lang is read to learn only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plait.llm.common import fold, releasing, slices, table
from plait.llm.textvec import U, Words, batches

BITS = 16
_MASK = (1 << BITS) - 1


@cache
def _alphabet() -> np.ndarray:
    """Which characters are letters, as bits."""
    return np.packbits(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))


def letters(buf: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """1 at each byte of UTF-8 that begins a letter."""
    out = np.zeros(len(buf), np.int64)
    out[(buf >= 65) & (buf <= 90) | (buf >= 97) & (buf <= 122)] = 1
    lead = np.flatnonzero(buf >= 0xC2)
    if len(lead):
        b = np.concatenate([buf, np.zeros(3, buf.dtype)]).astype(np.int32)
        b0, b1, b2, b3 = b[lead], b[lead + 1] & 63, b[lead + 2] & 63, b[lead + 3] & 63
        two, three = (b0 & 31) << 6 | b1, (b0 & 15) << 12 | b1 << 6 | b2
        code = np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3))
        code = np.minimum(code, 0x10FFFF)
        out[lead] = alphabet[code >> 3] >> (7 - (code & 7)) & 1
    return out


def _grams(buf: np.ndarray) -> np.ndarray:
    """Hash of the 3 bytes that start at each place."""
    b = np.concatenate([buf, np.zeros(2, buf.dtype)]).astype(np.uint32)
    h = b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - BITS)).astype(np.int64)


class Features:
    """Of the words of some texts: hashed indices of the word itself, its first
    and last bytes; and of the 3-grams that begin in it (with its edges)."""

    def __init__(self, texts: list[bytes | None]):
        w = self.words = Words(texts)
        edged = w.buf.copy()
        edged[(edged >= 9) & (edged <= 13)] = 32
        self.grams = _grams(edged)
        lex = (w.hashes() >> U(64 - BITS)).astype(np.int64)
        head = np.minimum(w.start + 3, w.end) - w.start
        first = self.grams[w.start]
        last = self.grams[np.maximum(w.end - 3, w.start)]
        span = 1 << BITS
        self.single = np.stack([lex, span + (first ^ head), 2 * span + (last ^ head) % span])
        before = np.maximum(w.start - 1, 0)
        self.lo, self.hi = before, w.end - 1  # 3-grams from the byte before a word to its last byte

    def emit(self, weight: np.ndarray) -> np.ndarray:
        """Score of each language for each word; weight: (4 << BITS, languages)."""
        out = weight[self.single[0]] + weight[self.single[1]] + weight[self.single[2]]
        tail = weight[3 << BITS :]
        for j in range(weight.shape[1]):
            run = np.concatenate([[0.0], np.cumsum(tail[self.grams, j])])
            out[:, j] += run[self.hi + 1] - run[self.lo]
        return out

    def back(self, residual: np.ndarray, size: int) -> np.ndarray:
        """Gradient of the weights, from that of the scores."""
        out = np.zeros((size, residual.shape[1]))
        n = self.hi + 1 - self.lo
        place = np.repeat(self.lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        grams = (3 << BITS) + self.grams[place]
        for j in range(residual.shape[1]):
            r = residual[:, j]
            for s in self.single:
                out[:, j] += np.bincount(s, r, size)
            out[:, j] += np.bincount(grams, np.repeat(r, n), size)
        return out


def forward_backward(emit: np.ndarray, start: np.ndarray, first: np.ndarray, trans: np.ndarray, block: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (words, languages) of a chain; start: flags of words that begin
    a text; first, trans: probabilities of a text's first label and of steps.
    Also the expected starts, and the expected steps by pair of labels."""
    n, k = emit.shape
    if not n:
        return emit, np.zeros(k), np.zeros((k, k))
    rows = -(-n // block)
    e = np.ones((rows * block, k))
    e[:n] = np.exp(emit - emit.max(1, keepdims=True))
    cut = np.ones(rows * block, bool)
    cut[:n] = start
    e, cut = e.reshape(rows, block, k), cut.reshape(rows, block)

    def step(a: np.ndarray, t: int) -> np.ndarray:  # a: (rows, ..., k) times the link to t
        c = cut[:, t].reshape(-1, *[1] * (a.ndim - 1))
        b = np.where(c, a.sum(-1, keepdims=True) * first, a @ trans) * (e[:, t] if a.ndim == 2 else e[:, t][:, None])
        return b / b.sum(axis=tuple(range(1, b.ndim)), keepdims=True)

    through = np.broadcast_to(np.eye(k), (rows, k, k))
    for t in range(block):
        through = step(through, t)
    ahead, behind = np.empty((rows, k)), np.empty((rows, k))
    a = first / first.sum()
    for r in range(rows):
        ahead[r] = a
        a = a @ through[r]
        a = a / a.sum()
    b = np.ones(k) / k
    for r in range(rows - 1, -1, -1):
        behind[r] = b
        b = through[r] @ b
        b = b / b.sum()
    alpha, beta = np.empty_like(e), np.empty_like(e)
    a = ahead
    for t in range(block):
        a = alpha[:, t] = step(a, t)
    b = behind
    for t in range(block - 1, -1, -1):
        beta[:, t] = b
        x = e[:, t] * b
        b = np.where(cut[:, t][:, None], (x * first).sum(-1, keepdims=True), x @ trans.T)
        b = b / b.sum(-1, keepdims=True)
    alpha, beta, e = (x.reshape(-1, k)[:n] for x in (alpha, beta, e))
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    inner = np.flatnonzero(~start[1:])
    pair = alpha[inner][:, :, None] * trans * (e[inner + 1] * beta[inner + 1])[:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    return gamma, gamma[start].sum(0), pair.sum(0)


class Crf:
    def __init__(self, languages: list[str], weight: np.ndarray, first: np.ndarray, trans: np.ndarray):
        self.languages, self.weight, self.first, self.trans = languages, weight, first, trans
        self.alphabet = _alphabet()

    def marginals(self, texts: list[bytes | None]) -> tuple[Words, np.ndarray]:
        f = Features(texts)
        start = np.zeros(len(f.words), bool)
        start[f.words.first[:-1][np.diff(f.words.first) > 0]] = True
        return f.words, forward_backward(f.emit(self.weight).astype(float), start, self.first, self.trans)[0]

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        if not self.languages:
            return ["und"] * n, np.zeros(n)
        words, gamma = self.marginals(texts)
        run = np.concatenate([[0], np.cumsum(letters(words.buf, self.alphabet))])
        count = run[words.end] - run[words.start]
        share = np.stack([np.bincount(words.doc, weights=gamma[:, j] * count, minlength=n) for j in range(gamma.shape[1])], 1)
        total = np.bincount(words.doc, weights=count, minlength=n)
        best = share.argmax(1)
        score = share[np.arange(n), best] / np.maximum(total, 1)
        return [self.languages[b] if t else "und" for b, t in zip(best, total, strict=True)], np.where(total > 0, np.clip(score, 0.0, 1.0), 0.0)


def learn(
    texts: list[bytes], langs: list[str], epochs: int = 3, batch: int = 400, stretch: int = 40, chain: int = 8, rate: float = 0.15, ridge: float = 1e-6, seed: int = 11
) -> Crf:
    """Conditional likelihood by AdaGrad on minibatches of `batch` stretches;
    every word of a stretch has its text's language, and `chain` stretches
    follow one another as one text that switches."""
    languages = sorted(set(langs))
    k, size = len(languages), 4 << BITS
    if not k:
        return Crf([], np.zeros((size, 0)), np.zeros(0), np.zeros((0, 0)))
    weight, seen = np.zeros((size, k)), np.full((size, k), 1e-8)
    first, trans = np.zeros(k), np.eye(k) * 2.0
    g_first, g_trans = np.full(k, 1e-8), np.full((k, k), 1e-8)
    rng = np.random.default_rng(seed)
    pieces, label = [], []
    for t, lang in zip(texts, langs, strict=True):
        words, i = t.split(), 0
        while i < len(words):
            n = int(rng.geometric(1.0 / stretch))
            pieces.append(b" ".join(words[i : i + n]))
            label.append(languages.index(lang))
            i += n
    label = np.array(label, np.int64)
    for _ in range(epochs if k > 1 else 0):
        order = rng.permutation(len(pieces))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            f = Features([pieces[j] for j in some])
            start = np.zeros(len(f.words), bool)
            start[f.words.first[:-1:chain]] = True
            gamma, starts, steps = forward_backward(f.emit(weight), start, np.exp(first), np.exp(trans))
            y = label[some][f.words.doc]
            scale = 1.0 / len(f.words)
            grad = f.back((np.eye(k)[y] - gamma) * scale, size) - ridge * weight
            seen += grad * grad
            weight += rate * grad / np.sqrt(seen)
            inner = np.flatnonzero(~start[1:])
            kept = np.bincount(y[inner] * k + y[inner + 1], minlength=k * k).reshape(k, k)
            d_first = (np.bincount(y[start], minlength=k) - starts) * scale
            d_trans = (kept - steps) * scale
            g_first += d_first**2
            g_trans += d_trans**2
            first += rate * d_first / np.sqrt(g_first)
            trans += rate * d_trans / np.sqrt(g_trans)
    return Crf(languages, weight.astype(np.float32), np.exp(first - first.max()), np.exp(trans - trans.max()))


def train(docs: DataFrame, per_language: int = 400, **how) -> Crf:
    """A model from docs (doc_id, text, lang): per_language documents of each language at most."""
    known = docs.select("doc_id", "text", "lang").filter("doc_id is not null and lang is not null and text is not null")
    # a share of each language by hash, a third more than asked for; then the least hashes
    parts, share = 1 << 19, F.lit(0)
    for r in known.groupBy("lang").count().collect():
        share = F.when(F.col("lang") == r["lang"], min(parts, -(-parts * (per_language * 4 // 3 + 20) // r["count"]))).otherwise(share)
    rows = known.withColumn("h", F.xxhash64("doc_id")).filter(F.pmod(F.col("h"), F.lit(parts)) < share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))
    got = rows.withColumn("rank", rank).filter(F.col("rank") <= per_language).select("lang", "h", "doc_id", "text").collect()
    got = sorted(tuple(r) for r in got)
    return learn([x[3].encode() for x in got], [x[0] for x in got], **how)


def identify(docs: DataFrame, model: Crf, text_col: str = "text") -> DataFrame:
    """docs without the text, with lang_pred and score."""
    keep = [c for c in docs.columns if c != text_col]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in source:
            for b in slices(whole):
                texts = b.column(text_col).cast(pa.binary()).to_pylist()
                langs, scores = [], []
                for part in batches(texts, 1 << 19):
                    x, s = sent.value.predict(texts[part])
                    langs += x
                    scores += s.tolist()
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text_col]
    return docs.mapInArrow(releasing(run), ", ".join([*fields, "lang_pred string, score double"]))


def language_of(model: Crf, spark: SparkSession):
    """A function of a text column: struct(lang_pred, score). Other columns stay in the JVM."""
    sent = spark.sparkContext.broadcast(model)

    def predict(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            langs, scores = [], []
            for i in range(0, len(texts), 512):
                raw = texts.slice(i, 512).cast(pa.binary()).to_pylist()
                for part in batches(raw, 1 << 19):
                    x, s = sent.value.predict(raw[part])
                    langs += x
                    scores += s.tolist()
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    each = releasing(predict)

    @F.arrow_udf("lang_pred string, score double")
    def of(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from each(it)

    return of


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of op4: one per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(fold(F.col("doc_id"), 3) != 1))
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
