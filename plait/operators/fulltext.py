"""Full-text search over token arrays: one scan, all predicates native.

A query text has terms, "phrases", prefix*, AND, OR, NOT (binary), NEAR(a b, n),
column : and -column : filters, ^first, one + two (a phrase) and parentheses; a
blank between terms is AND. A query may also be built from Term, Phrase, Prefix, Near and the operators & | and ~ (and not).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose, and their base letters."""
    a, b = [], []
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        d = unicodedata.normalize("NFD", chr(c))
        if len(d) > 1 and d[0].isascii():
            a.append(chr(c))
            b.append(d[0])
    return "".join(a), "".join(b)


_FROM, _TO = _accents()


@dataclass(frozen=True)
class Tokenizer:
    """unicode61 folds case and accents and parts at what is no letter or digit;
    ascii folds A-Z and parts at ASCII of that kind; porter stems unicode61's
    tokens; trigram gives runs of 3 characters; custom is any function of text
    to an array column."""

    kind: str = "unicode61"
    remove_diacritics: bool = True
    token_chars: str = ""
    separators: str = ""
    custom: Callable[[Column], Column] | None = None

    def tokens(self, text: Column, letters: str | None = None) -> Column:
        """letters: first letters of all words that are sought, if known; a stem
        keeps its word's, so other words need not be stemmed and come as ''."""
        text = F.coalesce(text, F.lit(""))
        if self.custom:
            return self.custom(text)
        if self.kind == "trigram":
            # one pass over the characters: a substring by position would start from the text's first one
            runs = lambda t: F.slice(F.transform(t, lambda x, i: F.concat(x, F.get(t, i + 1), F.get(t, i + 2))), F.lit(1), F.greatest(F.size(t) - 2, F.lit(0)))
            return F.flatten(F.transform(F.array(F.split(F.lower(text), "")), runs))
        extra = "".join(re.escape(c) for c in self.token_chars)
        if self.kind == "ascii":
            low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
            part = rf"[^a-z0-9\x{{80}}-\x{{10ffff}}{extra}]+"
        else:
            low = F.lower(text)
            if self.remove_diacritics:
                low = F.translate(low, _FROM, _TO)
            part = rf"[^\p{{L}}\p{{N}}\p{{Co}}{extra}]+"
        if self.separators:
            low = F.translate(low, self.separators, " " * len(self.separators))
        got = F.filter(F.split(low, part), lambda x: x != "")
        if self.kind != "porter":
            return got
        return stem(got if letters is None else F.transform(got, lambda x: F.when(F.substring(x, 1, 1).isin(*letters), x).otherwise("")))

    def one(self, text: str) -> list[str]:
        """Tokens of a query's words, on the driver (same rules)."""
        if self.kind == "trigram":
            t = text.lower()
            return [t[i : i + 3] for i in range(len(t) - 2)] or [t]
        t = text.lower()
        if self.kind != "ascii" and self.remove_diacritics:
            t = t.translate(str.maketrans(_FROM, _TO))
        out = [x for x in re.split(rf"[^\w{re.escape(self.token_chars)}]|_" if "_" not in self.token_chars else rf"[^\w{re.escape(self.token_chars)}]", t) if x]
        return [porter(x) for x in out] if self.kind == "porter" else out



def porter(w: str) -> str:
    """A word's stem by Porter's five steps (1980)."""
    if len(w) < 3 or not w.isascii():
        return w

    def form(s: str) -> str:
        return re.sub(r"(.)\1+", r"\1", "".join("v" if c in "aeiou" or c == "y" and i and s[i - 1] not in "aeiou" else "c" for i, c in enumerate(s)))

    def m(s: str) -> int:
        return form(s).count("vc")

    def swap(w: str, rules: list[tuple[str, str]], least: int) -> str:
        for a, b in rules:
            if w.endswith(a):
                return w[: -len(a)] + b if m(w[: -len(a)]) > least else w
        return w

    def double(s: str) -> bool:
        return len(s) > 1 and s[-1] == s[-2] and form(s[-1:]) == "c" and s[-1] not in "aeiou"

    def cvc(s: str) -> bool:
        if len(s) < 3:
            return False
        kinds = ["v" if c in "aeiou" or c == "y" and i and s[i - 1] not in "aeiou" else "c" for i, c in enumerate(s)]
        return kinds[-3:] == ["c", "v", "c"] and s[-1] not in "wxy"

    for a, b in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(a):
            w = w[: -len(a)] + b
            break
    if w.endswith("eed"):
        w = w[:-1] if m(w[:-3]) > 0 else w
    else:
        for a in ("ed", "ing"):
            if w.endswith(a) and "v" in form(w[: -len(a)]):
                w = w[: -len(a)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif m(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in form(w[:-1]):
        w = w[:-1] + "i"
    # fixed values: the suffixes of steps 2 to 4
    w = swap(w, [x.split(":") for x in (  # type: ignore[misc]
        "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate "
        "ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble").split()], 0)  # fmt: skip
    w = swap(w, [x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split()], 0)  # type: ignore[misc]
    for a in "ement ment ent al ance ence er ic able ible ant ion ou ism ate iti ous ive ize".split():
        if w.endswith(a):
            if m(w[: -len(a)]) > 1 and (a != "ion" or w[: -len(a)].endswith(("s", "t"))):
                w = w[: -len(a)]
            break
    if w.endswith("e") and (m(w[:-1]) > 1 or m(w[:-1]) == 1 and not cvc(w[:-1])):
        w = w[:-1]
    if m(w) > 1 and double(w) and w.endswith("l"):
        w = w[:-1]
    return w


def stem(tokens: Column) -> Column:
    @F.arrow_udf("array<string>")
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, str] = {}
        for rows in it:
            if len(known) > 50_000:
                known.clear()
            # each word of a batch once; the texts stay Arrow's
            words = rows.flatten().dictionary_encode()
            stems = pa.array([None if x is None else known.get(x) or known.setdefault(x, porter(x)) for x in words.dictionary.to_pylist()], pa.string())
            ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(rows), 0))
            offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
            yield pa.ListArray.from_arrays(offsets, stems.take(words.indices), mask=rows.is_null())

    return run(tokens)


# queries


@dataclass(frozen=True)
class Node:
    kind: str  # phrase, near, and, or, not
    tokens: tuple[str, ...] = ()
    prefix: bool = False
    parts: tuple = ()
    distance: int = 10
    columns: tuple[str, ...] = ()  # with a leading -, those left out
    start: bool = False  # at a column's first token alone

    def __and__(self, o: Node) -> Node:
        return Node("not", parts=(self, o.parts[0])) if o.kind == "!" else Node("and", parts=(self, o))

    def __or__(self, o: Node) -> Node:
        return Node("or", parts=(self, o))

    def __invert__(self) -> Node:
        return Node("!", parts=(self,))


def Term(text: str) -> Node:  # noqa: N802
    return Node("phrase", (text,))


def Phrase(text: str) -> Node:  # noqa: N802
    return Node("phrase", (text,))


def Prefix(text: str) -> Node:  # noqa: N802
    return Node("phrase", (text,), True)


def Near(distance: int, *texts: str) -> Node:  # noqa: N802
    return Node("near", parts=tuple(Term(t) for t in texts), distance=distance)


def In(columns: str | tuple[str, ...], node: Node) -> Node:  # noqa: N802
    """node within the columns only."""
    cols = (columns,) if isinstance(columns, str) else tuple(columns)
    return replace(node, columns=cols, parts=tuple(In(cols, p) for p in node.parts))


_LEX = re.compile(r'\s*(?:"((?:[^"]|"")*)"|(-?\s*(?:\{[^}]*\}|\w+))\s*:|([()])|([^\s()":*^+]+)|(\*)|(,)|([\^+]))')


def parse(text: str) -> Node:
    """The tree of a query text."""
    toks: list[tuple[str, str]] = []
    at = 0
    while at < len(text.rstrip()):
        m = _LEX.match(text, at)
        if not m:
            raise ValueError(f"syntax error near {text[at:]!r}")
        kinds = ("string", "column", "paren", "word", "star", "comma", "mark")
        i = next(i for i, g in enumerate(m.groups()) if g is not None)
        toks.append((kinds[i], m.group(i + 1)))
        at = m.end()
    pos = 0

    def peek() -> tuple[str, str]:
        return toks[pos] if pos < len(toks) else ("end", "")

    def take(kind: str, value: str | None = None) -> str:
        nonlocal pos
        k, v = peek()
        if k != kind or value is not None and v != value:
            raise ValueError(f"syntax error near {v!r}")
        pos += 1
        return v

    def either() -> Node:
        node = both()
        while peek() == ("word", "OR"):
            take("word")
            node = node | both()
        return node

    def both() -> Node:
        node = less()
        while peek() == ("word", "AND") or peek()[0] in ("string", "column", "word", "mark") and peek() not in (("word", "OR"), ("word", "NOT")) or peek() == ("paren", "("):
            if peek() == ("word", "AND"):
                take("word")
            node = node & less()
        return node

    def less() -> Node:
        node = one()
        while peek() == ("word", "NOT"):
            take("word")
            node = Node("not", parts=(node, one()))
        return node

    def one() -> Node:
        k, v = peek()
        if k == "column":
            take("column")
            minus = "-" if v.startswith("-") else ""
            return In(tuple(minus + x for x in v.lstrip("-").strip("{} ").split()), one())
        if (k, v) == ("mark", "^"):
            take("mark")
            return replace(one(), start=True)
        if (k, v) == ("paren", "("):
            take("paren")
            node = either()
            take("paren", ")")
            return node
        if (k, v) == ("word", "NEAR") and pos + 1 < len(toks) and toks[pos + 1] == ("paren", "("):
            take("word")
            take("paren")
            parts = []
            while peek()[0] in ("string", "word") and not peek()[1].startswith(","):
                w = take(peek()[0])
                if w.endswith(","):
                    parts.append(Term(w[:-1]))
                    break
                parts.append(Term(w))
            n = 10
            if peek()[0] == "comma":
                take("comma")
            if peek()[0] == "word":
                n = int(take("word").strip(", "))
            take("paren", ")")
            return Node("near", parts=tuple(parts), distance=n)
        ws = [take(k if k in ("string", "word") else "word").replace('""', '"')]
        while peek() == ("mark", "+"):
            take("mark")
            k = peek()[0]
            ws.append(take(k if k in ("string", "word") else "word").replace('""', '"'))
        if peek()[0] == "star":
            take("star")
            return Node("phrase", tuple(ws), True)
        return Node("phrase", tuple(ws))

    node = either()
    if pos < len(toks):
        raise ValueError(f"syntax error near {peek()[1]!r}")
    return node


class _Seen(dict):
    """Stands for the tokens of the columns, and keeps which of them are asked for."""

    def __missing__(self, c: str) -> Column:
        self[c] = F.expr("cast(array() as array<string>)")
        return self[c]


class Index:
    """Searches over some text columns of a frame. weights: of columns in rank."""

    def __init__(self, df: DataFrame, columns: list[str], tokenizer: Tokenizer | None = None, weights: dict[str, float] | None = None):
        self.columns, self.tokenizer = columns, tokenizer or Tokenizer()
        self.weights = weights or {}
        self.df = df
        self.names = df.columns

    def _tree(self, query: str | Node) -> Node:
        return parse(query) if isinstance(query, str) else query

    def _phrase(self, node: Node) -> list[str]:
        return [t for x in node.tokens for t in self.tokenizer.one(x)]

    def _words(self, node: Node) -> list[str]:
        return [w for p in node.parts for w in self._words(p)] + (self._phrase(node) if node.kind == "phrase" else [])

    def _in(self, node: Node) -> list[str]:
        """The columns that a node looks at."""
        out = [c[1:].strip() for c in node.columns if c.startswith("-")]
        return [c for c in self.columns if c not in out] if out else list(node.columns or self.columns)

    def _let(self, tree: Node, body: Callable[[dict[str, Column]], Column], test: bool = False) -> Column:
        """body over the tokens by column. They are bound to a variable: as a
        column they would be put in wherever they are named, in lambdas too, and
        a text would be parted again for each of its words. test: body is a truth value."""
        seen = _Seen()
        got = body(seen)
        if not seen:
            return got
        letters = "".join(sorted({w[:1] for w in self._words(tree)}))
        bound = F.array(F.struct(*[self.tokenizer.tokens(F.col(c), letters or None).alias(f"t{i}") for i, c in enumerate(seen)]))
        inner = lambda s: body({c: s[f"t{i}"] for i, c in enumerate(seen)})
        return F.exists(bound, inner) if test else F.get(F.transform(bound, inner), F.lit(0))

    def _here(self, node: Node, t: Column, i: Column) -> Column:
        """Whether the phrase begins at position i of the tokens t."""
        want = self._phrase(node)
        tests = [F.get(t, i + k) == w for k, w in enumerate(want)]
        if node.prefix:
            tests[-1] = F.startswith(F.get(t, i + len(want) - 1), F.lit(want[-1]))
        return F.coalesce(reduce(and_, tests), F.lit(False))

    def _starts(self, node: Node, t: Column) -> Column:
        """Positions in the tokens t where the phrase begins."""
        want, none = self._phrase(node), F.expr("cast(array() as array<int>)")
        if not want:
            return none
        if node.start:
            return F.when(self._here(node, t, F.lit(0)), F.array(F.lit(0))).otherwise(none)
        spots = F.transform(t, lambda _, i: F.when(self._here(node, t, i), i))
        # the first word rules out most texts before any position is tried
        first = F.exists(t, lambda x: F.startswith(x, F.lit(want[0])) if node.prefix and len(want) == 1 else x == want[0])
        return F.when(first, F.filter(spots, lambda i: i.isNotNull())).otherwise(none)

    def _holds(self, node: Node, t: dict[str, Column]) -> Column:
        cols = self._in(node)
        if node.kind == "phrase":
            want = self._phrase(node)
            if self.tokenizer.kind == "trigram" and len(node.tokens) == 1 and len(node.tokens[0].lower()) >= 3 and not self.tokenizer.custom:
                # the runs of a phrase follow one another just where its text stands
                test = F.startswith if node.start else F.contains
                return reduce(or_, [test(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(node.tokens[0].lower())) for c in cols], F.lit(False))
            if want and node.start:
                return reduce(or_, [self._here(node, t[c], F.lit(0)) for c in cols], F.lit(False))
            if len(want) == 1:
                test = (lambda x: F.startswith(x, F.lit(want[0]))) if node.prefix else (lambda x: x == want[0])
                return reduce(or_, [F.exists(t[c], test) for c in cols], F.lit(False))
            return reduce(or_, [F.size(self._starts(node, t[c])) > 0 for c in cols], F.lit(False))
        if node.kind == "near":
            return reduce(or_, [self._near(node, t[c]) for c in cols])
        if node.kind == "and":
            return reduce(and_, [self._holds(p, t) for p in node.parts])
        if node.kind == "or":
            return reduce(or_, [self._holds(p, t) for p in node.parts])
        if node.kind == "not":
            return self._holds(node.parts[0], t) & ~self._holds(node.parts[1], t)
        raise ValueError("NOT needs something before it")

    def _near(self, node: Node, t: Column) -> Column:
        """One place of each phrase, all within distance words between the end
        of the first and the start of the last."""
        sizes = [len(self._phrase(p)) for p in node.parts]

        def place(k: int) -> Callable[[Column], Column]:
            return lambda i: F.struct((i + sizes[k]).alias("end"), F.lit(k).alias("k"), i.alias("start"))

        places = [F.transform(self._starts(p, t), place(k)) for k, p in enumerate(node.parts)]
        last = [f"l{k}" for k in range(len(sizes))]

        def step(acc: Column, x: Column) -> Column:
            """The last place of each phrase up to this end; no others lie closer together."""
            now = [F.when(x["k"] == k, x["start"]).otherwise(acc[n]) for k, n in enumerate(last)]
            lo = F.least(*now) if len(now) > 1 else now[0]
            found = acc["found"] | ((lo >= 0) & (x["end"] - lo - sum(sizes) <= node.distance))
            return F.struct(found.alias("found"), *[c.alias(n) for c, n in zip(now, last, strict=True)])

        none = F.struct(F.lit(False).alias("found"), *[F.lit(-1).alias(n) for n in last])
        return F.aggregate(F.array_sort(F.concat(*places)), none, step, lambda acc: acc["found"])

    def _matches(self, query: str | Node) -> Column:
        tree = self._tree(query)
        return self._let(tree, lambda t: self._holds(tree, t), test=True)

    def match(self, query: str | Node) -> DataFrame:
        return self.df.filter(self._matches(query))

    def _phrases(self, node: Node) -> list[Node]:
        if node.kind == "phrase":
            return [node]
        parts = node.parts[:1] if node.kind == "not" else node.parts
        return [x for p in parts for x in self._phrases(p)]

    def ranked(self, query: str | Node, name: str = "rank") -> DataFrame:
        """Matches with bm25 (k1 1.2, b 0.75), negated: less is better."""
        tree = self._tree(query)
        phrases = self._phrases(tree)

        def counts(t: dict[str, Column]) -> Column:
            length = reduce(lambda a, b: a + b, [F.size(t[c]) for c in self.columns])
            hits = [sum((F.size(self._starts(p, t[c])) * F.lit(self.weights.get(c, 1.0)) for c in self._in(p)), F.lit(0.0)) for p in phrases]
            return F.struct(length.alias("__len"), self._holds(tree, t).alias("__hit"), *[h.alias(f"__f{i}") for i, h in enumerate(hits)])

        counted = self.df.withColumn("__s", self._let(tree, counts)).select(*self.names, "__s.*")
        hits = range(len(phrases))
        stats = counted.agg(F.count(F.lit(1)).alias("__n"), F.avg("__len").alias("__avg"), *[F.count(F.when(F.col(f"__f{i}") > 0, 1)).alias(f"__d{i}") for i in hits])
        score = F.lit(0.0)
        for i in hits:
            f, d = F.col(f"__f{i}"), F.col(f"__d{i}")
            idf = F.greatest(F.ln((F.col("__n") - d + 0.5) / (d + 0.5)), F.lit(1e-6))
            score = score + idf * (f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * F.col("__len") / F.col("__avg"))))
        return counted.filter("__hit").crossJoin(F.broadcast(stats)).select(*self.names, (-score).alias(name))

    def _marks(self, query: str | Node, c: str) -> Column:
        """Positions of tokens of c that lie in a phrase of the query."""
        phrases = [p for p in self._phrases(self._tree(query)) if c in self._in(p)]
        if not phrases:
            return F.expr("cast(array() as array<int>)")
        return self._let(self._tree(query), lambda t: F.array_distinct(F.concat(*[self._spread(p, t[c]) for p in phrases])))

    def _spread(self, p: Node, t: Column) -> Column:
        last = len(self._phrase(p)) - 1
        return F.flatten(F.transform(self._starts(p, t), lambda i: F.sequence(i, i + last)))

    def highlight(self, query: str | Node, c: str, open_: str, close: str, name: str = "highlight") -> DataFrame:
        """Matches with column c's text, each run of matched words between the marks."""
        tok = self.tokenizer
        return self._marked(query, c, name, lambda t, m: _highlight(t, m, open_, close, tok))

    def snippet(self, query: str | Node, c: str, open_: str, close: str, ellipsis: str, words: int, name: str = "snippet") -> DataFrame:
        """Matches with the stretch of `words` words of c that holds most matched words."""
        tok = self.tokenizer
        return self._marked(query, c, name, lambda t, m: _snippet(t, m, open_, close, ellipsis, words, tok))

    def _marked(self, query, c: str, name: str, fn) -> DataFrame:
        @F.pandas_udf("string")
        def run(texts: pd.Series, marks: pd.Series) -> pd.Series:
            return pd.Series([None if t is None else fn(t, {int(x) for x in m}) for t, m in zip(texts, marks, strict=True)])

        # named twice, so the positions stay a column: as an argument of the function, a phrase's lambdas aren't evaluated by Spark 4.1
        hit = self.df.filter(self._matches(query)).withColumn("__m", self._marks(query, c))
        return hit.select(*self.names, F.when(F.size("__m") >= 0, run(F.col(c), F.col("__m"))).alias(name))


def _places(text: str, tokenizer: Tokenizer) -> list[tuple[int, int]]:
    if tokenizer.kind == "trigram":
        return [(i, i + 3) for i in range(len(text) - 2)]
    extra = re.escape(tokenizer.token_chars)
    return [m.span() for m in re.finditer(rf"(?:[^\W_]|[{extra}])+" if extra else r"[^\W_]+", text)]


def _highlight(text: str, marks: set[int], open_: str, close: str, tokenizer: Tokenizer) -> str:
    out, at = [], 0
    for i, (a, b) in enumerate(_places(text, tokenizer)):
        if i in marks:
            if i - 1 not in marks:
                out += [text[at:a], open_]
                at = a
            if i + 1 not in marks:
                out += [text[at:b], close]
                at = b
    return "".join(out) + text[at:]


def _snippet(text: str, marks: set[int], open_: str, close: str, ellipsis: str, words: int, tokenizer: Tokenizer) -> str:
    places = _places(text, tokenizer)
    if len(places) <= words:
        return _highlight(text, marks, open_, close, tokenizer)
    starts = sorted({max(0, min(m, len(places) - words)) for m in marks} | {0})
    best = max(starts, key=lambda s: (sum(s <= m < s + words for m in marks), -s))
    a = places[best][0] if best else 0
    end = best + words
    b = places[end - 1][1] if end < len(places) else len(text)
    part = _highlight(text[a:b], {m - best for m in marks if best <= m < end}, open_, close, tokenizer)
    return (ellipsis if best else "") + part + (ellipsis if end < len(places) else "")
