"""Operator 3: main text of web pages, with site template removal.

Each page is parsed once on the executors into blocks of text, and the element
subtrees that hold them: a hash and a span of blocks. Spark counts each
subtree's hash per host over distinct pages; subtrees that recur on many pages
of their host are template and the blocks within them go. What the page's own
markup names as menu, header, footer, sidebar, notice, advert, form, script,
style or comment goes at once, and a page with an article or main element keeps
only what lies in it. Within those, and for paragraphs, headings, list items
and the like anywhere, a class or id names such furniture only if all of its
words do (`ad`, `comment-list`, `cookie-notice`; not `search-note`). Copies of a
page count once, so a page copied many times on one host doesn't become its
template.

Many pages are `share` of the host's (`main_share` for subtrees within article
or main); or, within article or main as without, `share` of them or `many`
whatever the host's size, of pages that are otherwise different: those of whose
text (of the article's, if there is one) half or more lies in no subtree that
recurs. Near copies of a page thus don't become template by their number alone.
In either case `least` pages are needed.

Scale: a host may hold a third of all pages; its subtrees are counted by (host,
hash) with partial aggregation, and the templates found are joined to the
subtrees of each page, so no task gathers those of a host. Counts and joins see
hashes and spans only. A Bloom filter of fixed size tells pages that hold no
template; the texts of the others move once, to meet their page's spans. A
fuller filter, of more templates, moves more texts and changes nothing else.

Defined edge cases: null or empty html and pages without text give an empty
text; a null url has an empty host, and such pages form one host; unclosed or
crossed tags, cut references and binary junk parse without error; repeated rows
each get the same result; extra columns are not read.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plait.llm.common import discard, materialize, release, slices, table
from plait.llm.url_filter import split_url

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|</([a-zA-Z][^\s/>]*+)[^>]*+>|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

#: Elements by their role in the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title noframes xmp".split())
DROP = frozenset("head nav footer aside form button select option object svg canvas audio video map menu dialog label fieldset datalist".split())
BLOCK = frozenset(
    "html body article main section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre figure figcaption address details summary form fieldset hr center".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "html", "body"}
CLOSED_BY_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSE_STOPS = frozenset("ul ol dl table html body article main section div".split())
#: Words of a class or id, and roles, that name what isn't main text.
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar footer header masthead cookie cookies consent gdpr notice alert newsletter subscribe subscription popup modal "
    "overlay comment comments reply replies disqus respond social share sharing related recommended pagination pager login signup search "
    "widget toolbar skip hidden".split()
)
#: Words that such names add to those.
PLAIN_WORDS = frozenset(
    "area bar block bottom box button buttons container content form group inner item items left link links list module outer panel post posts "
    "right row section slot stories top unit wrap wrapper".split()
)
#: Elements that hold text rather than other blocks.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr caption blockquote pre figcaption span a b i em strong small q code sub sup u s mark time".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())


def _furniture(name: str, strict: bool) -> bool:
    """Whether a class or id names furniture: one of its words does or, strictly, all that say anything."""
    if not strict:
        return not BAD_WORDS.isdisjoint(re.split(r"[^a-z0-9]+", name))
    for token in name.split():
        words = [w for w in re.split(r"[^a-z]+", token) if w]
        if any(w in BAD_WORDS for w in words) and all(w in BAD_WORDS or w in PLAIN_WORDS for w in words):
            return True
    return False


def _unwanted(tag: str, attrs: str, in_main: bool) -> bool:
    if tag in DROP or tag == "header" and not in_main:
        return True
    if not attrs or tag in ("html", "body"):
        return False
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            if _furniture(value, in_main or tag in TEXT):
                return True
        elif name == "role" and value in BAD_ROLES or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$)", ATTRIBUTE.sub(" ", attrs)))


def _is_main(tag: str, attrs: str) -> bool:
    return tag in ("article", "main") or "main" in attrs and bool(re.search(r"role\s*=\s*[\"']?main\b", attrs))


def parse(page: str) -> tuple[list[tuple[str, bool]], list[tuple[int, int, int]]]:
    """Blocks as (text, in main), in page order; and the subtrees that hold
    some: hash, first block, last block + 1."""
    # an open element: tag, its text is dropped, in main, content hasher, first block, holds main
    stack: list[list] = [["", False, False, xxhash.xxh3_64(), 0, True]]
    blocks: list[tuple[str, bool]] = []
    subtrees: list[tuple[int, int, int]] = []
    words: list[str] = []

    def flush() -> None:
        top = stack[-1]
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            top[3].update(text.encode("utf-8", "surrogatepass"))
            if not top[1]:
                blocks.append((text, top[2]))

    def close() -> None:
        tag, dropped, _, content, first, has_main = stack[-1]
        if tag in BLOCK or dropped:
            flush()
        stack.pop()
        parent = stack[-1]
        digest = content.intdigest()
        if tag in BLOCK:
            if tag not in ("html", "body") and not has_main and len(blocks) > first:
                subtrees.append((digest - (1 << 64) if digest >> 63 else digest, first, len(blocks)))
        parent[3].update(b"<%x>" % digest)
        parent[5] = parent[5] or has_main

    at = 0
    while True:
        m = TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            text = page[at:end]
            if "&" in text:
                text = htmllib.unescape(text)
            words.append(text)
        if not m:
            break
        at = m.end()
        if m[2]:
            tag, attrs = m[2].lower(), m[3]
            if tag in RAW:
                # its content is no markup: go on behind its end tag
                shut = re.compile(rf"</{tag}[^>]*>", re.I).search(page, at)
                at = shut.end() if shut else len(page)
                continue
            if tag in BLOCK:
                flush()
            elif tag == "br":
                words.append(" ")
            if tag in VOID:
                continue
            if tag in CLOSES_P or tag in CLOSED_BY_LIKE:
                like = CLOSED_BY_LIKE.get(tag, {"p"})
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in like:
                        while len(stack) > i:
                            close()
                        break
                    if stack[i][0] in CLOSE_STOPS:
                        break
            if attrs.endswith("/") and tag not in BLOCK:
                continue
            top = stack[-1]
            drop = top[1] or _unwanted(tag, attrs, top[2])
            if drop and not top[1]:
                flush()
            main = top[2] or not drop and _is_main(tag, attrs)
            stack.append([tag, drop, main, xxhash.xxh3_64(f"{tag} {attrs}".encode("utf-8", "surrogatepass")), len(blocks), main and not top[2]])
        elif m[1]:
            tag = m[1].lower()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    if tag in BLOCK:
                        flush()
                    while len(stack) > i:
                        close()
                    break
                if stack[i][0] in ("td", "table", "article", "main") and tag not in BLOCK:
                    break
    while len(stack) > 1:
        close()
    flush()
    return blocks, subtrees


def page_text(page: str) -> tuple[list[str], list[tuple[int, int, int]], bool, int]:
    """Of a page: the blocks that may be its text (those in an article or main
    element, if there is one); the subtrees, with an empty span where they hold
    none of those; whether there is such an element; a hash of all its text."""
    blocks, subtrees = parse(page)
    content = xxhash.xxh3_64_intdigest("\n".join(b[0] for b in blocks).encode("utf-8", "surrogatepass")) >> 1
    if not any(b[1] for b in blocks):
        return [b[0] for b in blocks], subtrees, False, content
    before = [0]
    for b in blocks:
        before.append(before[-1] + b[1])
    return [b[0] for b in blocks if b[1]], [(h, before[lo], before[hi]) for h, lo, hi in subtrees], True, content


_SUBTREES = pa.list_(pa.struct([("h", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]))


def parse_pages(df: DataFrame, html_col: str = "html") -> DataFrame:
    """df with blocks, sizes (their lengths), subtrees, has_main and content (a hash) in place of the html."""
    keep = [c for c in df.columns if c != html_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 256):
                got = [page_text(x or "") for x in b.column(html_col).to_pylist()]
                subtrees = [[{"h": h, "lo": lo, "hi": hi} for h, lo, hi in g[1]] for g in got]
                made = {
                    "blocks": pa.array([g[0] for g in got], pa.list_(pa.string())), "sizes": pa.array([list(map(len, g[0])) for g in got], pa.list_(pa.int32())),
                    "subtrees": pa.array(subtrees, _SUBTREES), "has_main": pa.array([g[2] for g in got]), "content": pa.array([g[3] for g in got], pa.int64()),
                }
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *made.values()], [*keep, *made])
        release()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != html_col)
    return df.mapInArrow(run, f"{fields}, blocks array<string>, sizes array<int>, subtrees array<struct<h:bigint,lo:int,hi:int>>, has_main boolean, content bigint")


def site_templates(parsed: DataFrame, share: float, main_share: float, least: int, many: int) -> DataFrame:
    """host, h (hash of a subtree) of the templates, and whether each is one
    outside (loose) and within (strict) article and main; from host (its hash),
    content, subtrees and sizes."""
    once = parsed.select("host", "content", "subtrees", "sizes").dropDuplicates(["host", "content"])
    once = materialize(once, "once")
    pages = once.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= least)
    subtrees = once.select("host", "content", F.explode("subtrees").alias("s")).select("host", "content", "s.*")
    counts = subtrees.select("host", "content", "h").distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts.filter(F.col("n") >= least), "counts")
    # pages that are otherwise different: half their text or more lies in no subtree that recurs
    again = subtrees.join(counts.select("host", "h"), ["host", "h"]).groupBy("host", "content").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"), F.collect_set("h").alias("again"))
    size = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda n, x: n + x)
    own = F.filter("sizes", lambda _, i: ~F.exists("spans", lambda s: (s["lo"] <= i) & (i < s["hi"])))
    different = once.join(again, ["host", "content"]).filter(size(own) * 2 >= size("sizes"))
    votes = different.select("host", F.explode("again").alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("votes"))
    found = counts.join(pages, "host").join(votes, ["host", "h"], "left")
    bar = F.greatest(F.lit(float(least)), F.least(F.col("pages") * F.lit(share), F.lit(float(many))))
    by_votes = F.coalesce(F.col("votes") >= bar, F.lit(False))
    loose, strict = (by_votes | (F.col("n") >= F.col("pages") * F.lit(x)) for x in (share, main_share))
    out = materialize(found.select("host", "h", loose.alias("loose"), strict.alias("strict")).filter("loose or strict"), "templates")
    discard(once, counts)
    return out


#: Bits of the filter of templates, and of one of Spark's bitmaps.
_FILTER, _BITMAP = 1 << 26, 1 << 15


def _may_hold(rules: DataFrame):
    """A function of an array of places in the filter: whether one of them is a template's."""
    place = F.pmod(F.xxhash64("host", "h"), F.lit(_FILTER))
    maps = rules.select(place.alias("p")).groupBy(F.floor(F.col("p") / _BITMAP).cast("int").alias("b")).agg(F.bitmap_construct_agg(F.col("p") % _BITMAP).alias("m"))
    bits = np.zeros(_FILTER // 8, np.uint8)
    for r in maps.collect():
        bits[r["b"] * _BITMAP // 8 : (r["b"] + 1) * _BITMAP // 8] = np.frombuffer(r["m"], np.uint8)
    sent = rules.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def may_hold(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in it:
            count = np.fromiter(map(len, rows), np.int64, len(rows))
            at = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
            hits = np.concatenate([[0], np.cumsum(sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)])
            end = np.cumsum(count)
            yield pd.Series(hits[end] > hits[end - count])

    return may_hold


def extract(df: DataFrame, url_col: str = "url", html_col: str = "html", share: float = 0.3, main_share: float = 0.9, least: int = 8, many: int = 30) -> DataFrame:
    """df's columns but the html (and any text), then text: its blocks joined by an empty line."""
    host = F.xxhash64(F.coalesce(split_url(F.col(url_col))[0], F.lit("")))
    keep = [c for c in df.columns if c not in (html_col, "text")]
    rows = df.select(F.struct(*keep).alias("row"), F.monotonically_increasing_id().alias("uid"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    parsed = materialize(parse_pages(rows), "pages")
    rules = site_templates(parsed, share, main_share, least, many)
    met = parsed.filter("size(blocks) > 0").select("uid", "host", "has_main", F.explode("subtrees").alias("s")).filter("s.hi > s.lo")
    met = met.select("uid", "host", "has_main", F.col("s.h").alias("h"), "s.lo", "s.hi").join(rules, ["host", "h"])
    met = met.filter(F.when(F.col("has_main"), F.col("strict")).otherwise(F.col("loose"))).groupBy("uid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    held = F.filter("subtrees", lambda s: s["hi"] > s["lo"])
    places = F.transform(held, lambda s: F.pmod(F.xxhash64("host", s["h"]), F.lit(_FILTER)))
    told = parsed.select("uid", "row", "blocks", _may_hold(rules)(places).alias("may"))
    joined = told.filter("may").join(met, "uid", "left")
    kept = F.when(F.col("spans").isNull(), F.col("blocks")).otherwise(
        F.filter("blocks", lambda _, i: ~F.exists("spans", lambda s: (s["lo"] <= i) & (i < s["hi"])))
    )
    cleaned = joined.select("row.*", F.array_join(kept, "\n\n").alias("text"))
    return cleaned.unionByName(told.filter("not may").select("row.*", F.array_join("blocks", "\n\n").alias("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of op3: one per page."""
    got = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.withColumn("n_chars", F.length("text").cast("long"))
