"""Full-text search and bounding boxes."""


from pyspark.sql import functions as F

from plait.operators import spatial as B
from plait.operators.fulltext import In, Index, Near, Phrase, Prefix, Term, Tokenizer
from plait.queries import case

c = F.col
_DOCS = r"""WITH d AS (SELECT doc_id, source, list_filter(string_split_regex(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents) """


def _index(db, **how):
    return Index(db.frame("documents").select("doc_id", "source", "text"), ["text"], **how)


@case("fts_term", _DOCS + "SELECT doc_id FROM d WHERE list_contains(t, 'idiot')")
def fts_term(db):
    return _index(db).match("idiot").select("doc_id")


@case("fts_boolean", _DOCS + "SELECT doc_id FROM d WHERE (list_contains(t, 'clown') OR list_contains(t, 'idiot')) AND list_contains(t, 'the') AND NOT list_contains(t, 'scum')")
def fts_boolean(db):
    return _index(db).match("((clown OR idiot) AND the) NOT scum").select("doc_id")


@case("fts_builder", _DOCS + "SELECT doc_id FROM d WHERE list_contains(t, 'clown') OR (list_contains(t, 'idiot') AND NOT list_contains(t, 'scum'))")
def fts_builder(db):
    return _index(db).match(Term("clown") | Term("idiot") & ~Term("scum")).select("doc_id")


@case("fts_phrase", _DOCS + "SELECT doc_id FROM d WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' rights reserved ')")
def fts_phrase(db):
    return _index(db).match('"Rights reserved"').select("doc_id")


@case("fts_prefix", _DOCS + "SELECT doc_id FROM d WHERE len(list_filter(t, lambda x: starts_with(x, 'idio'))) > 0")
def fts_prefix(db):
    return _index(db).match("idio*").select("doc_id")


@case("fts_accents", _DOCS + "SELECT doc_id FROM d WHERE list_contains(t, 'pour') AND len(list_filter(t, lambda x: starts_with(x, 'etr'))) > 0")
def fts_accents(db):
    return _index(db).match(Phrase("POUR") & Prefix("étr")).select("doc_id")


@case("fts_start", _DOCS + "SELECT doc_id FROM d WHERE t[1] = 'the'")
def fts_start(db):
    return _index(db).match("^the").select("doc_id")


@case("fts_plus", _DOCS + "SELECT doc_id FROM d WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' all rights reserved ')")
def fts_plus(db):
    return _index(db).match("all + rights + reserved").select("doc_id")


@case("fts_near", _DOCS + """
SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(range(1, len(t) + 1)) AS i, t FROM d WHERE list_contains(t, 'licensed') AND list_contains(t, 'license'))
WHERE t[i] = 'licensed' AND (list_contains(t[i + 1:i + 7], 'license') OR list_contains(t[greatest(i - 7, 1):i - 1], 'license'))""")
def fts_near(db):
    return _index(db).match(Near(6, "licensed", "license")).select("doc_id")


@case("fts_column", _DOCS + "SELECT doc_id FROM d WHERE list_contains(t, 'idiot') AND source = 'src1'")
def fts_column(db):
    index = Index(db.frame("documents").select("doc_id", "source", "text"), ["source", "text"])
    return index.match(In("source", Term("src1")) & In("text", Term("idiot"))).select("doc_id")


@case("fts_bm25", _DOCS + """,
s AS (SELECT count(*) AS n, avg(len(t)) AS al, count(*) FILTER (list_contains(t, 'idiot')) AS d1, count(*) FILTER (list_contains(t, 'clown')) AS d2 FROM d),
f AS (SELECT doc_id, len(t) AS l, len(list_filter(t, lambda x: x = 'idiot')) AS f1, len(list_filter(t, lambda x: x = 'clown')) AS f2 FROM d)
SELECT doc_id, round(-(greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * l / al))
  + greatest(ln((n - d2 + 0.5) / (d2 + 0.5)), 1e-6) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * l / al))), 6) AS score FROM f, s WHERE f1 > 0 OR f2 > 0""")
def fts_bm25(db):
    return _index(db).ranked("idiot OR clown").select("doc_id", F.round("rank", 6).alias("score"))


@case("fts_trigram", "SELECT doc_id FROM documents WHERE contains(lower(text), 'dio')")
def fts_trigram(db):
    return _index(db, tokenizer=Tokenizer("trigram")).match("dio").select("doc_id")


@case("fts_porter")
def fts_porter(db):
    return _index(db, tokenizer=Tokenizer("porter")).match("licensing").select("doc_id")


@case("fts_highlight")
def fts_highlight(db):
    return _index(db).highlight("idiot OR clown", "text", "<b>", "</b>").select("doc_id", "highlight")


@case("fts_snippet")
def fts_snippet(db):
    return _index(db).snippet("idiot OR clown", "text", "[", "]", "...", 12).select("doc_id", "snippet")


_DIMS = [("x0", "x1"), ("y0", "y1")]


def _boxes(db, mark=""):
    p = db.frame("part")
    price = F.floor("p_retailprice")
    cols = [c("p_partkey").alias(f"k{mark}"), c("p_size").alias(f"x0{mark}"), (c("p_size") + 3).alias(f"x1{mark}"), price.alias(f"y0{mark}"), (price + 20).alias(f"y1{mark}")]
    return B.as_boxes(p.select(*cols), [(f"{a}{mark}", f"{b}{mark}") for a, b in _DIMS])


_BOXES = "b AS (SELECT p_partkey AS k, p_size AS x0, p_size + 3 AS x1, floor(p_retailprice) AS y0, floor(p_retailprice) + 20 AS y1 FROM part) "


@case("bbox_point", f"WITH {_BOXES} SELECT k FROM b WHERE x0 <= 12 AND x1 >= 12 AND y0 <= 1200 AND y1 >= 1200")
def bbox_point(db):
    return _boxes(db).filter(B.holds_point(_DIMS, 12, 1200)).select("k")


@case("bbox_window", f"WITH {_BOXES} SELECT k, x0 >= 10 AND x1 <= 20 AND y0 >= 1000 AND y1 <= 1300 AS inside FROM b WHERE x0 <= 20 AND x1 >= 10 AND y0 <= 1300 AND y1 >= 1000")
def bbox_window(db):
    box = ((10, 20), (1000, 1300))
    return _boxes(db).filter(B.overlaps(_DIMS, *box)).select("k", B.within(_DIMS, *box).alias("inside"))


@case("bbox_overlap", f"WITH {_BOXES} SELECT a.k AS k, c.k AS k2 FROM b a JOIN b c ON a.x0 <= c.x1 AND a.x1 >= c.x0 AND a.y0 <= c.y1 AND a.y1 >= c.y0 WHERE a.k < c.k")
def bbox_overlap(db):
    a, b = _boxes(db), _boxes(db, "2")
    return B.overlap_join(a, b, _DIMS, [(f"{p}2", f"{q}2") for p, q in _DIMS], [8.0, 100.0]).filter("k < k2").select("k", "k2")
