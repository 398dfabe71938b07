"""Full-text search over long texts."""

import random
import time
from itertools import product

from pyspark.sql import functions as F

from plait.operators.fulltext import Index, Near, Phrase, Tokenizer, porter, stem


def test_a_text_is_parted_once(spark):
    """20,000 words and a phrase: parted again for each word, this takes minutes."""
    df = spark.createDataFrame([(1, "the " + "word " * 20_000 + "the last word"), (2, "a last " * 10_000)], "id int, t string")
    began = time.time()
    for query, want in (("^the", [1]), ('"last word"', [1]), ("word + the", [1]), ("^a AND last", [2]), ("last NOT ^the", [2])):
        assert sorted(r.id for r in Index(df, ["t"]).match(query).collect()) == want, query
    assert time.time() - began < 30


def test_trigrams_of_long_texts(spark):
    """100,000 characters: with a substring by position for each run, this takes minutes."""
    tri = Tokenizer("trigram")
    df = spark.createDataFrame([(1, "x" * 100_000 + "Idiot é€😀z"), (2, "ab"), (3, None), (4, "diodio")], "id int, t string")
    began = time.time()
    hits = lambda q: sorted(r.id for r in Index(df, ["t"], tri).match(q).collect())
    assert hits("dio") == [1, 4] and hits("DIOT") == [1] and hits("^dio") == [4] and hits("NOTHERE") == [] and hits("dio NOT idiot") == [4]
    assert hits(Phrase("é€😀")) == [1] and hits("di") == [] and hits("NEAR(dio iot, 3)") == [1]
    got = {r.id: r.x for r in df.select("id", tri.tokens(F.col("t")).alias("x")).collect()}
    for r in df.collect():
        low = (r.t or "").lower()
        assert got[r.id] == [low[i : i + 3] for i in range(len(low) - 2)]
    assert [r["rank"] < 0 for r in Index(df, ["t"], tri).ranked("diod").collect()] == [True]
    assert time.time() - began < 60


def test_near_tries_no_products(spark):
    """4,000 places of each of three words, far apart: 64 thousand million choices."""
    far = " ".join(w for x in "abc" for w in [x] * 4_000 + ["z"] * 30)
    df = spark.createDataFrame([(1, far), (2, far + " a z b c")], "id int, t string")
    began = time.time()
    assert [r.id for r in Index(df, ["t"]).match(Near(3, "a", "b", "c")).collect()] == [2]
    assert time.time() - began < 30


def test_near_is_any_choice_of_places(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdz", k=rng.randint(0, 14))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for n, phrases in ((2, ["a", "b"]), (1, ["a b", "c"]), (3, ["a", "b", "c d"]), (0, ["a", "a"]), (4, ["d"])):
        want = []
        for i, text in enumerate(texts):
            ws = text.split()
            spots = [[j for j in range(len(ws)) if ws[j : j + len(p.split())] == p.split()] for p in phrases]
            size = [len(p.split()) for p in phrases]
            if any(max(s + k for s, k in zip(c, size, strict=True)) - min(c) - sum(size) <= n for c in product(*spots)):
                want.append(i)
        assert sorted(r.id for r in Index(df, ["t"]).match(Near(n, *phrases)).collect()) == want, phrases


def test_stems_stay_arrow(spark):
    """Batches of words reach Python as Arrow, each word once, and those of other letters not at all."""
    import inspect

    assert "pd.Series" not in inspect.getsource(stem)
    texts = ["licensed Licenses the hopping ponies", None, "", "s is a café relational license", "conditional rational flies"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    tok = Tokenizer("porter")
    plain = {r.id: r.x for r in df.select("id", Tokenizer().tokens(F.col("t")).alias("x")).collect()}
    got = {r.id: r.x for r in df.select("id", tok.tokens(F.col("t")).alias("x")).collect()}
    assert got == {i: [porter(w) for w in ws] for i, ws in plain.items()} and porter("licensing") in got[0]
    hits = lambda q: sorted(r.id for r in Index(df, ["t"], tok).match(q).collect())
    assert hits("licensing") == [0, 3] and hits("licensing NOT relations") == [0] and hits('"the hopped"') == [0] and hits("^conditions") == [4] and hits("rel*") == [3]
    assert all(porter(w)[0] == w[0] for ws in plain.values() for w in ws)
    null = spark.createDataFrame([(None,), (["flies", None],), ([],)], "x array<string>").select(stem(F.col("x")).alias("y")).collect()
    assert [r.y for r in null] == [None, ["fli", None], []]


def test_a_phrase_in_long_texts_of_its_first_word(spark):
    """The first word everywhere: each of 30,000 places is tried, over tokens that are parted once."""
    df = spark.createDataFrame([(1, "rights " * 30_000 + "reserved"), (2, "rights " * 30_000)], "id int, t string")
    began = time.time()
    assert [r.id for r in Index(df, ["t"]).match('"Rights reserved"').collect()] == [1]
    assert time.time() - began < 30
