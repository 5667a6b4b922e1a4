"""Ranked search against SQL and a plain version; languages on held-out documents."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from session import compare

import __spark_entry__ as entry
from gapwise.llm import language, lexical
from gapwise.llm.common import Scratch

FOLDER = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k=50):
    """{(item, rank, id, score)}; equal rows may take each other's place."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in wanted.items():
        scored = []
        for (i, c), size in zip(counts, sizes):
            if size:
                m = 50 + 50 * size * n // total
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in words if c[t])
                if score > 0:
                    scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def awkward():
    rng = random.Random(3)
    words = ["red", "Blue", "green", "Éa", "日本", "x1", "GAMMA", "delta-tau", "the", "the", "of"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(300)]
    docs += [(i, "the same red text of all copies") for i in range(300, 420)] + [(300, "the same red text of all copies")]
    docs += [(None, "red green"), (None, None), (500, ""), (501, " .,; "), (502, "w " * 700_000 + "rare red"), (502, "other rare")]
    items = [(1, "Red the BLUE, red"), (2, "日本 éa Éa"), (3, None), (4, "nowhere to be found"), (5, "rare gamma tau"), (None, "copies same"), (1, "delta")]
    return docs, items


@pytest.mark.parametrize("pairs", [2_000_000, 4])
def test_search(spark, monkeypatch, pairs):
    monkeypatch.setattr(lexical, "PAIRS", pairs)
    docs, items = awkward()
    table = spark.createDataFrame([(*r, 1, 2, "x") for r in docs], "doc_id long, text string, m int, n int, terms string").repartition(3)
    queries = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, score int")
    assert found(lexical.search(table, queries)) == ranked(docs, items)
    assert lexical.search(table.limit(0), queries).count() == 0
    assert lexical.search(table, queries.limit(0)).count() == 0


def test_strata_are_left_out(monkeypatch):
    import numpy as np

    visits = []
    real = lexical.Block.scores
    monkeypatch.setattr(lexical.Block, "scores", lambda self, wanted, visited: visits.append(int(visited.sum())) or real(self, wanted, visited))
    rows = 4000
    m = np.sort(np.random.default_rng(1).integers(50, 400, rows))
    block = lexical.Block(m, np.ones(rows, int), np.zeros(rows, np.int32), np.ones(rows, np.int32), np.array([1000]))
    at, scores = block.best(np.array([0]), 0, np.arange(rows), np.arange(rows), 50, False)
    assert (m[at] == np.sort(m)[:50]).all() and sum(visits) < 20 < block.n_strata
    assert (scores == 1000 * (10**9 // (1000 + 20 * m[at]))).all()


def test_search_equals_sql(spark, con):
    rows, problem = compare(spark, con, entry.queries()["op13_search"], entry.oracle_sql()["op13_search"], FOLDER)
    assert problem is None and rows > 0


def plain_grams(text):
    """Trigrams and four-grams of words with their ends."""
    lower = [c.lower() if len(c.lower()) == 1 else c for c in text]
    words = "".join(c if c.isalpha() else " " for c in lower).split()
    ended = [f" {w} " for w in words]
    return [w[i : i + k] for w in ended for k in (3, 4) for i in range(len(w) - k + 1) if " " not in w[i + 1 : i + k - 1]]


def test_grams():
    rng = random.Random(2)
    texts = ["", None, "a", "ab", "Ab c", "..x..", "日本語 é1é", "ÉCOLE\nİ ß", *("".join(rng.choice("abé .\n1") for _ in range(40)) for _ in range(50))]
    got, owner = language.grams(texts)
    for n, text in enumerate(texts):
        assert (owner == n).sum() == len(plain_grams(text or ""))
        mine = sorted(Counter(got[owner == n].tolist()).values())
        assert mine == sorted(Counter(plain_grams(text or "")).values())


def test_predictions_equal_exact_sets(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in table.collect()]
    learned = [(t, g) for i, t, g in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    counts = {g: Counter() for _, g in learned}
    for t, g in learned:
        counts[g].update(plain_grams(t))
    sets = {g: {x for x, n in c.items() if n >= language.SHARE * c.total()} for g, c in counts.items()}
    out = {r.doc_id: r for r in entry.queries()["op12_language"](spark, FOLDER).collect()}
    for i, t, _ in rows:
        grams = plain_grams(t)
        exact = {g: sum(x in s for x in grams) / len(grams) for g, s in sets.items()}
        assert out[i].lang_pred == max(exact, key=exact.get)
        assert abs(out[i].score - max(exact.values())) < 0.02
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    judged = entry.queries()["op12_language"](spark, folder).where("held_out").join(truth, "doc_id")
    row = judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right"), F.count(F.lit(1)).alias("n")).first()
    assert row.n > 2000 and row.right > 0.99


def test_languages_of_awkward_rows(spark):
    rows = [(i, "der die das und nicht " * 30, "de") for i in range(4)] + [(10 + i, "the and of with " * 30, "en") for i in range(4)]
    rows += [(20, None, "de"), (21, "", "en"), (22, "123 .,", "en"), (None, "the of", None), (23, "zzzz", None), (24, "the " * 400_000, "en"), (0, rows[0][1], "de"), (25, "\U0001f600", "xx")]
    table = spark.createDataFrame([(*r, "a", 1.5, True) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double, _text boolean")
    model = language.learn(table, Scratch(spark, "test"))
    assert set(model.langs) == {"de", "en"}
    out = language.identify(table, model)
    assert out.columns == ["doc_id", "lang", "_text", "lang_pred", "score"] and out.count() == len(rows)
    got = {r.doc_id: (r.lang_pred, r.score) for r in out.collect()}
    assert got[0][0] == "de" and got[10][0] == "en" and got[None][0] == "en"
    assert got[20] == got[21] == got[22] == got[25] == ("und", 0.0)
    assert got[23] == ("en", 0.0)
    nothing = language.learn(table.limit(0), Scratch(spark, "test"))
    assert {r.lang_pred for r in language.identify(table, nothing).collect()} == {"und"}


def test_more_languages_than_bits_of_a_byte(spark):
    letters = "abcdefghijklmnopqrst"
    rows = [(n, " ".join(a + b for b in letters) * 3, f"l{n:02}") for n, a in enumerate(letters)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language.identify(table, language.learn(table, Scratch(spark, "test"))).collect()
    assert all(r.lang == r.lang_pred for r in out)
