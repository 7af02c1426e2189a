"""Hard negatives, language identification and lexical search against brute force, and their edge cases."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import langid, lexical, negatives
from marketlens.llm.common import prepare


@pytest.fixture(scope="module")
def sp(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    prepare(spark, 16)
    yield spark
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


# ---- hard negatives

VECTORS = "vec_id bigint, embedding array<float>, label int, ta string, code string, rank int"


def _vectors(n, dim, seed, spread=0.5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(4, dim))
    x = middle[rng.integers(0, 4, n)] + spread * rng.normal(size=(n, dim))
    rows = [(i * 5, x[i].tolist(), int(rng.integers(0, 4)), "ta", "code", 1) for i in range(n)]
    rows += [(100_000 + i, rows[7][1], i % 3, "", "", 0) for i in range(30)]          # ties: one vector, many ids
    return rows + [(200_000, [0.0] * dim, 1, "", "", 0), (200_100, [0.0] * dim, 1, "", "", 0)]


BROKEN = [(None, [1.0, 2.0], 1, "", "", 0), (300_000, None, 1, "", "", 0), (300_100, [1.0, None], 1, "", "", 0),
          (300_200, [1.0, float("nan")], 1, "", "", 0), (300_300, [float("inf"), 1.0], 1, "", "", 0), (300_400, [1.0, 1.0], None, "", "", 0)]


def _brute_negatives(rows, scale):
    v = sorted({(i, lab, tuple(math.floor(scale * float(np.float32(c))) for c in e)) for i, e, lab, *_ in rows
                if i is not None and lab is not None and e is not None and all(c is not None and math.isfinite(c) for c in e)})
    out = []
    for a in (x for x in v if x[0] % 100 == 0):
        score = sorted(((-sum(p * q for p, q in zip(a[2], b[2])), b[0], b[1]) for b in v if b is not a))
        for s, p, _ in [x for x in score if x[2] == a[1]][:5]:
            hard = [x for x in score if x[2] != a[1] and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(a[0], p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(hard)]
    return sorted(out)


def _mine(df, scale=256):
    got = negatives.mine(negatives.quantised(df, scale, F.col("label")), F.expr("vec_id % 100 = 0"))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("dim,seed", [(3, 1), (16, 2)])
def test_hard_negatives_equal_brute_force(sp, monkeypatch, dim, seed):
    monkeypatch.setattr(negatives, "CANDIDATES", 97)
    monkeypatch.setattr(negatives, "ANCHORS", 9)
    monkeypatch.setattr(negatives, "MEMBERS", 3)
    rows = _vectors(300, dim, seed)
    df = sp.createDataFrame(rows + rows[3:5] + BROKEN, VECTORS).repartition(5)     # repeated rows are one row
    want = _brute_negatives(rows, 256)
    assert _mine(df) == want and len(want) > 50


def test_hard_negatives_of_few_rows(sp):
    assert _mine(sp.createDataFrame([], VECTORS)) == []
    assert _mine(sp.createDataFrame(BROKEN, VECTORS)) == []
    alone = [(100, [1.0, 0.0], 1, "", "", 0), (101, [1.0, 0.0], 2, "", "", 0)]     # no positive
    assert _mine(sp.createDataFrame(alone, VECTORS)) == []
    below = [(100, [1.0, 0.0], 1, "", "", 0), (101, [-1.0, 0.0], 1, "", "", 0), (102, [-0.5, 0.0], 2, "", "", 0)]
    assert _mine(sp.createDataFrame(below, VECTORS)) == []                          # a window below zero is empty
    uneven = [(100, [1.0, 1.0], 1, "", "", 0), (101, [1.0], 1, "", "", 0), (102, [0.5], 2, "", "", 0)]
    assert _mine(sp.createDataFrame(uneven, VECTORS)) == [(100, 101, 1, 102, 65536, 32768)]


def test_walk_ends_early_and_large_values_stay_exact():
    rng = np.random.default_rng(3)
    code = np.concatenate([rng.integers(900, 1000, (20, 8)), rng.integers(-1000, -900, (20000, 8))])
    x = {"id": np.arange(len(code)), "alt": np.zeros(len(code), np.int64), "label": np.zeros(len(code), np.int64), "code": code}
    u = {c: v[:4] for c, v in x.items()}
    got, scored = negatives.walk(u, x, True, np.full((4, 1), -np.inf), np.full((4, 1), np.inf), 5)
    assert scored < 4 * 1000 and len(got["at"]) == 20
    big = np.array([[2 ** 29 + 1, 3]])
    assert negatives._products(big, big)[0, 0] == (2 ** 29 + 1) ** 2 + 9
    with pytest.raises(OverflowError):
        negatives._products(big << 5, big << 5)


# ---- language identification

DOCS = "doc_id bigint, text string, lang string, source string, score double, held_out string"
HELD = "crc32(CAST(doc_id AS STRING)) % 3 = 1"


def _say(rng, lang, n):
    bits = {"en": "the th ing ou and wh er", "de": "der die sch ei und ung ge", "fr": "le que oi eau les ent à", "es": "el ción que os la ar ñ"}[lang].split()
    return " ".join("".join(rng.choice(bits) for _ in range(rng.randint(1, 3))) for _ in range(n))


def _spoken():
    rng = random.Random(11)
    rows = []
    for i in range(240):
        lang = rng.choice(["en", "en", "en", "de", "fr", "es"])
        text = _say(rng, lang, rng.choice([12, 30, 80]))
        rows.append((i, text.upper() if i % 9 == 0 else text, lang, "s", 0.5, "x"))
    rows += [(1000 + i, rows[0][1], rows[0][2], "s", 0.5, "x") for i in range(60)]       # copies
    return rows


def _named(df):
    got = langid.identify(df, F.expr(HELD))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    return {r["doc_id"]: r for r in got.collect()}


def test_languages_of_held_out_documents(sp):
    rows = _spoken()
    odd = [(2000, None, "en", "s", 0.5, "x"), (2001, "", "en", "s", 0.5, "x"), (2002, " 12 $% \n", "en", "s", 0.5, "x"),
           (2003, _say(random.Random(1), "fr", 400_000), "fr", "s", 0.5, "x"), (2004, _say(random.Random(2), "de", 30), None, "s", 0.5, "x"),
           (None, _say(random.Random(3), "es", 30), "es", "s", 0.5, "x"), (2005, "der" * 600_000, "de", "s", 0.5, "x")]
    got = _named(sp.createDataFrame(rows + odd + rows[5:6], DOCS).repartition(4))
    assert len(got) == len(rows) + len(odd)
    held = [(got[i]["lang_pred"], lang) for i, _, lang, *_ in rows if got[i]["held_out"]]
    assert len(held) > 60 and sum(a == b for a, b in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (2000, 2001, 2002)] == ["und"] * 3 and got[2000]["score"] == 0
    assert (got[2003]["lang_pred"], got[2004]["lang_pred"], got[2005]["lang_pred"]) == ("fr", "de", "de")
    assert got[None]["held_out"] is False and got[None]["lang_pred"] == "es"


def test_languages_do_not_depend_on_columns_or_layout(sp):
    rows = [r for r in _spoken() if r[0] < 150]
    one = _named(sp.createDataFrame(rows, DOCS).repartition(1))
    other = [(i, t, lang, "else", 0.0, "y") for i, t, lang, *_ in reversed(rows)]
    two = _named(sp.createDataFrame(other, DOCS).repartition(7))
    assert {i: (r["lang_pred"], r["held_out"]) for i, r in one.items()} == {i: (r["lang_pred"], r["held_out"]) for i, r in two.items()}
    assert all(math.isclose(one[i]["score"], two[i]["score"], rel_tol=1e-6) for i in one)


def test_languages_with_little_to_learn(sp):
    assert _named(sp.createDataFrame([], DOCS)) == {}
    none = _named(sp.createDataFrame([(i, "some words", None, "", 0.0, "") for i in range(6)], DOCS))
    assert {r["lang_pred"] for r in none.values()} == {"und"} and {r["score"] for r in none.values()} == {0.0}
    single = _named(sp.createDataFrame([(i, "some words" if i else "1", "xx-YY", "", 0.0, "") for i in range(9)], DOCS))
    assert {r["lang_pred"] for i, r in single.items() if i} == {"xx-YY"} and single[0]["lang_pred"] == "und"


def test_duels_follow_families_and_features_the_pieces(monkeypatch):
    assert langid.duels(["de", "en", "es", "fr"]) == [
        ("family", "germanic", "romance"), ("language", "de", "en"), ("language", "es", "fr")]
    assert langid.family("pt-BR") == "romance" and langid.family("tlh") == "tlh"
    text = "The quick  brown\tfox, été\n" * 40
    whole = langid.features([text])
    monkeypatch.setattr(langid, "PIECE", 50)
    assert np.allclose(whole, langid.features([text, "other"])[:1]) and not langid.features(["12"]).any()


# ---- lexical search

ITEMS = "item_id bigint, text string, rank int"


def _terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def _brute_search(docs, items, k=10):
    held = [(i, Counter(_terms(t))) for i, t, *_ in docs]
    n, length = sum(1 for _, c in held if c), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text, *_ in items:
        found = []
        for i, c in held:
            m = 25 + 75 * c.total() * n // max(1, length)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in _terms(text) if t in c)
            if s > 0:
                found.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def _texts():
    rng = random.Random(17)
    vocab = ["the", "of", "Ünd", "ñu"] + ["".join(rng.choices("abcdeXY1", k=rng.randint(1, 4))) for _ in range(150)]
    say = lambda n: " ".join(rng.choice(vocab[:4]) if rng.random() < .4 else rng.choice(vocab) for _ in range(n))
    docs = [(i, say(rng.choice([1, 5, 40, 200])), "s", i) for i in range(150)]
    docs += [(200 + i, docs[3][1], "s", 1) for i in range(40)] + [docs[5], (None, docs[6][1], "s", 1)]
    docs += [(300, None, "s", 1), (301, "", "s", 1), (302, "!? \x00\x7f", "s", 1), (303, say(30000), "s", 1), (304, "a" * 300_000, "s", 1)]
    items = [(i, say(rng.choice([1, 8, 90])), 3) for i in range(12)] + [(12, "the THE the zzzzz", 1), (13, None, 1), (14, "?", 1),
             (15, "nowhere", 1), (2, "of of", 1), (16, docs[3][1], 1), (None, "ñu ünd", 1)]
    return docs, items


@pytest.mark.parametrize("words", [1_000_000, 300])
def test_lexical_search_equals_brute_force(sp, monkeypatch, words):
    docs, items = _texts()
    monkeypatch.setattr(lexical, "SLICE_WORDS", words)            # one slice of items, or several
    df = sp.createDataFrame(docs, "doc_id bigint, text string, term string, score bigint").repartition(5)
    got = lexical.search(df, sp.createDataFrame(items, ITEMS))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == _brute_search(docs, items)


def test_lexical_search_of_empty_tables(sp):
    docs, items = _texts()
    none = sp.createDataFrame([], "doc_id bigint, text string")
    assert lexical.search(none, sp.createDataFrame(items, ITEMS)).collect() == []
    assert lexical.search(sp.createDataFrame([d[:2] for d in docs], "doc_id bigint, text string"), sp.createDataFrame([], ITEMS)).collect() == []


def test_masks_end_the_search_early():
    rng = np.random.default_rng(5)
    n = 20000
    rare = np.sort(rng.choice(n, 30, replace=False))
    sizes = np.ones(n, np.int64)
    sizes[rare] = 2
    term = np.concatenate([[0, 1] if s == 2 else [0] for s in sizes])
    seen = lexical.Searcher([(np.array([0, 1]), np.array([1, 5000]))], n, n * 10, 10)
    seen.see(np.arange(n), np.zeros(n, bool), np.full(n, 10), sizes, term, np.ones(len(term), np.int64))
    scores, _, ids = seen.best[0]
    assert ids.tolist() == rare[:10].tolist() and len(set(scores.tolist())) == 1 and seen.scored < 1000
