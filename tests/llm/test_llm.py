"""Corpus operators against brute force on small tables, and their edge cases."""
import hashlib
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marketlens.llm import brown, chat, chunks, components, debruijn, decontam, lyndon, mixing, pii, quality, simhash, urls
from marketlens.llm.common import prepare

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def sp(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    prepare(spark, 16)
    yield spark
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def _texts():
    rng = random.Random(5)
    vocab = ["the", "of", "and"] + ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab[:3]) if rng.random() < .3 else rng.choice(vocab) for _ in range(n))
    passage = say(70)
    texts = [say(rng.choice([3, 40, 60, 150])) for _ in range(25)]
    texts += [texts[0], texts[0], f"{say(30)} {passage} {say(30)}", f"{passage}\n{say(5)}", f"{passage} {passage}"]
    words = passage.split()
    words[30] = "changed"
    texts += [" ".join(words), None, "", " \n\t ", "one", "é ü \x1c x", say(20000), "aaaa " * 60]
    base = say(300).split()
    for k in range(4):
        near = list(base)
        near[10 * k + 5] = f"edit{k}"
        texts.append(" ".join(near))
    return texts


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, ("en", "de", None)[i % 3], f"s{i % 4}" if i % 5 else "hot", len(t or "")) for i, t in enumerate(_texts())]
    return out + [out[3]]                      # a repeated row


@pytest.fixture(scope="module")
def docs(sp, rows):
    df = sp.createDataFrame(rows, SCHEMA).repartition(5)
    # further columns whose names the operators use inside
    for c in ("_w", "_row", "chunk", "fp", "kept", "topic", "prob", "row", "_bad", "word"):
        df = df.withColumn(c, F.lit(c))
    return df


@pytest.fixture(scope="module")
def nothing(sp):
    return sp.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(sp):
    return sp.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(20)] + [(None, 1, 0), (3, 1, 0)],
                              "doc_id bigint, quality int, toxic int")


def _words(t):
    return (t or "").encode().split()


def _by_id(df):
    out = {}
    for r in df.collect():
        out[r["doc_id"]] = r
    return out


def test_quality_counts(docs, rows, labels):
    got = _by_id(quality.judge(docs, labels))
    for i, t, *_ in rows:
        w = _words(t)
        seen = Counter(tuple(w[j:j + 3]) for j in range(len(w) - 2))
        cover = {k for j in range(len(w) - 2) if seen[tuple(w[j:j + 3])] > 1 for k in range(j, j + 3)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        r = got[i]
        assert (r.n_words, r.word_chars) == (len(w), sum(len(x.decode()) for x in w))
        assert r.n_repeat_words == len(cover)
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        assert r.kept == (not r.base_failed and r.llr >= quality.THRESHOLD)


def test_quality_ratio_separates(sp):
    good = [(i, " ".join(random.Random(i).choices(["sun", "moon", "star", "sky"], k=80)), "en", "s", 1) for i in range(30)]
    bad = [(100 + i, " ".join(random.Random(i).choices(["|", "x9", "q7", "zz"], k=80)), "en", "s", 1) for i in range(30)]
    docs = sp.createDataFrame(good + bad, SCHEMA)
    marks = sp.createDataFrame([(i, 1, 0) for i in range(15)], "doc_id bigint, quality int, toxic int")
    llr = {r.doc_id: r.llr for r in quality.judge(docs, marks).collect()}
    assert min(llr[g[0]] for g in good) > 0 > quality.THRESHOLD > max(llr[b[0]] for b in bad)


def test_quality_long_text_form(sp, monkeypatch, docs, labels):
    want = {r.doc_id: r.n_repeat_words for r in quality.judge(docs, labels).collect()}
    monkeypatch.setattr(quality, "_PLACE", 6)   # texts of over 63 windows take the form for very long ones
    assert {r.doc_id: r.n_repeat_words for r in quality.judge(docs, labels).collect()} == want


def _fp(t):
    w = [x for x in (t or "").encode().lower().split()]
    s = [b" ".join(w[j:j + 3]) for j in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _classes(items, linked):
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in itertools.combinations(items, 2):
        if linked(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in items}


def test_simhash(docs, rows):
    fps = {i: _fp(t) for i, t, *_ in rows}
    want = _classes(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("limit", [2, 512])
def test_links_join_every_close_pair(sp, monkeypatch, limit):
    monkeypatch.setattr(simhash, "BUCKET_LIMIT", limit)
    rng = random.Random(3)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        fps |= {x} | {x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(15)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = _classes(sorted(signed), lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 3)
    nodes = sp.createDataFrame([(x,) for x in signed], "fp bigint")
    got = {r.node: r.root for r in components.components(simhash.links(nodes)).collect()}
    assert {x: got.get(x, x) for x in signed} == want


def test_components_of_a_path(sp):
    edges = sp.createDataFrame([(i + 1, i) for i in range(60)] + [(i, 100) for i in range(101, 130)], "u bigint, v bigint")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 130)}


def test_repeated_word_spans(docs, rows):
    where = {}
    for k, (_, t, *_) in enumerate(rows):
        w = _words(t)
        for j in range(len(w) - 34):
            where.setdefault(tuple(w[j:j + 35]), []).append((k, j))
    gone = [set() for _ in rows]
    for hits in where.values():
        for k, j in hits if len(hits) > 1 else ():
            gone[k].update(range(j, j + 35))
    want = sorted((rows[k][0], len(_words(rows[k][1])), len(g), hashlib.sha256(
        b" ".join(x for j, x in enumerate(_words(rows[k][1])) if j not in g)).hexdigest()) for k, g in enumerate(gone))
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in debruijn.repeated_spans(docs).collect())
    assert got == want


def test_suffix_array():
    rng = random.Random(1)
    for n, k in itertools.product((0, 1, 2, 3, 8, 40, 150), (1, 2, 3, 200)):
        for _ in range(15):
            t = bytes(rng.randrange(k) for _ in range(n))
            assert lyndon.suffix_array(t) == sorted(range(n), key=lambda i: t[i:])


def test_repeated_bytes(docs, rows):
    least = {}
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    for i, b in data:
        for j in range(len(b) - 49):
            s = b[j:j + 50]
            least[s] = min(least.get(s, i), i)
    want = []
    for i, b in data:
        g = {k for j in range(len(b) - 49) if least[b[j:j + 50]] < i for k in range(j, j + 50)}
        want.append((i, len(b), len(g), sum(k - 1 not in g for k in g),
                     hashlib.sha256(bytes(x for k, x in enumerate(b) if k not in g)).hexdigest()))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in lyndon.repeated_bytes(docs).collect())
    assert got == sorted(want)


def test_class_ngrams(sp, docs, rows):
    toks = [(i, (t or "").encode().lower().split() + [None]) for i, t, *_ in rows]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in toks if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    got = brown.score(docs).collect()
    assert len(got) == len(rows)
    want = {i: (held(i), len(t), sum(c[w] > 0 for w in t), n,
                sum(math.log10((c[w] + .1) / (n + .1 * (v + 1))) for w in t)) for i, t in toks}
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4])
        assert r.score < 0


def test_class_ngrams_learn_order(sp):
    """Words that alternate between two kinds: classes must beat unigrams on held-out texts."""
    rng = random.Random(2)
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(a if j % 2 else b) for j in range(200)), "en", "s", 1) for i in range(400)]
    out = brown.score(sp.createDataFrame(rows, SCHEMA)).where("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert (out[1] - out[0]) / out[2] > 0.2     # about log10(2) a token


def test_exchange_reaches_rare_words(sp):
    """Words with three tokens each, far below a share of the corpus, are told apart by their contexts."""
    rng = random.Random(4)
    a, b = [f"a{i}" for i in range(1500)] * 3, [f"b{i}" for i in range(1500)] * 3
    rng.shuffle(a)
    rng.shuffle(b)
    rows = [(10_000 + i, " ".join(x for p in zip(a[i::90], b[i::90]) for x in ("the", p[0], "of", p[1])), "en", "s", 1) for i in range(90)]
    rows += [(20_000 + i, "the of " * 2000, "en", "s", 1) for i in range(30)]
    rows = [r for r in rows if not brown.held_out(r[0])]
    found, *_ = brown.fit(*brown.tokenised(sp.createDataFrame(rows, SCHEMA)))
    classes = {}
    for r in found.collect():
        words, _, total, *_ = brown._open(r.asDict())
        classes |= {int(w): int(c) for w, n, c in zip(words, total, brown._unpacked(r["cls"], 1)) if n == 3}
    assert len(classes) > 1000 and max(classes.values()) < brown.CLASSES


def test_best_classes_equal_plain_likelihood():
    import numpy as np
    rng = np.random.default_rng(2)
    size = brown._ALL
    stream = np.append(rng.integers(0, 60, 3000), 60)           # words 0..59, then one end
    cls = np.append(np.arange(60) % brown.CLASSES, brown._END)
    table = lambda c: np.bincount(np.append(c[stream[-1]], c[stream[:-1]]) * size + c[stream], minlength=size * size).reshape(size, size).astype(float)
    x = np.zeros((60, 2, size))
    for v, w in zip(np.append(60, stream[:-1]), stream):
        if w < 60:
            x[w, 0, cls[v]] += v != w
        if v < 60:
            x[v, 1, cls[w]] += v != w
    keep = [w for w in range(60) if not ((stream[:-1] == w) & (stream[1:] == w)).any()]
    assert keep
    got = brown.best_classes(cls[keep], x[keep], table(cls))
    for w, k in zip(keep, got):
        tried = [brown.likelihood(table(np.where(np.arange(61) == w, c, cls))) for c in range(brown.CLASSES)]
        assert tried[k] == pytest.approx(max(tried), abs=1e-6)


def _local(item, text):
    best, row = 0, [0] * (len(text) + 1)
    for w in item:
        new = [0]
        for j, x in enumerate(text):
            new.append(max(0, row[j] + (2 if x == w else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best


def test_alignment():
    import numpy as np
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(0, 5, 12).astype(np.uint64), rng.integers(0, 5, 30).astype(np.uint64)
        score, x, z = decontam.align(a, b)
        assert score == _local(a.tolist(), b.tolist()) == decontam.align(a, b[x:z])[0]


def test_decontamination(sp, docs, rows):
    rng = random.Random(9)
    items = [" ".join("".join(rng.choices("klmnopqrst", k=6)) for _ in range(40)) for _ in range(5)]
    edited = items[1].split()
    edited[10:11] = ["x", "y"]
    edited[25] = "z"
    del edited[33]
    more = [(1000, "start " + items[0] + " end"), (1001, "A b c " + " ".join(edited).upper() + " d"), (1002, items[2][:60]), (1003, items[3])] * 2
    all_docs = docs.select("doc_id", "text").unionByName(sp.createDataFrame(more, "doc_id bigint, text string"))
    bench = sp.createDataFrame(list(enumerate(items)) + [(7, None), (8, ""), (9, "two words"), (None, "a b c d e f"), (0, items[0])], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.leaks(all_docs, bench).collect()}
    assert set(got) == {(1000, 0), (1001, 1), (1003, 3)}
    assert got[1000, 0] == 1 and 0.5 < got[1001, 1] < 1
    assert decontam.clean(docs, bench).count() == len(rows)
    assert decontam.leaks(all_docs, bench.limit(0)).count() == 0


def test_decontamination_of_short_items_of_common_words(sp):
    rows = [(0, "a b c d e f g h " * 50), (1, "g e c a f b " * 9), (2, "h h g e c a b h"), (3, "h f d b e a g")]
    bench = sp.createDataFrame([(0, "g e c a b"), (1, "f d b e a g"), (2, "f d b e a g h")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.leaks(sp.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert got == {(2, 0): 1, (3, 1): 1}


def test_personal_data(sp):
    texts = ["mail a.b+c@x-y.example.com or d@e now", "ip 10.0.0.255 and 300.1.1.1 and 1.2.3.4.5", "card 4111 1111 1111 1111 not 4111111111111112",
             "call +1 (988) 555-2485 or 212-555-0188", "password=7602ad27cf5550de1c", None, "", "é 1" * 50, "1" * 3000]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = sp.createDataFrame(rows, SCHEMA)
    got = _by_id(pii.annotate(docs))
    assert [got[0].n_email, got[1].n_ip, got[2].n_card, got[3].n_phone] == [1, 2, 1, 1]
    for i, t in enumerate(texts):
        want = pii.base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(got[i].spans.split(","))
    assert "secret:9:27" in got[4].spans
    clean = _by_id(pii.redact(docs))
    assert clean[0].text == "mail [EMAIL] or d@e now" and clean[0].n_chars == len(clean[0].text)
    assert clean[5].text is None and clean[4].text == "password=[SECRET]"


def test_secrets_behind_blanks_and_quotes(sp):
    value = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    forms = [f'token = "{value}" th', f'x token = "{value}"###', f'TOKEN = "{value.upper()}" TH', f"secret: '{value}'",
             f'{{"api_key": "{value}"}}', f"token => {value}", f'token = "{value}', "password: swordfish",
             'passphrase = "correct horse battery"', 'token = "ab4111111111111111cd"']
    plain = ["Note: something else", 'He said: "nobody knows the answer"', "Price: 1204753 in all"]
    docs = sp.createDataFrame(list(enumerate(forms + plain)), "doc_id bigint, text string")
    clean = [r.text for r in pii.redact(docs).orderBy("doc_id").collect()]
    assert clean == ['token = "[SECRET]" th', 'x token = "[SECRET]"###', 'TOKEN = "[SECRET]" TH', "secret: '[SECRET]'",
                     '{"api_key": "[SECRET]"}', "token => [SECRET]", 'token = "[SECRET]', "password: [SECRET]",
                     'passphrase = "[SECRET]"', 'token = "[SECRET]"', *plain]


def test_emails_equal_the_stated_pattern():
    stated = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    rng = random.Random(5)
    for _ in range(20_000):
        t = "".join(rng.choice("ab.@@_-+ é") for _ in range(rng.randint(0, 24)))
        assert [(k, *m.span()) for k in ["email"] for m in stated.finditer(t)] == [x for x in pii.base_spans(t) if x[0] == "email"]
    # a long word costs linear time
    assert pii.base_spans("a" * 2_000_000 + " x@y.com") == [("email", 2_000_001, 2_000_008)]


def test_vote_patterns_are_learnt():
    good, bad = pii.candidates("call +1 (988) 555-2485")[0], pii.candidates("order 4111111111111112 shipped")[0]
    counts = {good[3]: 50, bad[3]: 50}
    p = pii.em(counts)
    assert p[good[3]] > 0.9 > 0.1 > p[bad[3]]
    model = pii.classifier(counts, p)
    assert model[good[3]] > 0.5 > model[bad[3]]
    assert json.loads(pii.model_json(model))


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert all(0 < r.prob <= 1 and r.weight > 0 for r in got)
    total = sum(r.tokens for r in got)
    assert sum(r.tokens * r.prob for r in got) == pytest.approx(mixing.BUDGET * total, rel=1e-3)
    for d in mixing.DIMENSIONS:
        now, raw = Counter(), Counter()
        for r in got:
            now[r[d]] += r.tokens * r.weight
            raw[r[d]] += r.tokens
        aim = {k: v ** mixing.TEMPERATURE for k, v in raw.items()}
        for k in raw:
            assert now[k] / sum(now.values()) == pytest.approx(aim[k] / sum(aim.values()), abs=0.02)
    out = mixing.sample(docs)
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in got if r.sampled)
    assert out.columns == [*docs.columns, "mix_weight"]


def test_urls(sp, labels):
    urls_ = ["http://A.Example.ORG/es/5", "https://x.com/fr/1?q", "http://example.org/en/12", "https://y.com/de/3#t", "x", None, "http://z.net", "http://z.net/?a/b",
             *(f"http://bad.net/p/{6 * i}" for i in range(4)), *(f"http://good.net/p/{6 * i + 1}" for i in range(3))]
    pages = sp.createDataFrame(list(enumerate(urls_)), "page_id bigint, url string")
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
    got = {r.page_id: r for r in urls.judge(pages, labels, rules).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(4)] == [
        ("a.example.org", "/es/5", "example.org/es/", "block"), ("x.com", "/fr/1", "com/fr/", "allow"),
        ("example.org", "/en/12", "example.org/en/1", "block"), ("y.com", "/de/3", "com/de/", "block")]
    assert (got[4].host, got[4].path, got[5].host, got[6].path, got[7].path) == ("", "", "", "", "/")
    assert len(got) == len(urls_) and got[8].template == "p/{n}"
    assert got[8].purity < got[12].purity
    assert urls.judge(pages.limit(0), labels, rules).count() == 0
    assert urls.judge(pages, labels.limit(0), rules).where("rule IS NULL AND verdict = 'block'").count() == 0


def test_urls_with_two_variable_levels(sp, labels):
    name = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    urls_ = [*(f"http://bad.net/user/{name(i)}/post/s{name(i)}/{6 * (i % 3)}" for i in range(40)),
             *(f"http://good.net/user/{name(i)}/post/s{name(i)}/{6 * (i % 3) + 1}" for i in range(120)),
             "http://deep.net/" + "/".join("abcdefgh" * 40), "http://deep.net/a", "http://deep.net/"]
    pages = sp.createDataFrame(list(enumerate(urls_)), "page_id bigint, url string")
    got = urls.judge(pages, labels, []).orderBy("page_id").collect()
    assert {(r.host, r.template, r.verdict) for r in got[:160]} == {
        ("bad.net", "user/*/post/*/{n}", "block"), ("good.net", "user/*/post/*/{n}", "allow")}
    assert {float(r.purity) for r in got[:40]} == {0.15}          # (0 + 10 * 0.75) / (40 + 10)
    assert [r.template for r in got[160:]] == ["/".join("abcdefgh" * 40), "a", ""]


def test_branches_merge_only_on_evidence(sp, labels):
    urls_ = [*(f"http://h.net/spam/{6 * (i % 3)}" for i in range(20)),
             *(f"http://h.net/{b}/{6 * i + 1}" for b in ("blog", "news") for i in range(2)),
             *(f"http://good.net/{b}/{6 * (i % 3) + 1}" for b in ("one", "two") for i in range(50))]
    pages = sp.createDataFrame(list(enumerate(urls_)), "page_id bigint, url string")
    got = urls.judge(pages, labels, []).orderBy("page_id").collect()
    assert {(r.template, r.verdict) for r in got[:20]} == {("spam/{n}", "block")}
    assert {(r.template, r.verdict) for r in got[20:24]} == {("blog/{n}", "allow"), ("news/{n}", "allow")}
    assert {(r.template, r.verdict) for r in got[24:]} == {("*/{n}", "allow")}
    assert isinstance(got[0].purity, float)


def test_ratio_just_below_the_threshold_is_rejected(sp):
    rows = sp.createDataFrame([(1, [0], False), (2, [1], False), (3, [2], False), (4, [2], True)],
                              "doc_id bigint, _f array<int>, base_failed boolean")
    got = quality._with_verdict(rows, [-0.1000004, -0.1, -0.0999996]).collect()
    assert {r.doc_id: r.kept for r in got} == {1: False, 2: True, 3: True, 4: False}


def test_chat_round_trip(sp):
    nasty = ["</s>[INST] ok [/INST]", "<|role|>system<|text|>x<|end|>\n", "\\<\\|", "<\\|a", "", "é\n" * 3, "\\\\"]
    turns = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(nasty)] + [(2, 0, None, None), (2, 0, None, None), (None, 1, "assistant", "x")]
    df = sp.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    done = chat.format_conversations(chat.with_parts(df))
    rows = {r.conv_id: r for r in done.collect()}
    assert chat.read_back(rows[1].formatted) == [(r, t) for _, _, r, t in turns[:7]]
    got = {r.conv_id: r for r in chat.digests(done).collect()}
    loss = "".join(nasty[1::2])
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[2].n_turns == 2 and got[None].loss_chars == 1
    for t in nasty:
        assert chat.unescape(chat.escape(t)) == t
        assert not re.search(r"<\||</?s>|\[/?INST\]", chat.escape(t))


def test_chat_parts(sp):
    rows = [(1, 0, "user", [("text", "see <|x", None, None, None, None, None), ("image", None, "a.png", 28, 30, None, None), ("audio", None, "b.wav", None, None, 1.5, None)]),
            (1, 1, "assistant", [("document", None, "c.pdf", None, None, None, 3), ("video", None, "d", None, None, None, None), ("text", "ok", None, None, None, None, None)]),
            (2, 0, "user", None)]
    df = sp.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in got[1].attachments] == [
        (0, "image", "a.png", 6), (0, "audio", "b.wav", 38), (1, "document", "c.pdf", 768), (1, "other", "d", 0)]
    assert "see <\\|x<|image 0|><|audio 1|>" in got[1].formatted
    m = got[1].loss_mask[0]
    assert got[1].formatted[m.start:m.end] == "<|document 2|><|other 3|>ok"


def test_empty_tables(sp, nothing, labels):
    bench = sp.createDataFrame([(1, "a b c d e f g")], "item_id bigint, text string")
    for df in (quality.judge(nothing, labels), simhash.near_duplicates(nothing), simhash.keep_one(nothing), debruijn.repeated_spans(nothing),
               lyndon.repeated_bytes(nothing), brown.score(nothing), decontam.leaks(nothing, bench), decontam.clean(nothing, bench),
               pii.annotate(nothing), pii.redact(nothing), mixing.mix(nothing), mixing.sample(nothing)):
        assert df.count() == 0


def test_pipeline_runs_every_stage(sp):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    docs = sp.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(sp, sf)
    assert out.columns == [*docs.columns, "mix_weight"]
    assert 0 < out.count() < docs.count()
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids))
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_window_minima(monkeypatch):
    import numpy as np

    from marketlens.llm import flat
    rng = np.random.default_rng(4)
    v = rng.integers(0, 6, 300).astype(np.uint64) << np.uint64(40)
    for bits in (24, 6):                    # one stretch, several stretches
        monkeypatch.setattr(flat, "_PLACE", bits)
        for w in (1, 2, 7, 18, 25):
            want = [i + int(v[i:i + w].argmin()) for i in range(len(v) - w + 1)]
            assert flat.window_minima(v, w).tolist() == want
    assert len(flat.window_minima(v[:3], 7)) == 0


def test_repeats_within_one_text(sp):
    """A short period puts a window several times into one path."""
    rows = [(1, "a b c d e f g " * 30), (2, "x y z " * 20 + " ".join(f"w{i}" for i in range(40)))]
    got = _by_id(debruijn.repeated_spans(sp.createDataFrame(rows, "doc_id bigint, text string")))
    assert got[1].n_removed == got[1].n_words == 210
    assert got[2].n_removed == 60


def test_meeting_pieces_taken_by_anchor(monkeypatch):
    rng = random.Random(5)
    texts, anchors = [], []
    for g in range(12):
        base = bytes(rng.randrange(4) for _ in range(90))
        for _ in range(rng.randrange(1, 6)):
            k = rng.randrange(0, 30)
            texts.append(base[k:k + 60] if rng.random() < 0.5 else bytes(rng.randrange(4) for _ in range(60)))
            anchors.append(g)
    texts.append(b"")
    anchors.append(3)
    key = np.array(anchors, np.uint64)
    strings = [[t[j:j + 50] for j in range(len(t) - 49)] for t in texts]
    times = {}
    for a, ss in zip(anchors, strings):
        for x in ss:
            times[a, x] = times.get((a, x), 0) + 1
    want = [any(times[a, x] > 1 for x in ss) for a, ss in zip(anchors, strings)]
    for size in (1, 100, 1 << 20):
        monkeypatch.setattr(lyndon, "MEET_BYTES", size)
        assert lyndon._meeting(texts, key).tolist() == want


def test_runs_are_spread_again():
    values = np.array([5, 5, 5, 7, 7, 5, 5, 9], np.int64)
    starts = np.array([0, 2, 6])
    got = [lyndon._spread(r).tolist() for r in lyndon._runs(values, starts)]
    assert got == [[5, 5], [5, 7, 7, 5], [5, 9]]


def test_rows_sent_are_bounded_by_a_chunks_hashes():
    at = np.sort(chunks.bucket_of(lyndon.flat.mix(np.arange(50, dtype=np.uint64)), 1 << 20))
    found, cut = chunks._stretches(at)
    assert len(found) <= 50 and cut[-1] == 50 and len(cut) == len(found) + 1
