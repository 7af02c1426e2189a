"""Filtering stages judge rows by their texts: shared ids, missing ids and further columns lose nothing clean."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import brown, decontam, mixing, simhash
from marketlens.llm.common import prepare

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def sp(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    prepare(spark, 16)
    yield spark
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def _say(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))


def _rows(*pairs):
    return [(i, t, "en", "s", len(t or "")) for i, t in pairs]


def test_clean_keeps_rows_that_share_an_id_with_a_leak(sp):
    item = _say(1, 30)
    rows = _rows((None, _say(2)), (None, f"{_say(3)} {item} {_say(4)}"), (None, _say(5)), (5, _say(6)), (5, f"{item} {_say(7)}"),
                 (6, None), (None, None), (7, ""))
    docs = sp.createDataFrame(rows, SCHEMA).withColumn("_bad", F.lit("x"))
    got = decontam.clean(docs, sp.createDataFrame([(1, item)], "item_id bigint, text string"))
    assert got.columns == docs.columns
    want = sorted(str(r[:2]) for r in rows if not (r[1] and item in r[1]))
    assert sorted(str((r.doc_id, r.text)) for r in got.collect()) == want and len(want) == 6
    assert decontam.clean(docs.where(F.lit(False)), sp.createDataFrame([(1, item)], "item_id bigint, text string")).count() == 0


def test_keep_one_judges_rows_by_their_texts(sp):
    a, b, c = _say(11), _say(12), _say(13)
    rows = _rows((1, a), (1, b), (None, c), (None, c), (4, c), (9, a), (None, a), (3, None), (2, ""), (8, b), (8, b))
    docs = sp.createDataFrame(rows, SCHEMA).withColumn("m", F.create_map(F.lit("k"), "doc_id")).withColumn("_key", F.lit(1)) \
        .withColumn("_row", F.lit(2)).repartition(3)
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns and got.schema["m"].dataType == docs.schema["m"].dataType
    # of each text the smallest id stays; unlike texts of one id both stay; wordless texts are one group
    assert sorted((r.doc_id, r.text or "") for r in got.collect()) == sorted([(1, a), (1, b), (4, c), (2, "")])


def test_keep_one_without_any_id(sp):
    a, b = _say(21), _say(22)
    got = simhash.keep_one(sp.createDataFrame(_rows((None, a), (None, a), (None, b)), SCHEMA)).collect()
    assert sorted(r.text for r in got) == sorted([a, b])
    assert simhash.keep_one(sp.createDataFrame([], SCHEMA)).collect() == []


def test_sampling_a_sample(sp):
    docs = sp.createDataFrame(_rows(*((i, _say(i, 20)) for i in range(200))), SCHEMA)
    once = mixing.sample(docs)
    twice = mixing.sample(once)
    assert once.columns == twice.columns == [*docs.columns, "mix_weight"]
    assert 0 < once.count() < 200 and once.agg(F.min("mix_weight")).first()[0] >= 1
    assert {r.doc_id for r in twice.collect()} <= {r.doc_id for r in once.collect()}


def test_a_raking_step_is_one_total_and_one_join(sp, monkeypatch):
    """The driver plans and broadcasts no more at a time, however many dimensions and rounds there are."""
    rows = [(i, _say(i, 5 + i % 7), ("en", "de", None)[i % 3], f"s{i % 4}", 1) for i in range(40)]
    cells = mixing.measured(sp.createDataFrame(rows, SCHEMA)).groupBy(*mixing.DIMENSIONS).agg(F.sum("tokens").alias("tokens")).localCheckpoint()
    aims = {d: mixing.targets(cells, d).localCheckpoint() for d in mixing.DIMENSIONS}
    plans = []
    monkeypatch.setattr(mixing, "table", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df.localCheckpoint())
    got = mixing.rake(cells, aims, 1000.0, 4)
    assert set(got.columns) == {*cells.columns, "weight"}
    assert len(plans) > 4 and all(p.count("Join") <= len(aims) and p.count("Aggregate") <= 1 for p in plans)
    want = {tuple(r[d] for d in mixing.DIMENSIONS): [r.tokens, 1.0] for r in cells.collect()}
    share = {d: {r[d]: r.share for r in aims[d].collect()} for d in aims}
    for _ in range(4):
        for k, d in enumerate(mixing.DIMENSIONS):
            now = {}
            for key, (n, w) in want.items():
                now[key[k]] = now.get(key[k], 0) + n * w
            for key, x in want.items():
                x[1] *= share[d][key[k]] * 1000 / now[key[k]]
    assert {tuple(r[d] for d in mixing.DIMENSIONS): r.weight for r in got.collect()} == pytest.approx({k: w for k, (_, w) in want.items()})


def test_class_exchange_never_shuffles_the_token_streams(sp, monkeypatch):
    """Each round brings the classes to the buckets of streams; the scan of the streams keeps its buckets."""
    kept = sp.conf.get("spark.sql.autoBroadcastJoinThreshold")
    sp.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans, table = [], brown.table
    monkeypatch.setattr(brown, "table", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or table(df, name))
    try:
        got = brown.score(sp.createDataFrame(_rows(*((i, _say(i % 9, 40)) for i in range(60))), SCHEMA))
        assert got.count() == 60
    finally:
        sp.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    rounds = [p for name, p in plans if name == "contexts"]
    assert len(rounds) > 2 and all("Bucketed: true" in p for p in rounds[1:])
    assert not [x.name for x in sp.catalog.listTables() if x.name.startswith("tokens_")]


def test_tokens_and_moves_in_blocks(monkeypatch):
    """Blocks bound the memory; they change no token and no move."""
    texts = [_say(i, 3 + 7 * (i % 5)).encode() for i in range(50)] + [b"", b" ", _say(99, 400).encode(), b""]
    row = {"blob": brown.zstandard.compress(b"".join(texts), 1), "sizes": [len(t) for t in texts]}
    rng = np.random.default_rng(1)
    n, size = 3000, 2 * brown._ALL
    sizes = rng.integers(1, 9, 2 * n)
    f = {"words": np.concatenate([np.arange(n)] * 2).astype(np.uint64), "own": np.concatenate([np.arange(n) % brown.CLASSES] * 2), "sizes": sizes,
         "code": np.concatenate([rng.choice(size, k, replace=False) for k in sizes]), "times": rng.integers(1, 5, sizes.sum())}
    t = rng.integers(100, 900, (brown._ALL, brown._ALL)).astype(float)
    tokens, ends = brown._tokens(row)
    best = brown.moves(f, t)
    monkeypatch.setattr(brown, "BLOCK_BYTES", 100)
    monkeypatch.setattr(brown, "BLOCK_WORDS", 1024)
    assert all((a == b).all() for a, b in zip(brown._tokens(row), (tokens, ends)))
    assert (brown.moves(f, t) == best).all() and (best != f["own"]).any() and len(ends) == len(texts)
