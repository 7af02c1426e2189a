"""Quality rules: counted rules, then a hashed n-gram log-likelihood ratio between a trusted
multinomial and the raw corpus, normalised by length and cut at a fixed threshold.

DataFrame functions only. Everything about one text stays in its own row: no text is shuffled,
and a very long text costs time in proportion to n log n of its words."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import broadcast_if_small, labels_by_doc

#: Hash buckets of words and word pairs; the fitted weights are this many numbers, whatever the corpus.
BUCKETS = 1 << 14
#: Added to each bucket's count, in counts per million features.
SMOOTH = 1.0
#: A document whose mean log-likelihood ratio per feature is below this is rejected.
THRESHOLD = -0.1
MIN_WORDS = 50
#: Bits of a packed long that hold a window's place; longer texts take a slower exact form.
_PLACE = 20
_SPLIT = r"[ \t-\r]+"


def _with_words(df: DataFrame) -> DataFrame:
    """Adds ``_w`` (words) and ``_h`` (their hashes); null text has none."""
    return (df.withColumn("_w", F.expr(rf"array_remove(split(coalesce(text, ''), r'{_SPLIT}'), '')"))
            .withColumn("_h", F.expr("transform(_w, w -> xxhash64(w))")))


def _with_features(df: DataFrame) -> DataFrame:
    """Adds ``_f``: the hash buckets of every word and of every pair of adjacent words."""
    return df.withColumn("_f", F.expr(
        f"transform(_h, (h, i) -> int(pmod(h, {BUCKETS})))")).withColumn("_f", F.expr(
            f"concat(_f, transform(slice(_h, 2, greatest(size(_h) - 1, 0)), "
            f"(h, i) -> int(pmod(xxhash64(_h[i], h), {BUCKETS}))))"))


def _with_counts(df: DataFrame) -> DataFrame:
    """The counted rules' columns. Repeated windows are found by sorting packed (hash, place)
    longs; neighbours that agree in the packed bits are compared by their full hash."""
    mask = (1 << _PLACE) - 1
    full = "_g[int({0} & " + f"{mask})]"
    same = ("(shiftright({0}, %d) = shiftright({1}, %d) AND " % (_PLACE, _PLACE)
            + full.format("{0}") + " = " + full.format("{1}") + ")")
    packed = (
        "transform(filter(_s, (x, j) -> (j > 0 AND " + same.format("x", "_s[greatest(j - 1, 0)]")
        + ") OR (j < size(_s) - 1 AND " + same.format("x", "_s[least(j + 1, size(_s) - 1)]")
        + f")), x -> x & {mask}L)")
    wide = ("transform(filter(_l, (x, j) -> (j > 0 AND x.h = _l[greatest(j - 1, 0)].h) OR "
            "(j < size(_l) - 1 AND x.h = _l[least(j + 1, size(_l) - 1)].h)), x -> bigint(x.i))")
    short = f"size(_g) <= {mask}"
    return (
        df.withColumn("n_words", F.expr("bigint(size(_w))"))
        .withColumn("_g", F.expr(
            "CASE WHEN size(_h) < 3 THEN array() ELSE transform(slice(_h, 3, size(_h) - 2), "
            "(h, i) -> xxhash64(_h[i], _h[i + 1], h)) END"))
        .withColumn("_s", F.expr(
            f"CASE WHEN {short} THEN sort_array(transform(_g, (h, i) -> "
            f"shiftleft(shiftrightunsigned(h, {_PLACE + 1}), {_PLACE}) | bigint(i))) ELSE array() END"))
        .withColumn("_l", F.expr(
            f"CASE WHEN {short} THEN array() ELSE array_sort(transform(_g, (h, i) -> "
            "struct(h AS h, i AS i))) END"))
        .withColumn("_p", F.expr(f"sort_array(CASE WHEN {short} THEN {packed} ELSE {wide} END)"))
        .withColumn("n_repeat_words", F.expr(
            "aggregate(_p, struct(0L AS n, 0L AS e), (a, p) -> struct(a.n + p + 3 - greatest(a.e, p) AS n, "
            "p + 3 AS e), a -> a.n)"))
        .withColumn("_d", F.expr(r"filter(split(coalesce(text, ''), '\n'), x -> x rlike r'[^ \t-\r]')"))
        .withColumn("word_chars", F.expr("bigint(char_length(array_join(_w, '')))"))
        .withColumn("n_symbols", F.expr("bigint(regexp_count(coalesce(text, ''), '[#*$%&|<>]'))"))
        .withColumn("n_dup_lines", F.expr("bigint(size(_d) - size(array_distinct(_d)))"))
        .withColumn("base_failed", F.expr(
            f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words")))


def fit(docs: DataFrame, labels: DataFrame) -> list[float]:
    """Log ratio of each bucket's share in the trusted documents (quality 1, not toxic) to its
    share in the raw corpus; every document counts. ``BUCKETS`` numbers, so they may pass the driver."""
    good = (labels_by_doc(labels).where("quality = 1 AND coalesce(toxic, 0) = 0")
            .select(F.col("doc_id").alias("_id"), F.lit(1).alias("_good")))
    marked = docs.select("doc_id", "text").join(
        broadcast_if_small(good), F.col("doc_id") == F.col("_id"), "left")
    counts = (_with_features(_with_words(marked))
              # explode_outer: explode adds a filter on its input, which the optimiser then evaluates
              # below the projections, with their expressions nested in each other
              .select(F.explode_outer("_f").alias("b"), F.expr("coalesce(_good, 0)").alias("g"))
              .where("b IS NOT NULL").groupBy("b").agg(F.count("*").alias("raw"), F.sum("g").alias("trusted")).collect())
    raw, trusted = sum(r.raw for r in counts), sum(r.trusted for r in counts)
    weights = [0.0] * BUCKETS
    if raw and trusted:
        for r in counts:
            a, b = r.trusted * 1e6 / trusted, r.raw * 1e6 / raw
            weights[r.b] = math.log((a + SMOOTH) / (b + SMOOTH))
    return weights


def _with_verdict(df: DataFrame, weights: list[float]) -> DataFrame:
    """Adds ``llr`` and ``kept``. They leave through a generator, so that a filter on them is
    not evaluated below the projections (see ``fit``)."""
    return (df.withColumn("_weights", F.from_json(F.lit(json.dumps(weights)), "array<double>"))
            .withColumn("_llr", F.expr(
                "aggregate(_f, 0D, (a, b) -> a + _weights[b]) / greatest(size(_f), 1)"))
            .select("*", F.expr(f"inline_outer(array(struct(_llr AS llr, "
                                f"NOT base_failed AND _llr >= {THRESHOLD} AS kept)))")))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: the counts, ``base_failed``, ``llr`` and ``kept``.

    Null and empty texts have no words and fail the base rule. Without any trusted label every
    ratio is 0 and the base rules alone decide. Repeated rows are judged alike, each on its own;
    an empty table gives no rows; further columns are not read."""
    found = _with_counts(_with_features(_with_words(docs.select("doc_id", "text"))))
    return _with_verdict(found, fit(docs, labels)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "llr", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text")
    found = _with_counts(_with_features(_with_words(packed)))
    return _with_verdict(found, fit(docs, labels)).where("kept").select("_row.*")
