"""Mixing to target weights: iterative proportional fitting of token weights to source, language
and topic marginals, then documents sampled by calibrated probabilities. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import broadcast_if_small, table

#: Topic of a document: the first rule whose pattern its whole text matches, else "prose".
TOPICS = (("licence", r"(?i)licen[cs]ed? "), ("contact", r"@|\+[0-9]"), ("figures", r"[0-9]{3}"))
DIMENSIONS = ("source", "lang", "topic")
#: A marginal's target share is its token share to this power, normalised: small groups gain weight.
TEMPERATURE = 0.7
#: Expected share of the tokens that is sampled.
BUDGET = 0.5
ROUNDS = 10
SEED = 11


def with_topic(docs: DataFrame) -> DataFrame:
    topic = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        topic = F.when(F.col("text").rlike(pattern), name).otherwise(topic)
    return docs.withColumn("topic", F.when(F.col("text").isNull(), "prose").otherwise(topic))


def measured(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, lang, topic, tokens)``; null source or language is a group of its own, named
    by the empty string; tokens are whitespace words, at least 1, so no row is without weight."""
    return with_topic(docs.select("doc_id", "text", "source", "lang")).select(
        "doc_id", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")), "topic",
        F.expr(r"greatest(1L, bigint(regexp_count(coalesce(text, ''), r'[^ \t-\r]+')))").alias("tokens"))


def targets(cells: DataFrame, dimension: str, temperature: float = TEMPERATURE) -> DataFrame:
    """Target token total of each value of a dimension; the totals of every dimension agree."""
    by = cells.groupBy(dimension).agg(F.sum("tokens").alias("t"))
    raised = by.select(dimension, F.pow("t", F.lit(temperature)).alias("r"))
    return raised.select(dimension, (F.col("r") * F.lit(raised.agg(F.sum("r")).first()[0] or 1.0) ** -1).alias("share"))


def rake(cells: DataFrame, aims: dict[str, DataFrame], total: float, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (a row per source, language and topic, with ``tokens``) with the raked ``weight`` of a
    token. Each round scales the weights to each dimension's targets in turn; every step is a written
    table, so its plan is one total and one join, and the driver holds no more than that at a time.
    Hot values cost nothing extra: totals are partially aggregated and joined back."""
    out = cells.withColumn("weight", F.lit(1.0))
    for d, aim in aims.items():
        out = out.join(aim.withColumnRenamed("share", f"_{d}"), d)
    out = table(out, "cells")
    for _ in range(rounds):
        for d in aims:
            factor = (out.groupBy(d).agg(F.sum(F.expr("tokens * weight")).alias("now"), F.max(f"_{d}").alias("share"))
                      .select(d, (F.col("share") * total / F.col("now")).alias("factor")))
            out = table(out.join(factor, d).withColumn("weight", F.expr("weight * factor")).drop("factor"), "cells")
    return out.drop(*(f"_{d}" for d in aims))


def calibrate(cells: DataFrame, budget: float) -> DataFrame:
    """``prob`` per cell: the weight scaled so that the expected tokens meet the budget, at most 1.
    Cells at 1 leave their surplus to the others (water filling, a few passes)."""
    scale = 1.0
    for _ in range(20):
        row = cells.agg(F.sum("tokens").alias("all"),
                        F.sum(F.expr(f"CASE WHEN weight * {scale!r} >= 1 THEN tokens ELSE 0 END")).alias("full"),
                        F.sum(F.expr(f"CASE WHEN weight * {scale!r} < 1 THEN tokens * weight ELSE 0 END")).alias("rest")).first()
        if not row["all"] or not row["rest"]:
            break
        new = max(0.0, budget * row["all"] - row["full"]) / row["rest"]
        if abs(new - scale) <= 1e-9 * scale:
            break
        scale = new
    return cells.withColumn("prob", F.expr(f"least(1D, weight * {scale!r})"))


def _plan(docs: DataFrame, budget: float, temperature: float) -> DataFrame:
    """The raked and calibrated cells: ``(source, lang, topic, weight, prob)``."""
    cells = table(measured(docs).groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    aims = {d: targets(cells, d, temperature) for d in DIMENSIONS}
    return table(calibrate(rake(cells, aims, float(total)), budget).drop("tokens"), "cells")


_DRAWN = f"shiftrightunsigned(xxhash64(doc_id, {SEED}), 11) / 9007199254740992D < prob"


def mix(docs: DataFrame, budget: float = BUDGET, temperature: float = TEMPERATURE) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source, lang)``: its cell, tokens, raked weight,
    sampling probability and whether it is sampled.

    A document is sampled if a fixed hash of its doc_id, as a number in [0, 1), is below its
    probability: repeated rows and reruns agree. Null text counts as one token of prose, null source
    or language as the value ''. An empty table gives no rows; further columns are not read."""
    known = broadcast_if_small(_plan(docs, budget, temperature))
    return (measured(docs).join(known, [*DIMENSIONS]).withColumn("sampled", F.expr(_DRAWN))
            .select("doc_id", *DIMENSIONS, "tokens", F.round("weight", 6).alias("weight"),
                    F.round("prob", 6).alias("prob"), "sampled"))


def sample(docs: DataFrame, budget: float = BUDGET, temperature: float = TEMPERATURE) -> DataFrame:
    """The sampled documents with all their columns, and ``mix_weight``, the inverse of the
    probability: sums weighted by it estimate the whole corpus. A ``mix_weight`` that ``docs`` has
    already, from an earlier sample, is replaced."""
    docs = docs.drop("mix_weight")
    known = broadcast_if_small(_plan(docs, budget, temperature).select(
        *(F.col(d).alias(f"_{d}") for d in DIMENSIONS), "prob"))
    rows = with_topic(docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", "source", "lang"))
    return (rows.join(known, F.expr("coalesce(cast(source as string), '') = _source AND "
                                    "coalesce(cast(lang as string), '') = _lang AND topic = _topic"))
            .where(_DRAWN).select("_row.*", F.expr("1 / prob").alias("mix_weight")))
