"""Q3 skill adjacency for every category: mean-centred cosine, exact top-k.

Plan
----
1. Centre: per-skill means (exact fixed-point sums) joined back on ``skill``;
   norms ``sqrt(sum(dev^2))`` per category.
2. Vectors: one row per category with its (skill, deviation) pairs, sorted by
   skill (bounded by the skill dimension).
3. Top-k (:mod:`marketlens.operators.neighbours`): blocks of similar direction with a centre and a
   radius; each target meets its own block, then only the blocks whose bound reaches its k-th
   similarity. Exact for any blocks; memory is bounded by the block size.
4. The spread (Q3j) needs every pair: categories are hashed into ``B`` blocks and replicated to the ``B``
   unordered block pairs that contain their block (the layout of a distributed matrix product).
5. Shared strengths (skills where both deviations are positive, ordered by the
   smaller deviation) are computed by Spark only for the selected pairs, from the
   two vectors of a pair (NULL when there are none).

``centered=False`` gives the raw cosine comparator (Q3j).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens import schema
from marketlens.functions.columns import exact_mean
from marketlens.operators import neighbours
from marketlens.session import shuffle_partitions

SPREAD_SCHEMA = "target_soc string, sim_min double, sim_max double, candidates long"


def centred(skills: DataFrame, centered: bool = True) -> DataFrame:
    """(soc_code, skill, importance, deviation)."""
    if not centered:
        return skills.withColumn("deviation", F.col("importance"))
    means = skills.groupBy("skill").agg(exact_mean("importance").alias("mean_importance"))
    return (skills.join(means, "skill")
            .select("soc_code", "skill", "importance",
                    (F.col("importance") - F.col("mean_importance")).alias("deviation")))


def vectors(dev: DataFrame) -> DataFrame:
    """One row per category: sorted skills, their deviations and the vector norm."""
    v = dev.groupBy("soc_code").agg(
        F.array_sort(F.collect_list(F.struct("skill", "deviation"))).alias("_v"),
        F.sqrt(F.sum(F.col("deviation") * F.col("deviation"))).alias("norm"))
    return v.select("soc_code", F.col("_v.skill").alias("skills"),
                    F.col("_v.deviation").alias("devs"), "norm")


#: ``(o, skill)`` of a pair's shared strengths in their order. Vectors over the same skills meet place by place, others
#: skill by skill; a skill that a side has twice counts for each.
SHARED = """
array_sort(CASE WHEN plain AND t_skills = c_skills THEN
    transform(filter(arrays_zip(t_skills, t_devs, c_devs), x -> x.t_devs > 0 AND x.c_devs > 0),
              x -> struct(-least(x.t_devs, x.c_devs) AS o, x.t_skills AS skill))
ELSE flatten(transform(filter(arrays_zip(t_skills, t_devs), x -> x.t_devs > 0),
    x -> transform(filter(arrays_zip(c_skills, c_devs), y -> y.c_skills = x.t_skills AND y.c_devs > 0),
                   y -> struct(-least(x.t_devs, y.c_devs) AS o, x.t_skills AS skill)))) END)
"""


MIN_BLOCK = 256      # below this many vectors a block product is all overhead


def _blocks(n_vectors: int, block_size: int, parallelism: int) -> int:
    """Blocks ``B``: enough that no block exceeds ``block_size`` vectors (memory
    bound), up to ``sqrt(2 * parallelism)`` for parallelism (B(B+1)/2 groups), but
    not so many that blocks fall below ``MIN_BLOCK`` vectors."""
    by_size = math.ceil(n_vectors / max(1, block_size))
    by_parallelism = min(math.ceil(math.sqrt(2 * max(1, parallelism))),
                         max(1, math.ceil(n_vectors / MIN_BLOCK)))
    return max(1, by_size, by_parallelism)


def _matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Dense deviations (absent skill = 0) and the 0/1 presence matrix."""
    lengths = pdf["skills"].map(len).to_numpy()
    flat_sk = np.concatenate(pdf["skills"].to_numpy()) if len(pdf) else np.array([])
    flat_dv = (np.concatenate(pdf["devs"].to_numpy()).astype("float64")
               if len(pdf) else np.array([]))
    names, cols = np.unique(flat_sk, return_inverse=True)
    rows = np.repeat(np.arange(len(pdf)), lengths)
    m = np.zeros((len(pdf), len(names)))
    m[rows, cols] = flat_dv
    present = np.zeros((len(pdf), len(names)))
    present[rows, cols] = 1.0
    return m, present


def _pair_spreads(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per target of a block pair, the range of its similarities and their number."""
    pdf = pdf.reset_index(drop=True)
    lo, hi = int(pdf["_bi"].iat[0]), int(pdf["_bj"].iat[0])
    m, present = _matrix(pdf)
    socs = pdf["soc_code"].to_numpy().astype(object)
    norms = pdf["norm"].to_numpy().astype("float64")
    blk = pdf["_block"].to_numpy()
    sides = [(np.flatnonzero(blk == lo), np.flatnonzero(blk == hi))]
    if lo != hi:
        sides.append((sides[0][1], sides[0][0]))
    out = []
    for t_idx, c_idx in sides:
        if len(t_idx) == 0 or len(c_idx) == 0:
            continue
        dots = m[t_idx] @ m[c_idx].T
        shared = (present[t_idx] @ present[c_idx].T) > 0     # pairs meet only on a common skill
        denom = np.outer(norms[t_idx], norms[c_idx])
        with np.errstate(divide="ignore", invalid="ignore"):
            sims = np.where(denom != 0, dots / denom, np.nan)
        for r, t in enumerate(t_idx):
            valid = ~np.isnan(sims[r]) & shared[r] & (socs[c_idx] != socs[t])
            if valid.any():
                out.append((socs[t], float(np.min(sims[r][valid])), float(np.max(sims[r][valid])), int(valid.sum())))
    return pd.DataFrame(out, columns=["target_soc", "sim_min", "sim_max", "candidates"])


def _block_pairs(vec: DataFrame, blocks: int) -> DataFrame:
    b = F.pmod(F.xxhash64("soc_code"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    return (vec.withColumn("_block", b).withColumn("_other", other)
            .withColumn("_bi", F.least("_block", "_other"))
            .withColumn("_bj", F.greatest("_block", "_other"))
            .drop("_other"))


def neighbour_candidates(skills: DataFrame, limit: int = 8, centered: bool = True,
                         block_size: int | None = None) -> DataFrame:
    """Exact top-``limit`` (target_soc, soc_code, dot_product, similarity) rows."""
    return neighbour_search(skills, limit, centered, block_size).neighbours


def neighbour_search(skills: DataFrame, limit: int = 8, centered: bool = True,
                     block_size: int | None = None) -> neighbours.Search:
    """The same with what was scored for it; the rows don't depend on ``block_size``."""
    if limit < 1:
        raise ValueError(f"limit must be at least 1, got {limit}")
    return neighbours.search(vectors(centred(skills, centered)), limit, block_size)


def skill_adjacency(skills: DataFrame, limit: int = 8, centered: bool = True,
                    labels: DataFrame | None = None, block_size: int | None = None) -> DataFrame:
    """Q3 for every target: neighbours with similarity, shared strengths and labels."""
    search = neighbour_search(skills, limit, centered, block_size)
    # each pair meets its two vectors whole, so its shared strengths need no further grouping
    side = search.vectors.withColumn("plain", F.size(F.array_distinct("skills")) == F.size("skills"))
    t = side.select(F.col("soc_code").alias("target_soc"), F.col("skills").alias("t_skills"), F.col("devs").alias("t_devs"), "plain")
    c = side.select("soc_code", F.col("skills").alias("c_skills"), F.col("devs").alias("c_devs"))
    out = (search.neighbours.join(t, "target_soc").join(c, "soc_code").withColumn("_shared", F.expr(SHARED))
           .select("target_soc", "soc_code", "dot_product", "similarity",
                   F.size("_shared").cast("long").alias("shared_strength_count"),
                   F.expr("CASE WHEN size(_shared) > 0 THEN array_join(transform(_shared, x -> x.skill), ', ') END").alias("shared_strengths")))
    if labels is not None:
        out = out.join(labels.select("soc_code", "occupation", "occupation_group"),
                       "soc_code", "left")
    return out


def similarity_spread(skills: DataFrame, block_size: int = 2048) -> DataFrame:
    """Q3j: per target, range of raw vs centred cosine over all other categories."""
    def spread(centered: bool) -> DataFrame:
        vec = vectors(centred(skills, centered))
        blocks = _blocks(vec.count(), block_size, shuffle_partitions(skills.sparkSession))
        parts = (_block_pairs(vec, blocks).groupBy("_bi", "_bj")
                 .applyInPandas(_pair_spreads, SPREAD_SCHEMA))
        return parts.groupBy("target_soc").agg(F.min("sim_min").alias("lo"),
                                               F.max("sim_max").alias("hi"),
                                               F.sum("candidates").alias("candidates"))
    raw, cen = spread(False), spread(True)
    return (raw.select("target_soc", F.col("lo").alias("raw_min"), F.col("hi").alias("raw_max"), "candidates")
            .join(cen.select("target_soc", F.col("lo").alias("centered_min"),
                             F.col("hi").alias("centered_max")), "target_soc")
            .withColumn("raw_spread", F.col("raw_max") - F.col("raw_min"))
            .withColumn("centered_spread", F.col("centered_max") - F.col("centered_min")))


# ---------------------------------------------------------------- findings --
def adjacency_bench(adjacency: DataFrame) -> DataFrame:
    """nearest neighbour, its first three shared strengths, how many listed
    neighbours reach the strong cut, and the outcome class."""
    strong = F.col("similarity") >= schema.STRONG_ADJACENCY
    agg = adjacency.groupBy("target_soc").agg(
        F.min_by(F.struct("soc_code", "similarity", "shared_strengths"),
                 F.struct(-F.col("similarity"), F.col("soc_code"))).alias("_n"),
        F.count_if(strong).alias("strong_neighbours"))
    first3 = F.array_join(F.slice(F.split(F.coalesce(F.col("_n.shared_strengths"), F.lit("")),
                                          ", "), 1, 3), ", ")
    out = agg.select(
        "target_soc", F.col("_n.soc_code").alias("nearest_soc"),
        F.col("_n.similarity").alias("nearest_similarity"),
        F.when(F.length(first3) > 0, first3).alias("nearest_shared"),
        "strong_neighbours",
        F.when(F.col("strong_neighbours") > 1, F.lit("bench"))
        .when(F.col("_n.similarity") < schema.STRONG_ADJACENCY, F.lit("specialised"))
        .otherwise(F.lit("single")).alias("outcome"))
    shared = F.when(F.col("nearest_shared").isNotNull(),
                    F.concat(F.lit(", sharing strength in "), F.col("nearest_shared"))).otherwise(F.lit(""))
    tail = (F.when(F.col("outcome") == "bench",
                   F.concat(F.lit(" "), F.col("strong_neighbours").cast("string"),
                            F.lit(" listed neighbours reach 0.40: a real adjacent bench.")))
            .when(F.col("outcome") == "specialised",
                  F.lit(" No neighbour reaches 0.40: a specialised profile."))
            .otherwise(F.lit("")))
    return out.withColumn("finding", F.concat(
        F.lit("Closest: "), F.col("nearest_soc"), F.lit(" (similarity "),
        F.format_number("nearest_similarity", 2), F.lit(")"), shared, F.lit("."), tail))


def neighbours_of(skills: DataFrame, soc_code: str, limit: int = 8, centered: bool = True,
                  labels: DataFrame | None = None) -> DataFrame:
    """Q3 for one target: its K-row vector is joined to every other vector on
    ``skill`` and summed per candidate (work linear in categories x skills; the
    target side is one category's skills). Same result as the all-target form
    filtered to ``soc_code``."""
    if limit < 1:
        raise ValueError(f"limit must be at least 1, got {limit}")
    dev = centred(skills, centered)
    norms = dev.groupBy("soc_code").agg(
        F.sqrt(F.sum(F.col("deviation") * F.col("deviation"))).alias("norm"))
    t = dev.where(F.col("soc_code") == soc_code).select("skill", F.col("deviation").alias("t_dev"))
    c = dev.where(F.col("soc_code") != soc_code).select(
        "soc_code", "skill", F.col("deviation").alias("c_dev"))
    both = "c_dev > 0 AND t_dev > 0"
    pairs = (c.join(t, "skill").groupBy("soc_code").agg(
        F.sum(F.col("c_dev") * F.col("t_dev")).alias("dot_product"),
        F.count_if(F.expr(both)).alias("shared_strength_count"),
        F.expr(f"listagg(CASE WHEN {both} THEN skill END, ', ') "
               "WITHIN GROUP (ORDER BY least(c_dev, t_dev) DESC, skill)").alias("shared_strengths")))
    t_norm = norms.where(F.col("soc_code") == soc_code).select("norm").scalar()   # one value
    denom = F.col("norm") * t_norm
    scored = (pairs.join(norms, "soc_code")
              .withColumn("similarity", F.col("dot_product") / F.when(denom != 0, denom))
              .where(F.col("similarity").isNotNull()))
    out = (scored.orderBy(F.col("similarity").desc(), "soc_code").limit(limit)
           .select(F.lit(soc_code).alias("target_soc"), "soc_code",
                   "dot_product", "similarity",
                   "shared_strength_count", "shared_strengths"))
    if labels is not None:
        out = out.join(labels.select("soc_code", "occupation", "occupation_group"),
                       "soc_code", "left")
    return out
