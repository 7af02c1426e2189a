"""Pruned exact neighbours: the rows don't depend on the blocks, and structure saves work."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.operators import adjacency


def _skills(spark, vectors):
    rows = [(soc, f"s{j:02d}", float(x)) for soc, v in vectors.items() for j, x in enumerate(v) if x is not None]
    return spark.createDataFrame(rows, "soc_code string, skill string, importance double").repartition(4)


def _clustered(n=240, dim=6, groups=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    out = {f"c{i:03d}": (centres[i % groups] + 0.05 * rng.normal(size=dim)).tolist() for i in range(n)}
    out |= {f"copy{i}": out["c000"] for i in range(15)}          # ties
    out["zero"] = [0.0] * dim
    return out


def _brute(vectors, k):
    out = {}
    for a, x in vectors.items():
        found = []
        for b, y in vectors.items():
            pairs = [(p, q) for p, q in zip(x, y) if p is not None and q is not None]
            nx, ny = (sum(p * p for p in v if p is not None) ** 0.5 for v in (x, y))
            if a != b and pairs and nx and ny:
                found.append((-round(sum(p * q for p, q in pairs) / (nx * ny), 9), b))
        out[a] = [b for _, b in sorted(found)[:k]]
    return {a: b for a, b in out.items() if b}


def _got(search):
    out = {}
    for r in search.neighbours.collect():
        out.setdefault(r.target_soc, []).append((-round(r.similarity, 9), r.soc_code))
    return {a: [b for _, b in sorted(v)] for a, v in out.items()}


@pytest.mark.parametrize("size", [7, 20, 60, None])
def test_rows_do_not_depend_on_the_blocks(spark, size):
    vectors = _clustered()
    search = adjacency.neighbour_search(_skills(spark, vectors), 5, centered=False, block_size=size)
    assert _got(search) == _brute(vectors, 5)
    report = search.pairs_scored().first()
    # the vector without a length is no pair's end
    assert report.pairs == 255 * 254 and (report.scored < 0.8 * report.pairs if size else report.scored == report.pairs)


def test_vectors_without_structure_are_all_scored(spark):
    rng = random.Random(2)
    vectors = {f"r{i}": [rng.gauss(0, 1) for _ in range(30)] for i in range(60)}
    search = adjacency.neighbour_search(_skills(spark, vectors), 3, centered=False, block_size=10)
    assert _got(search) == _brute(vectors, 3) and search.blocks.count() > 3


def test_ragged_vectors_meet_on_a_common_skill(spark):
    vectors = {"a": [1.0, 2.0, None, None], "b": [2.0, 1.0, None, None], "c": [None, None, 1.0, 1.0], "d": [None, 1.0, 1.0, None]}
    for size in (1, 2, None):
        search = adjacency.neighbour_search(_skills(spark, vectors), 8, centered=False, block_size=size)
        assert _got(search) == _brute(vectors, 8)


def test_fewer_neighbours_than_asked_and_none(spark):
    few = {f"v{i}": [1.0, float(i)] for i in range(4)}
    for size in (1, 2, None):
        assert _got(adjacency.neighbour_search(_skills(spark, few), 8, centered=False, block_size=size)) == _brute(few, 8)
    empty = _skills(spark, few).where(F.lit(False))
    search = adjacency.neighbour_search(empty, 8)
    assert search.neighbours.collect() == [] and search.pairs_scored().first().scored == 0
    with pytest.raises(ValueError):
        adjacency.neighbour_search(empty, 0)


def test_blocks_meet_without_moving_their_rows(spark):
    """Candidates reach the targets of other blocks by reading the written blocks again, not by a shuffle per pair of blocks."""
    vectors = _clustered()
    search = adjacency.neighbour_search(_skills(spark, vectors), 5, centered=False, block_size=20)
    plan = search.neighbours._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "FlatMapCoGroups" not in plan


def test_shared_strengths_of_ragged_and_repeated_skills(spark):
    rows = [("a", "s1", 2.0), ("a", "s1", 3.0), ("a", "s2", 1.0), ("b", "s1", 2.5), ("b", "s2", 4.0), ("b", "s3", 1.0),
            ("c", "s1", -1.0), ("c", "s2", 1.5), ("c", "s3", 2.0), ("d", "s1", 1.0), ("d", "s2", 2.0), ("d", "s3", 3.0),
            (None, "s1", 1.0)]
    skills = spark.createDataFrame(rows, "soc_code string, skill string, importance double")
    got = {(r.target_soc, r.soc_code): (r.shared_strength_count, r.shared_strengths)
           for r in adjacency.skill_adjacency(skills, centered=False).collect()}
    assert len(got) == 12
    assert got["a", "b"] == (3, "s1, s1, s2") and got["b", "a"] == got["a", "b"]
    assert got["b", "d"] == (3, "s2, s1, s3") and got["c", "d"] == (2, "s3, s2") and got["a", "c"] == (1, "s2")
