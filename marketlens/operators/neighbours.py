"""Exact top-k neighbours by cosine, skipping what cannot reach a target's list.

Vectors are dealt into blocks of similar direction; a block has a centre and the largest angle of a member
from it. A target first meets its own block, which gives it a k-th similarity to beat. Another block at the
angle ``a`` from the target, with radius ``r``, holds nothing more similar than ``cos(max(0, a - r))``: targets
go only to the blocks whose bound reaches their k-th similarity. Every pair is scored in one group at
most, so the union of the groups' lists holds the exact result whatever the blocks are. On vectors without
any structure the bounds exclude little, and the search is the blockwise product of all pairs.

What is shuffled and written grows with the vectors: blocks are written once, as one row each, and every block of
targets meets the written rows in a join that reads them again instead of moving them; only the pairs that reach a
target's k-th similarity so far leave the task.

Bounds on what is held: a Python task holds one block of targets, its ``k`` best, and one Arrow batch of candidate
blocks, ``block_rows`` each on average; the driver holds the centres, about ``sqrt(n) / 2`` vectors, which are also sent to every task.
"""

from __future__ import annotations

import math
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from marketlens.session import ensure_checkpoint_dir, shuffle_partitions

#: Vectors (the first by hash) that block centres are fitted on, rounds of the fit, most centres.
FIT_ROWS, FIT_ROUNDS, MAX_CENTRES = 4096, 4, 512
#: Fewer vectors than this are not worth a block of their own.
MIN_BLOCK = 2048
#: Room for rounding in a bound.
SLACK = 1e-7
#: Pairs computed at once.
_PAIRS = 1 << 17
#: Targets of a block multiplied at once.
_ROWS = 1024

PAIR = "target_soc string, soc_code string, dot_product double, similarity double"
#: One row a block: its rows by code, their deviations and presence (null: all) as matrices, the first k similarities of
#: each row in the block (``tops``) and the pairs of these (``found``).
BLOCK = ("block int, socs array<string>, m binary, present binary, tops binary, "
         "found array<struct<target_soc: string, soc_code: string, dot_product: double, similarity: double>>, centre array<double>, radius double")
BLOCK_FIELDS = ["block", "socs", "m", "present", "tops", "found", "centre", "radius"]


class Search(NamedTuple):
    neighbours: DataFrame      # target_soc, soc_code, dot_product, similarity
    probes: DataFrame          # soc_code, block, kth, probe: the other blocks that a target met
    blocks: DataFrame          # block, n
    vectors: DataFrame         # soc_code, skills, devs: the rows of the search

    def pairs_scored(self) -> DataFrame:
        """One row: ``pairs`` (ordered, of all vectors), ``scored`` and ``share``."""
        sizes = self.blocks.select(F.col("block").alias("_b"), "n")
        own = self.blocks.agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("own"), F.sum("n").alias("total"))
        other = (self.probes.select(F.explode("probe").alias("_b")).groupBy("_b").count()
                 .join(sizes, "_b").agg(F.sum(F.col("count") * F.col("n")).alias("other")))
        out = (own.select((F.col("total") * (F.col("total") - 1)).alias("pairs"), "own", F.lit(None).cast("bigint").alias("other"))
               .unionByName(other.select(F.lit(None).cast("bigint").alias("pairs"), F.lit(None).cast("bigint").alias("own"), "other"))
               .agg(F.max("pairs").alias("pairs"), (F.coalesce(F.max("own"), F.lit(0)) + F.coalesce(F.max("other"), F.lit(0))).alias("scored")))
        return out.withColumn("share", F.col("scored") / F.col("pairs"))


def _dense(t: pa.Table | pa.RecordBatch, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Deviations (absent skill: 0) and which skills are present."""
    skills, devs = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (t.column("skills"), t.column("devs")))
    cols = pc.index_in(skills.flatten(), value_set=names).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(skills)), skills.value_lengths().to_numpy(zero_copy_only=False))
    m, present = (np.zeros((len(skills), len(names))) for _ in range(2))
    m[rows, cols] = devs.flatten().to_numpy(zero_copy_only=False)
    present[rows, cols] = 1.0
    return m, present


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm > 0, norm, 1)


def _fit(sample: np.ndarray, n: int) -> np.ndarray:
    """Spherical k-means from rows spread over the sample."""
    unit = _unit(sample)
    centres = unit[np.linspace(0, len(unit) - 1, min(n, len(unit))).astype(int)]
    for _ in range(FIT_ROUNDS):
        sums = np.zeros_like(centres)
        np.add.at(sums, (unit @ centres.T).argmax(axis=1), unit)
        filled = (sums != 0).any(axis=1)
        centres[filled] = _unit(sums[filled])
    return centres


class _Side(NamedTuple):
    """One side of a product: deviations, presence (None: every skill in every row), lengths, rounded unit vectors and
    the rows that are no pair's end."""
    m: np.ndarray
    present: np.ndarray | None
    norm: np.ndarray
    unit: np.ndarray
    dead: np.ndarray

    @staticmethod
    def of(m: np.ndarray, present: np.ndarray | None) -> _Side:
        norm = np.sqrt(np.einsum("ij,ij->i", m, m))
        unit = _unit(m)
        dead = ~(norm > 0) | np.isnan(unit).any(axis=1)
        unit = np.where(dead[:, None], 0, unit).astype(np.float32)
        return _Side(m, None if present is None or present.all() else present.astype(np.float32), norm, unit, np.flatnonzero(dead))


def _best(t: _Side, c: _Side, k: int, least: np.ndarray, same: bool = False) -> tuple:
    """``(row, column, dot product, similarity)`` of each target's first ``k`` candidates that reach its ``least``, by
    similarity, then by column (a block's rows are in the order of their codes). A pair needs a common skill and two
    lengths; ``same``: the candidates are the targets.

    A product of rounded unit vectors finds the pairs that can matter, with room for its rounding; those pairs are
    computed again one by one in doubles, which gives equal vectors equal similarities in any block."""
    found, room = [], SLACK + (t.m.shape[1] + 8) * 1.2e-7
    for a in range(0, len(t.m), _ROWS):
        z = min(a + _ROWS, len(t.m))
        sims = t.unit[a:z] @ c.unit.T
        if t.present is not None or c.present is not None:
            sides = [np.ones(x.m.shape, np.float32) if x.present is None else x.present for x in (t, c)]
            sims[~(sides[0][a:z] @ sides[1].T > 0)] = -np.inf
        sims[:, c.dead] = -np.inf
        sims[t.dead[(t.dead >= a) & (t.dead < z)] - a] = -np.inf
        if same:
            sims[np.arange(z - a), np.arange(a, z)] = -np.inf
        from_ = least[a:z] - room
        at = sims >= from_[:, None]
        if sims.shape[1] > k and at.sum() > 4 * k * (z - a):
            at = sims >= np.maximum(from_, np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k] - room)[:, None]
        row, col = np.nonzero(at & (sims > -np.inf))
        row += a
        dot = np.empty(len(row))
        for x in range(0, len(row), _PAIRS):
            part = slice(x, x + _PAIRS)
            dot[part] = np.einsum("ij,ij->i", t.m[row[part]], c.m[col[part]])
        sim = dot / (t.norm[row] * c.norm[col])
        keep = np.flatnonzero(sim >= least[row])
        keep = keep[np.lexsort((col[keep], -sim[keep], row[keep]))]
        keep = keep[_nth(row[keep]) < k]
        found.append((row[keep], col[keep], dot[keep], sim[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _nth(row: np.ndarray) -> np.ndarray:
    """The place of each entry among those of its row; ``row`` is sorted."""
    return np.arange(len(row)) - np.searchsorted(row, row)


def _table(row: np.ndarray, sim: np.ndarray, n: int, k: int) -> np.ndarray:
    """Similarities by row, at most ``k`` each, the highest first; below any similarity where there are fewer."""
    out = np.full((n, k), -2.0)
    out[row, _nth(row)] = sim
    return out


def _laid_out(vec: DataFrame, names: pa.Array, rows: int, n: int) -> DataFrame:
    """``vec`` with its ``block``: the nearest centre, large cells split by hash."""
    sample = vec.orderBy(F.xxhash64("soc_code")).limit(FIT_ROWS).select("skills", "devs").toArrow()
    centres = _fit(_dense(sample, names)[0], min(MAX_CENTRES, -(-n // rows)))

    def assign(batches):
        for b in batches:
            cell = (_unit(_dense(b, names)[0]) @ centres.T).argmax(axis=1)
            yield b.append_column("cell", pa.array(cell, pa.int32()))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vec.schema)
    dealt = vec.mapInArrow(assign, f"{fields}, cell int").checkpoint(eager=True)
    first, parts = 0, []
    for r in sorted(dealt.groupBy("cell").count().collect()):
        many = -(-r["count"] // rows)
        parts.append(f"WHEN {r['cell']} THEN {first}L + pmod(xxhash64(soc_code), {many}L)")
        first += many
    return dealt.withColumn("block", F.expr(f"CAST(CASE cell {' '.join(parts)} END AS INT)")).drop("cell")


def search(vec: DataFrame, k: int, block_rows: int | None = None) -> Search:
    """The first ``k`` neighbours of every row of ``vec(soc_code, skills, devs, norm)`` with a norm above 0, by cosine
    (higher first, then by code), among the rows that share a skill with it."""
    ensure_checkpoint_dir(vec.sparkSession)
    counted = Observation()
    vec = (vec.where("norm > 0 AND soc_code IS NOT NULL").select("soc_code", "skills", "devs")
           .observe(counted, F.count(F.lit(1)).alias("n")).checkpoint(eager=True))
    n = counted.get["n"]
    names = pa.array(sorted(r[0] for r in vec.select(F.explode("skills")).distinct().collect()), pa.string())
    rows = block_rows or max(MIN_BLOCK, math.ceil(2 * math.sqrt(n)))
    laid = _laid_out(vec, names, rows, n) if n > rows else vec.withColumn("block", F.lit(0))

    def own(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(np.array(t.column("soc_code").to_pylist(), object), kind="stable")))
        m, present = _dense(t, names)
        side = _Side.of(m, present)
        row, col, dot, sim = _best(side, side, k, np.full(len(m), -2.0), same=True)
        unit = _unit(m)
        centre = _unit(unit.sum(axis=0, keepdims=True))[0]
        radius = float(np.arccos(np.clip(unit @ centre, -1, 1)).max())
        socs = t.column("soc_code").combine_chunks()
        pairs = pa.StructArray.from_arrays([socs.take(pa.array(row)), socs.take(pa.array(col)), pa.array(dot), pa.array(sim)],
                                           ["target_soc", "soc_code", "dot_product", "similarity"])
        return pa.Table.from_arrays(
            [t.column("block").slice(0, 1), _one(socs), pa.array([m.tobytes()], pa.binary()),
             pa.array([None if side.present is None else present.astype(bool).tobytes()], pa.binary()),
             pa.array([_table(row, sim, len(m), k).tobytes()], pa.binary()), _one(pairs), pa.array([centre], pa.list_(pa.float64())), pa.array([radius])],
            BLOCK_FIELDS)
    blocks = _written(laid.groupBy("block").applyInArrow(own, BLOCK))

    heads = sorted(blocks.select("block", "centre", "radius").collect())
    sizes = blocks.select("block", F.size("socs").cast("long").alias("n"))
    at_home = blocks.select(F.inline("found"))
    ids = np.array([r["block"] for r in heads], np.int64)
    centres = np.array([r["centre"] for r in heads]).reshape(len(heads), len(names))
    radius = np.array([r["radius"] for r in heads])

    def needed(row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """A block's k-th similarities, and which other blocks can reach them."""
        m, tops = (np.frombuffer(row.column(c)[0].as_buffer()) for c in ("m", "tops"))
        kth = tops.reshape(-1, k)[:, -1]
        angle = np.arccos(np.clip(_unit(m.reshape(-1, len(names))) @ centres.T, -1, 1))
        return kth, (np.cos(np.maximum(0, angle - radius)) + SLACK >= kth[:, None]) & (ids != row.column("block")[0].as_py())

    def probe(batches):
        for row in _each(batches):
            kth, need = needed(row)
            yield pa.RecordBatch.from_arrays(
                [row.column("socs").flatten(), pa.array(np.full(len(kth), row.column("block")[0].as_py()), pa.int32()),
                 pa.array([x if x > -2 else None for x in kth.tolist()], pa.float64()), pa.array([ids[x] for x in need], pa.list_(pa.int32()))],
                ["soc_code", "block", "kth", "probe"])
    probes = blocks.select("block", "socs", "m", "tops").mapInArrow(probe, "soc_code string, block int, kth double, probe array<int>")
    if len(heads) <= 1:
        return Search(at_home, probes, sizes, vec)

    def wanted(batches):
        for row in _each(batches):
            yield row.append_column("wanted", pa.array([ids[needed(row)[1].any(axis=0)]], pa.list_(pa.int32())))
    parts = min(len(heads), shuffle_partitions(vec.sparkSession))
    targets = (blocks.select("block", "socs", "m", "present", "tops")
               .mapInArrow(wanted, "block int, socs array<string>, m binary, present binary, tops binary, wanted array<int>")
               .repartition(parts, "block"))
    candidates = blocks.select(F.col("block").alias("of"), F.col("socs").alias("of_socs"), F.col("m").alias("of_m"), F.col("present").alias("of_present"),
                               F.col("centre").alias("of_centre"), F.col("radius").alias("of_radius"))

    def cross(batches):
        home, mine = None, None
        for row in _each(batches):
            if row.column("block")[0].as_py() != home:
                if mine:
                    yield mine.out()
                home, mine = row.column("block")[0].as_py(), _Best(row, len(names), k)
            mine.meet(row)
        if mine:
            yield mine.out()
    # every block of targets meets the blocks it wants; candidates are read again from the written table, not shuffled
    crossed = (targets.hint("shuffle_replicate_nl").join(candidates, F.expr("array_contains(wanted, of)"))
               .drop("wanted").mapInArrow(cross, PAIR))
    w = Window.partitionBy("target_soc").orderBy(F.col("similarity").desc(), "soc_code")
    out = (at_home.unionByName(crossed).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn"))
    return Search(out, probes, sizes, vec)


def _one(values: pa.Array) -> pa.Array:
    """A single row that lists all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _each(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1)


def _written(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/blocks-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _matrices(row: pa.RecordBatch, m: str, present: str, dim: int) -> _Side:
    bits = row.column(present)[0]
    return _Side.of(np.frombuffer(row.column(m)[0].as_buffer()).reshape(-1, dim),
                    np.frombuffer(bits.as_buffer(), bool).reshape(-1, dim) if bits.is_valid else None)


class _Best:
    """What a block's targets found in the other blocks so far: only pairs that reach the k-th similarity."""

    def __init__(self, row: pa.RecordBatch, dim: int, k: int):
        self.dim, self.k, self.socs = dim, k, row.column("socs").flatten()
        self.side = _matrices(row, "m", "present", dim)
        self.tops = np.frombuffer(row.column("tops")[0].as_buffer()).reshape(-1, k).copy()
        self.found, self.held = [], 0
        self.unit = _unit(self.side.m)

    def meet(self, row: pa.RecordBatch) -> None:
        centre, radius = row.column("of_centre").flatten().to_numpy(), row.column("of_radius")[0].as_py()
        bound = np.cos(np.maximum(0, np.arccos(np.clip(self.unit @ centre, -1, 1)) - radius)) + SLACK
        need = np.flatnonzero(bound >= self.tops[:, -1])
        if not len(need):
            return
        s, whole = self.side, len(need) == len(self.tops)
        t = s if whole else _Side(s.m[need], None if s.present is None else s.present[need], s.norm[need], s.unit[need],
                                  np.flatnonzero(np.isin(need, s.dead)))
        at, col, dot, sim = _best(t, _matrices(row, "of_m", "of_present", self.dim), self.k, self.tops[need, -1])
        if not len(at):
            return
        new = _table(at, sim, len(need), self.k)
        self.tops[need] = -np.sort(-np.concatenate((self.tops[need], new), axis=1), axis=1)[:, :self.k]
        self.found.append((need[at], dot, sim, np.array(row.column("of_socs").flatten().take(pa.array(col)).to_pylist(), object)))
        self.held += len(at)
        if self.held > 16 * self.tops.size:
            self.cut()

    def cut(self) -> None:
        row, dot, sim, socs = (np.concatenate(x) for x in zip(*self.found))
        keep = np.flatnonzero(sim >= self.tops[row, -1])
        place = np.unique(socs[keep], return_inverse=True)[1]
        keep = keep[np.lexsort((place, -sim[keep], row[keep]))]
        keep = keep[_nth(row[keep]) < self.k]
        self.found, self.held = [(row[keep], dot[keep], sim[keep], socs[keep])], len(keep)

    def out(self) -> pa.RecordBatch:
        if self.found:
            self.cut()
        row, dot, sim, socs = self.found[0] if self.found else (np.array([], np.int64), np.array([]), np.array([]), [])
        return pa.RecordBatch.from_arrays([self.socs.take(pa.array(row)), pa.array(socs, pa.string()), pa.array(dot), pa.array(sim)],
                                          ["target_soc", "soc_code", "dot_product", "similarity"])
