"""Hard negatives from anchor-clustered shared lists: the members of a cluster walk one list of
candidates, sorted once by an angular upper bound, until no later entry can matter.

A candidate x at angle a from a cluster's centre, whose members lie within the angle r of it, has with
a member u an inner product of at most |u| |x| cos(max(0, a - r)). |x| cos(...) does not depend on the
member, so one sorted list serves all of them; a member leaves the walk once its bound falls below
what it still needs. Candidates and anchors meet in tiles of bounded size, dealt by hash; the best of
all tiles are ranked by Spark. Clusters only decide how early walks end, never the result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens.llm.common import table

#: Candidates and anchors of one tile pair, on average (tiles are dealt by hash).
CANDIDATES, ANCHORS = 8192, 8192
#: Anchors that centres are fitted on (the first by hash), and the most centres.
FIT_ROWS, MAX_CENTRES, FIT_ROUNDS = 8192, 256, 6
#: Anchors to a cluster that the number of centres aims at.
MEMBERS = 32
#: Relative room for rounding in a bound.
SLACK = 1e-6
_STEP, _STEP_MOST = 128, 4096


def quantised(embeddings: DataFrame, scale: int, label: Column) -> DataFrame:
    """``(vec_id, label, code, alt)``: each component x as floor(scale * x). Rows with a null id, label or
    vector, or with a null or non-finite component, take no part. Equal rows are one row; rows that
    share an id but nothing else stay apart by ``alt``, a hash of the rest."""
    usable = F.expr("vec_id IS NOT NULL AND embedding IS NOT NULL AND "
                    "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    code = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return (embeddings.where(usable).select(F.col("vec_id").cast("bigint"), label.cast("int").alias("label"), code.alias("code"))
            .where("label IS NOT NULL").distinct().withColumn("alt", F.xxhash64("label", "code")))


def _matrix(codes: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """The codes as int64 rows, shorter ones padded by zeros."""
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    sizes = codes.value_lengths().to_numpy(zero_copy_only=False)
    flat = codes.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), max(width, sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x.astype(float)
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1)[:, None], norm


def _products(u: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: no partial sum exceeds |u| |x|."""
    most = np.sqrt((u.astype(float) ** 2).sum(1).max(initial=0)) * np.sqrt((x.astype(float) ** 2).sum(1).max(initial=0))
    if most < 2.0 ** 52:
        return (u.astype(float) @ x.astype(float).T).astype(np.int64)
    if most >= 2.0 ** 62:
        raise OverflowError("an inner product of these vectors does not fit a long")
    return u @ x.T


def walk(u: dict, x: dict, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> tuple[dict, int]:
    """For each member of ``u`` and each of its windows ``low[m, s] <= score <= high[m, s]`` the first ``k``
    candidates of ``x`` with its label (``same``, but for itself) or another one, by score, then id.
    ``u`` and ``x``: id, alt, label, code. Also returns how many (member, entry) pairs were scored."""
    unit, norm = _unit(u["code"])
    centre = unit.sum(axis=0)
    size = np.sqrt((centre * centre).sum())
    direction, lengths = _unit(x["code"])
    if size > 1e-9:
        centre /= size
        radius = np.arccos(np.clip(unit[norm > 0] @ centre, -1, 1)).max(initial=0)
        angle = np.arccos(np.clip(direction @ centre, -1, 1))
        reach = lengths * np.cos(np.maximum(0, angle - radius))
    else:                                           # members on all sides, or none that points anywhere
        reach = lengths
    order = np.argsort(-reach, kind="stable")
    slack = SLACK * lengths.max(initial=0)
    kth = np.full(low.shape, -np.inf)
    active = np.arange(len(norm))
    best = {c: np.empty(0, np.int64) for c in ("member", "slot", "at", "score")}
    at, step, scored = 0, _STEP, 0
    while at < len(order):
        need = np.maximum(low, kth)
        alive = ((reach[order[at]] + slack) * norm[active])[:, None] >= need[active]
        active = active[(alive & (low <= high)[active]).any(axis=1)]
        if not len(active):
            break
        part = order[at:at + step]
        score = _products(u["code"][active], x["code"][part])
        scored += score.size
        fit = (u["label"][active][:, None] == x["label"][part]) == same
        if same:
            fit &= (u["id"][active][:, None] != x["id"][part]) | (u["alt"][active][:, None] != x["alt"][part])
        new = []
        for s in range(low.shape[1]):
            m, c = np.nonzero(fit & (score >= need[active, s][:, None]) & (score <= high[active, s][:, None]))
            new.append((active[m], np.full(len(m), s), part[c], score[m, c]))
        for c, parts in zip(best, zip(*new)):
            best[c] = np.concatenate((best[c], *parts))
        rank = np.lexsort((x["alt"][best["at"]], x["id"][best["at"]], -best["score"], best["slot"], best["member"]))
        best = {c: v[rank] for c, v in best.items()}
        group = best["member"] * low.shape[1] + best["slot"]
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else group
        place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        full = place == k - 1
        kth[best["member"][full], best["slot"][full]] = best["score"][full]
        best = {c: v[place < k] for c, v in best.items()}
        at, step = at + step, min(2 * step, _STEP_MOST)
    return best, scored


def _centres(sample: np.ndarray) -> np.ndarray:
    """Spherical k-means; starts from rows spread over the sample."""
    unit, _ = _unit(sample)
    n = min(MAX_CENTRES, -(-len(unit) // MEMBERS))
    centres = unit[np.linspace(0, len(unit) - 1, n).astype(int)] if len(unit) else unit
    for _ in range(FIT_ROUNDS if len(unit) else 0):
        nearest = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        moved, size = _unit(sums)
        centres = np.where(size[:, None] > 0, moved, centres)
    return centres


def _clustered(anchors: DataFrame) -> tuple[DataFrame, int]:
    """The anchors with their ``cluster`` and anchor tile ``ta``; members of a cluster lie in tiles next to
    each other. Only the sample and the clusters' sizes come to the driver."""
    sample = anchors.orderBy(F.xxhash64("vec_id", "alt")).limit(FIT_ROWS).select("code").toArrow()
    fit = _matrix(sample.column("code"), 0)
    centres, width = _centres(fit), fit.shape[1]

    def assign(batches):
        for b in batches:
            unit, _ = _unit(_matrix(b.column("code"), width)[:, :width])
            nearest = (unit @ centres.T).argmax(axis=1) if len(centres) else np.zeros(len(unit), np.int64)
            yield b.append_column("cluster", pa.array(nearest, pa.int32()))
    named = table(anchors.mapInArrow(assign, "vec_id bigint, label int, code array<bigint>, alt bigint, cluster int"), "anchors")
    base, total = [], 0
    for c, n in sorted((r["cluster"], r["n"]) for r in named.groupBy("cluster").agg(F.count("*").alias("n")).collect()):
        base.append((c, total, n))
        total += n
    at = "CASE cluster " + " ".join(f"WHEN {c} THEN {b}L + pmod(xxhash64(vec_id, alt), {n}L)" for c, b, n in base) + " END" if base else "0L"
    return named.withColumn("ta", F.expr(f"CAST(({at}) DIV {ANCHORS} AS INT)")), max(1, -(-total // ANCHORS))


def _side(t: pa.Table, width: int) -> dict:
    return {"id": t.column("vec_id").to_numpy(), "alt": t.column("alt").to_numpy(), "label": t.column("label").to_numpy(),
            "code": _matrix(t.column("code"), width)}


def _met(anchors: DataFrame, candidates: DataFrame, tiles: tuple[int, int], found, schema: str) -> DataFrame:
    """``found(members, candidates, anchor rows) -> columns`` for every cluster and tile of candidates."""
    names = [c.split()[0] for c in schema.split(", ")]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            width = max(pc.max(pc.list_value_length(t.column("code"))).as_py() for t in (left, right))
            x = _side(right, width)
            cluster = left.column("cluster").to_numpy()
            for c in np.unique(cluster):
                rows = left.take(pa.array(np.flatnonzero(cluster == c)))
                out.append(found(_side(rows, width), x, rows))
        cols = [np.concatenate([o[c] for o in out]) if out else np.empty(0, np.int64) for c in names]
        return pa.Table.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names)

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("tc", every(tiles[1])).groupBy("ta", "tc")
    right = (candidates.withColumn("tc", F.expr(f"CAST(pmod(xxhash64(vec_id, alt), {tiles[1]}) AS INT)"))
             .withColumn("ta", every(tiles[0])).groupBy("ta", "tc"))
    return left.cogroup(right).applyInArrow(meet, schema)


def _first(rows: DataFrame, key: list[str], ident: str, score: str, k: int) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.col(score).desc(), ident, f"{ident[:-3]}_alt")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``rows``: what :func:`quantised` returns. Anchors are the rows where ``anchor`` holds. An anchor's positives
    are its first ``positives`` other rows with its label; for each of them the first ``negatives`` rows with another
    label whose score lies between ``low`` and ``high`` percent of the positive's. Scores are integer inner
    products, higher first, equal ones by smaller id. A positive whose window holds no row (a score below zero
    has an empty window) and an anchor alone with its label give no rows, as does an empty table. Vectors of
    unlike lengths are padded by zeros; an inner product that no long can hold is an error."""
    rows = table(rows, "vectors")
    anchors, n_anchor_tiles = _clustered(rows.where(anchor))
    tiles = (n_anchor_tiles, max(1, -(-rows.count() // CANDIDATES)))

    def same_label(u, x, _):
        n = len(u["id"])
        got, _ = walk(u, x, True, np.full((n, 1), -np.inf), np.full((n, 1), np.inf), positives)
        m, c = got["member"], got["at"]
        return {"anchor_id": u["id"][m], "anchor_alt": u["alt"][m], "positive_id": x["id"][c], "positive_alt": x["alt"][c],
                "positive_score": got["score"]}
    near = _met(anchors, rows, tiles, same_label,
                "anchor_id bigint, anchor_alt bigint, positive_id bigint, positive_alt bigint, positive_score bigint")
    near = _first(near, ["anchor_id", "anchor_alt"], "positive_id", "positive_score", positives)
    held = (near.groupBy("anchor_id", "anchor_alt")
            .agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_alt", "positive_score"))).alias("near")))
    held = table(anchors.join(held, (anchors["vec_id"] == held["anchor_id"]) & (anchors["alt"] == held["anchor_alt"]))
                 .select("vec_id", "label", "code", "alt", "cluster", "ta", "near"), "positives")

    def other_label(u, x, rows):
        near = rows.column("near").combine_chunks()
        many = near.value_lengths().to_numpy(zero_copy_only=False)
        flat = near.flatten()
        used = np.arange(positives) < many[:, None]
        ids, alts, scores = (np.zeros(used.shape, np.int64) for _ in range(3))
        for a, f in ((ids, "positive_id"), (alts, "positive_alt"), (scores, "positive_score")):
            a[used] = flat.field(f).to_numpy()
        least = np.where(used, -((-low * scores) // 100), 1).astype(float)     # the window, its ends rounded inward
        most = np.where(used, (high * scores) // 100, 0).astype(float)
        got, _ = walk(u, x, False, least, most, negatives)
        m, s, c = got["member"], got["slot"], got["at"]
        return {"anchor_id": u["id"][m], "anchor_alt": u["alt"][m], "positive_id": ids[m, s], "positive_alt": alts[m, s],
                "positive_score": scores[m, s], "negative_id": x["id"][c], "negative_alt": x["alt"][c], "negative_score": got["score"]}
    hard = _met(held, rows, tiles, other_label,
                "anchor_id bigint, anchor_alt bigint, positive_id bigint, positive_alt bigint, positive_score bigint, "
                "negative_id bigint, negative_alt bigint, negative_score bigint")
    hard = _first(hard, ["anchor_id", "anchor_alt", "positive_id", "positive_alt"], "negative_id", "negative_score", negatives)
    return hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
