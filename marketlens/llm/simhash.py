"""SimHash near-duplicates: pigeonhole blocks, joined on blocks, verified by Hamming distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import table
from marketlens.llm.components import components

SEED = 42
#: A block shared by more distinct fingerprints than this is split by blocks of its remaining bits.
BUCKET_LIMIT = 512
_STEP = 1 << 17


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit fingerprint (unsigned) of one UTF-8 text; 0 if it has no word."""
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 0x20)
    k = min(shingle, len(words))
    starts = np.concatenate(([0], gaps + 1))[:len(words) - k + 1].tolist()
    ends = np.concatenate((gaps, [len(flat)]))[k - 1:].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), _STEP):
        h = np.array([digest(flat[a:b], SEED) for a, b in zip(starts[at:at + _STEP], ends[at:at + _STEP])],
                     np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)``: the fingerprint as a signed long; null text has no word, so fingerprint 0."""
    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.large_binary()).to_pylist()
            fp = np.array([fingerprint(t or b"", shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _without(value: str, low: int, width: int) -> str:
    """SQL for ``value`` less the ``width`` bits from bit ``low`` on, closed up."""
    kept = f"({value} & {(1 << low) - 1}L)"
    if low + width >= 64:
        return kept
    return f"(shiftleft(shiftrightunsigned({value}, {low + width}), {low}) | {kept})"


def _blocks(rows: DataFrame, value: str, bits: int, parts: int) -> DataFrame:
    """Each fingerprint under every one of ``parts`` blocks of its ``bits`` remaining bits."""
    cuts = [bits * i // parts for i in range(parts + 1)]
    options = ", ".join(
        f"struct(xxhash64(key, {i}, shiftrightunsigned({value}, {a}) & {(1 << (b - a)) - 1}L) AS key, "
        f"{_without(value, a, b - a)} AS rest)" for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
    return (rows.select("fp", F.expr(f"inline(array({options}))")))


def _stars(batches, bits: int):
    """Sorted (key, fp) rows -> per key the verified links, as a spanning star of each local component."""
    def work(key, fp):
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        end = np.repeat(np.append(cut[1:], len(key)), np.diff(np.append(cut, len(key))))
        i, d, left, right = np.arange(len(key)), 1, [], []
        x = fp.view(np.uint64)
        while len(i := i[i + d < end[i]]):
            near = np.bitwise_count(x[i] ^ x[i + d]) <= bits
            left.append(i[near])
            right.append(i[near] + d)
            d += 1
        a, b = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (left, right))
        root = np.arange(len(key))
        while True:
            was = root.copy()
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            root = root[root]
            if (root == was).all():
                break
        at = np.flatnonzero(root != np.arange(len(key)))
        u, v = np.maximum(fp[at], fp[root[at]]), np.minimum(fp[at], fp[root[at]])
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    held = [np.empty(0, np.int64)] * 2
    for batch in batches:
        key, fp = (np.concatenate((h, batch.column(c).to_numpy())) for c, h in enumerate(held))
        done = np.searchsorted(key, key[-1]) if len(key) else 0
        held = [key[done:], fp[done:]]
        if done:
            yield work(key[:done], fp[:done])
    if len(held[0]):
        yield work(*held)


def links(nodes: DataFrame, bits: int = 3) -> DataFrame:
    """Distinct ``fp`` -> edges ``(u, v)`` that join every pair within ``bits`` bits into the same
    component. ``bits + 1`` blocks: a close pair agrees on one of them at least. Blocks shared by
    more than BUCKET_LIMIT fingerprints are split again by blocks of the bits that are left, up to
    four times; then at most 2**20 values can remain."""
    parts = bits + 1
    rows = _blocks(nodes.select("fp", F.lit(0).cast("bigint").alias("key")), "fp", 64, parts)
    done, width = [], 64
    for _ in range(4):
        width -= width // parts
        rows = table(rows, "blocks")
        hot = rows.groupBy("key").count().where(F.col("count") > BUCKET_LIMIT).select("key")
        if hot.isEmpty():
            break
        done.append(rows.join(hot, "key", "left_anti"))
        rows = _blocks(rows.join(hot, "key", "left_semi"), "rest", width, parts)
    for part in done:
        rows = rows.unionByName(part)
    return (rows.select("key", "fp").repartition("key").sortWithinPartitions("key")
            .mapInArrow(lambda b: _stars(b, bits), "u bigint, v bigint").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs(doc_id, text)``.

    Texts whose fingerprints differ in at most ``bits`` bits are linked; ``component_id`` is the
    smallest doc_id reachable over links (null only if all of them are null). Texts are lower-cased
    (A-Z) and read whole; null and wordless texts have fingerprint 0 and are linked like any other.
    Equal fingerprints (copies, repeated rows) are one node. An empty table gives no rows; other
    columns of ``docs`` are not read."""
    prints = table(fingerprints(docs, shingle), "fingerprints")
    nodes = table(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    roots = components(links(nodes, bits))
    named = (nodes.join(roots, nodes["fp"] == roots["node"], "left")
             .select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_print = named.join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """One row of each component, whole: the one with the smallest doc_id (null last), then with the least hash
    of the whole row. Every row takes part under a key of its own, made of its doc_id and that hash, so rows that
    share a doc_id or have none are kept or dropped by their texts like any other; rows equal in every
    column count as one. Columns of any type, maps included."""
    content = F.to_json("_row")
    key = F.concat_ws("-", F.hex(F.xxhash64(content)), F.hex(F.xxhash64(F.lit("second"), content)))
    rows = docs.select(F.struct(*docs.columns).alias("_row")).withColumn("_key", key)
    ident = F.struct(F.col("_row.doc_id").isNull().alias("none"), F.col("_row.doc_id").alias("id"), F.col("_key").alias("key"))
    judged = near_duplicates(rows.select(ident.alias("doc_id"), F.col("_row.text").alias("text")), shingle, bits)
    kept = table(judged.where("doc_id <=> component_id").select(F.col("doc_id.key").alias("_key")).distinct(), "kept")
    return (rows.join(kept, "_key", "left_semi").groupBy("_key").agg(F.first("_row").alias("_row"))
            .select(*(F.col("_row").getField(c).alias(c) for c in docs.columns)))
