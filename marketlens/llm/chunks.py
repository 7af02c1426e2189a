"""Chunks of documents and questions about hashes that all chunks ask together.

A chunk is one row that holds some documents whole, compressed. ``ask`` sends packed arrays of
hashes from every chunk to buckets by hash; a bucket answers each entry after seeing all chunks'
entries for the hash; the answers go back and are joined to the chunk. A chunk sends each distinct
hash once, so a hash as common as can be has one entry a chunk."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm import flat
from marketlens.llm.common import table

#: Text bytes of a chunk (more only if one document is longer), and of all chunks for one bucket.
CHUNK_BYTES = 1 << 20
BUCKET_BYTES = 1 << 24
MIN_BUCKETS = 24
CHUNK_SCHEMA = "ids array<bigint>, sizes array<bigint>, blob binary"


def chunked(docs: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """``(chunk, ids, sizes, blob)`` as a written table; null text is empty, null doc_ids stay null."""
    def run(batches):
        ids, sizes, parts, held = [], [], [], 0

        def out():
            blob = zstandard.compress(b"".join(parts), 3)
            return pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([blob], pa.binary())],
                ["ids", "sizes", "blob"])
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist()):
                t = t or b""
                if ids and held + len(t) > size:
                    yield out()
                    ids, sizes, parts, held = [], [], [], 0
                ids.append(i)
                sizes.append(len(t))
                parts.append(t)
                held += len(t)
        if ids:
            yield out()
        release()
    rows = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, CHUNK_SCHEMA)
    return table(rows.select(F.monotonically_increasing_id().alias("chunk"), "ids", "sizes", "blob"), "chunks")


def buckets(chunks: DataFrame, size_of_one: int = BUCKET_BYTES) -> int:
    """How many buckets keep a bucket's share of the hashes bounded."""
    size = chunks.agg(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)"))).first()[0] or 0
    return max(MIN_BUCKETS, -(-size // size_of_one))


def opened(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a chunk's documents."""
    data = zstandard.ZstdDecompressor().decompress(row["blob"])
    return np.frombuffer(data, np.uint8), np.concatenate(([0], np.cumsum(np.array(row["sizes"], np.int64))))


def release() -> None:
    """Gives freed memory back: Python workers stay alive between tasks, beside the next ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)    # glibc only
    if trim:
        trim(0)


def rows_of(batch: pa.RecordBatch):
    """The rows of a batch, one at a time: a chunk's row can be large, so a batch is never opened as a whole."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> flat.U(40)) * flat.U(n) >> flat.U(24)).astype(np.int64)


def _stretches(at: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The buckets met in a sorted array and where each begins, and the end: work by the buckets that a
    chunk has hashes for, never by all there are, so a chunk's cost is bounded by its own hashes."""
    found, first = np.unique(at, return_index=True)
    return found, [*first.tolist(), len(at)]


def pack(x, width: int = 7) -> bytes:
    """The low ``width`` bytes of each value; width 0: byte strings, their lengths first."""
    if not width:
        return len(x).to_bytes(8, "little") + pack(np.array([len(t) for t in x], np.uint64), 4) + b"".join(x)
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(b: bytes, width: int = 7):
    if not width:
        n = int.from_bytes(b[:8], "little")
        ends = 8 + 4 * n + np.cumsum(unpack(b[8:8 + 4 * n], 4).astype(np.int64))
        return [b[x:z] for x, z in zip([8 + 4 * n, *ends[:-1].tolist()], ends.tolist())]
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def ask(rows: DataFrame, n: int, question: Callable, answer: Callable, widths: dict[str, int],
        replies: dict[str, int]) -> DataFrame:
    """``question(row) -> (hashes, {field: values})`` of a chunk row; ``answer({field: values of all
    chunks}) -> {reply: values}`` of a bucket. Returns ``(chunk, answers)``; see ``replied``."""
    names = list(widths)

    def send(batches):
        for b in batches:
            for row in rows_of(b):
                h, fields = question(row)
                at = bucket_of(h, n)
                order = np.argsort(at, kind="stable")
                found, cut = _stretches(at[order])
                cols = [pa.array(found, pa.int32()), pa.array([row["chunk"]] * len(found), pa.int64())]
                for f in names:
                    v = fields[f][order] if widths[f] else [fields[f][i] for i in order]
                    cols.append(pa.array([zstandard.compress(pack(v[x:z], widths[f]), 1) for x, z in zip(cut, cut[1:])], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, ["bucket", "chunk", *names])
        release()

    def meet(t: pa.Table) -> pa.Table:
        opener = zstandard.ZstdDecompressor()
        fields, sizes = {}, []
        for f in names:
            parts = [unpack(opener.decompress(x), widths[f]) for x in t.column(f).to_pylist()]
            sizes = [len(p) for p in parts]
            fields[f] = np.concatenate(parts) if widths[f] else [x for p in parts for x in p]
        out = answer(fields)
        ends = np.cumsum(sizes)
        cols = [t.column("bucket").combine_chunks(), t.column("chunk").combine_chunks()]
        for r, w in replies.items():
            cols.append(pa.array([zstandard.compress(pack(out[r][e - s:e], w), 1) for s, e in zip(sizes, ends)], pa.binary()))
        del fields, out
        release()
        return pa.Table.from_arrays(cols, ["bucket", "chunk", *replies])

    sent = rows.mapInArrow(send, "bucket int, chunk bigint, " + ", ".join(f"{f} binary" for f in names))
    back = sent.groupBy("bucket").applyInArrow(
        lambda t: meet(t), "bucket int, chunk bigint, " + ", ".join(f"{r} binary" for r in replies))
    return back.groupBy("chunk").agg(F.collect_list(F.struct("bucket", *replies)).alias("answers"))


def replied(answers: list, h: np.ndarray, n: int, reply: str, width: int) -> np.ndarray:
    """A chunk's answers in the order of its hashes ``h``."""
    opener = zstandard.ZstdDecompressor()
    out = np.zeros(len(h), np.uint64) if width else np.empty(len(h), object)
    at = bucket_of(h, n)
    order = np.argsort(at, kind="stable")
    found, cut = _stretches(at[order])
    place = {i: (x, z) for i, x, z in zip(found.tolist(), cut, cut[1:])}
    for a in answers or ():
        x, z = place[a["bucket"]]
        got = unpack(opener.decompress(a[reply]), width)
        if not width:
            got = np.fromiter(got, object, len(got))
        out[order[x:z]] = got
    return out


def counted(key: np.ndarray, times: np.ndarray) -> np.ndarray:
    """For each entry, the sum of ``times`` over the entries with its key."""
    _, back = np.unique(key, return_inverse=True)
    total = np.zeros(back.max() + 1 if len(back) else 0, np.int64)
    np.add.at(total, back, times.astype(np.int64))
    return total[back]


def joined(chunks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    return chunks.join(answers.withColumnRenamed("answers", name), "chunk", "left")

