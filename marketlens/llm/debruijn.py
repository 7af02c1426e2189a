"""Substring dedup by De Bruijn compaction: 35 consecutive words are an edge between the 34-word
nodes at its ends. Runs of edges along a text that share their least 18-word minimizer are one
compacted path (a super-k-mer), and paths meet others only in the bucket of that minimizer:

1. a path met twice is repeated as a whole; a minimizer with two different paths is a branch;
2. only the paths at branches are opened into edges, which are counted in turn;
3. repeated paths and edges are joined to their source coordinates, where adjoining ones make up the
   long repeated spans."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marketlens.llm import flat
from marketlens.llm.chunks import ask, buckets, chunked, counted, joined, opened, replied
from marketlens.llm.common import table

WINDOW = 35
MINIMIZER = 18
_WHOLE, _BRANCH = 1, 2


class _Paths:
    """The compacted paths of a chunk, distinct ones first seen first by hash."""

    def __init__(self, row: dict, window: int):
        self.data, self.off = opened(row)
        self.start, self.end, self.first = flat.words(self.data, self.off)
        self.prefix = flat.Prefix(flat.word_hashes(self.data, self.start, self.end))
        n, k = len(self.start), (window + 1) // 2
        low = self.prefix.rolling(k)
        at = np.flatnonzero(flat.inside(self.first, n, window))
        place = flat.window_minima(low, window - k + 1)[at] if len(at) else at
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        cut = np.flatnonzero(new)
        self.at, self.edges = at[cut], np.diff(np.append(cut, len(at)))
        path = self.prefix.spans(self.at, self.at + self.edges + window - 1)
        self.path, self.rep, self.back, self.times = np.unique(path, return_index=True, return_inverse=True, return_counts=True)
        self.minimizer = low[place[cut]][self.rep]


def _opened(p: _Paths, flags: np.ndarray, window: int):
    """Edges of the distinct paths at branches: their starts, and the distinct edges' hashes."""
    which = np.flatnonzero(flags & _BRANCH)
    size = p.edges[p.rep[which]]
    start = np.repeat(p.at[p.rep[which]] - np.concatenate(([0], np.cumsum(size)[:-1])) if len(which) else size, size) + np.arange(size.sum())
    edge, back = np.unique(p.prefix.spans(start, start + window), return_inverse=True)
    times = np.repeat(np.maximum(np.minimum(p.times[which], 2), 1 + (flags[which] & _WHOLE)), size)
    return which, size, edge, back, np.minimum(np.bincount(back, weights=times, minlength=len(edge)), 2)


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_words, n_removed, n_spans, kept_sha256.

    A word is removed if a window of ``window`` words that covers it also starts anywhere else in the
    input. Null and empty texts have no words; texts under a window lose nothing; of repeated rows each
    loses what the others hold too; an empty table gives no rows; further columns are not read."""
    chunks = chunked(docs)
    n = buckets(chunks)

    def paths(row):
        p = _Paths(row, window)
        return p.minimizer, {"minimizer": p.minimizer, "path": p.path, "times": np.minimum(p.times, 2).astype(np.uint64)}

    def meet_paths(f):
        total = counted(f["path"], f["times"])
        # distinct paths of a minimizer
        one = np.zeros(len(total))
        one[np.unique(f["path"], return_index=True)[1]] = 1
        return {"flags": (_WHOLE * (total > 1) + _BRANCH * (counted(f["minimizer"], one) > 1)).astype(np.uint64)}

    known = joined(chunks, table(ask(chunks, n, paths, meet_paths, {"minimizer": 7, "path": 7, "times": 1}, {"flags": 1}), "paths"), "paths")

    def flags_of(p, row):
        return replied(row["paths"], p.minimizer, n, "flags", 1).astype(np.int64)

    def edges(row):
        p = _Paths(row, window)
        _, _, edge, _, times = _opened(p, flags_of(p, row), window)
        return edge, {"edge": edge, "times": times.astype(np.uint64)}

    def meet_edges(f):
        return {"twice": (counted(f["edge"], f["times"]) > 1).astype(np.uint64)}

    known = joined(known, table(ask(known, n, edges, meet_edges, {"edge": 7, "times": 1}, {"twice": 1}), "edges"), "edges")

    def cut(batches):
        for b in batches:
            for row in b.to_pylist():
                p = _Paths(row, window)
                flags = flags_of(p, row)
                which, size, edge, back, _ = _opened(p, flags, window)
                twice = replied(row["edges"], edge, n, "twice", 1)[back] > 0
                whole = (flags & _WHOLE) > 0
                # every edge of every path, by its distinct path
                begin = np.zeros(len(p.path), np.int64)
                begin[which] = np.concatenate(([0], np.cumsum(size)[:-1])) if len(which) else 0
                opened_ = np.zeros(len(p.path), bool)
                opened_[which] = True
                total = int(p.edges.sum())
                lead = np.concatenate(([0], np.cumsum(p.edges)[:-1])) if len(p.edges) else p.edges
                inner = np.arange(total) - np.repeat(lead, p.edges)
                own = np.repeat(p.back, p.edges)
                hit = whole[own]
                ask_edge = ~hit & opened_[own]
                hit[ask_edge] = twice[begin[own[ask_edge]] + inner[ask_edge]]
                at = (np.repeat(p.at, p.edges) + inner)[hit]
                step = np.zeros(len(p.start) + window + 1, np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, at + window, -1)
                gone = np.cumsum(step)[:len(p.start)] > 0
                yield _result(row, p, gone)

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = known.mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return out.withColumn("doc_id", out["doc_id"].cast(kind))


def _result(row, p, gone):
    raw = p.data.tobytes()
    cols = [[], [], [], []]
    for d in range(len(row["ids"])):
        a, z = p.first[d], p.first[d + 1]
        g = gone[a:z]
        if g.any():
            kept = np.flatnonzero(~g) + a
            text = b" ".join([raw[x:y] for x, y in zip(p.start[kept].tolist(), p.end[kept].tolist())])
        else:
            text = b" ".join(raw[p.off[d]:p.off[d + 1]].split())
        spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
        for c, v in zip(cols, (int(z - a), int(g.sum()), spans, hashlib.sha256(text).hexdigest())):
            c.append(v)
    return pa.RecordBatch.from_arrays(
        [pa.array(row["ids"], pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
        ["doc_id", "n_words", "n_removed", "n_spans", "kept_sha256"])
