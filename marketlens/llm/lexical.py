"""Ranked lexical search: for each item, documents are grouped by the mask of its terms they hold, and
the distinct masks are evaluated by descending maximum score until no later one can reach the list.

The corpus is tokenised once, into one row a document with its counts of the items' terms; its totals
and document frequencies follow from those rows. Scores are integers, so every order of work gives the
same result. Items come in slices of bounded size, each broadcast; documents never move."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from marketlens.llm.common import table

#: Length normalisation in percent and its factor in the score.
B, K = 75, 8
#: Words of the items in one slice (more only if one item is longer).
SLICE_WORDS = 1_000_000
#: Documents and postings whose masks are held at once.
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 14, 1 << 22
#: Bytes of one text that are split at once; cuts fall between terms.
PIECE = 1 << 22
#: Documents scored at once, in order of their masks' maximum score, at first; then four times as many.
_STEP = 256
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
              for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in lists: runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    flat = text.translate(_FOLD)
    at = 0
    while at < len(flat):
        end = flat.find(b" ", at + PIECE)
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


def _slices(items: DataFrame) -> Iterator[list[tuple]]:
    """``(item_id, {term: times})`` of the items with a term, a slice at a time. Only the items' texts are read here."""
    out, held = [], 0
    for item_id, text in items.select("item_id", F.col("text").cast("binary")).toLocalIterator():
        found = Counter(w for part in terms(bytes(text or b"")) for w in part)
        if out and held + found.total() > SLICE_WORDS:
            yield out
            out, held = [], 0
        if found:
            out.append((item_id, found))
            held += found.total()
    if out:
        yield out


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``(doc_id, n, term, tf)`` for every row of ``docs``: its number of terms and, sorted by term, how often it
    holds each term of the vocabulary."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            n, ids, times = [], [], []
            for text in b.column(1).cast(pa.large_binary()).to_pylist():
                parts = [Counter(p) for p in terms(text or b"")]
                count = sum(parts[1:], parts[0]) if parts else Counter()
                known = sorted((vocabulary[w], c) for w, c in count.items() if w in vocabulary)
                n.append(count.total())
                ids.append([t for t, _ in known])
                times.append([c for _, c in known])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))],
                ["doc_id", "n", "term", "tf"])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, term array<int>, tf array<bigint>")


def _frequencies(held: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary."""
    def run(batches):
        df = np.zeros(size, np.int64)
        for b in batches:
            df += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at])], ["term", "df"])
    rows = (held.select("term").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))).toArrow()
    out = np.zeros(size, np.int64)
    out[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    return out


def _masks(at: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of ``n`` documents over the item's terms -> the distinct ones as booleans (mask, term), and each
    document's. ``at``: for each term the documents that hold it."""
    words = np.zeros((n, -(-len(at) // 64)), np.uint64)
    for j, docs in enumerate(at):
        words[docs, j // 64] |= np.uint64(1 << (j % 64))
    if words.shape[1] == 1:
        distinct, back = np.unique(words[:, 0], return_inverse=True)
        distinct = distinct[:, None]
    else:
        distinct, back = np.unique(words, axis=0, return_inverse=True)
    bits = np.unpackbits(np.ascontiguousarray(distinct).astype("<u8").view(np.uint8), axis=1, bitorder="little")
    return bits[:, :len(at)].astype(bool), back.ravel()


class Searcher:
    """The best ``k`` documents of each item among the blocks seen so far."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], docs: int, length: int, k: int):
        """``items``: sorted terms and, for each, weight x times; ``docs`` and ``length``: N and L of the corpus."""
        self.items, self.docs, self.length, self.k = items, docs, max(1, length), k
        self.best = [(np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)) for _ in items]
        self.scored = 0

    def see(self, ids: np.ndarray, lost: np.ndarray, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """A block of documents: ids (``lost``: null, ranked last), terms in all, and their postings."""
        m = 100 - B + (B * n * self.docs) // self.length
        doc = np.repeat(np.arange(len(n)), sizes)
        gain = (1_000_000_000 * tf) // (1000 * tf + K * m[doc])
        by = np.argsort(term, kind="stable")
        doc, gain, term = doc[by], gain[by], term[by]
        for i, (wanted, weight) in enumerate(self.items):
            a, z = np.searchsorted(term, wanted), np.searchsorted(term, wanted, side="right")
            spans = [(doc[x:y], w * gain[x:y]) for x, y, w in zip(a, z, weight) if x < y and w > 0]
            if spans:
                masks, back = _masks([docs for docs, _ in spans], len(n))
                most = masks.astype(np.int64) @ np.array([gains.max() for _, gains in spans])
                self._evaluate(i, most[back], spans, ids, lost)

    def _evaluate(self, i: int, most: np.ndarray, spans: list, ids: np.ndarray, lost: np.ndarray) -> None:
        """Mask groups by descending maximum score; ends once the next group's is below the k-th score."""
        scores, null, found = self.best[i]
        ranked = np.argsort(-most, kind="stable")
        limit, at, step = most[ranked], 0, _STEP
        while at < len(ranked) and limit[at] > 0 and (len(scores) < self.k or limit[at] >= scores[-1]):
            part = ranked[at:at + step]
            chosen, total = np.zeros(len(most), bool), np.zeros(len(most), np.int64)
            chosen[part] = True
            for docs, gains in spans:
                mine = chosen[docs]
                total[docs[mine]] += gains[mine]
            self.scored += len(part)
            part = part[total[part] > 0]
            scores, null, found = (np.concatenate(x) for x in ((scores, total[part]), (null, lost[part]), (found, ids[part])))
            best = np.lexsort((found, null, -scores))[:self.k]
            scores, null, found = scores[best], null[best], found[best]
            at, step = at + step, 4 * step
        self.best[i] = scores, null, found


def _blocks(batches) -> Iterator[tuple]:
    """Batches joined to blocks of bounded size: ids, null ids, n, sizes, terms, tfs."""
    held, docs, many = [], 0, 0

    def out():
        b = pa.Table.from_batches(held).combine_chunks()
        ids, n, term, tf = (b.column(c).combine_chunks() for c in ("doc_id", "n", "term", "tf"))
        return (ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False),
                n.to_numpy(zero_copy_only=False), term.value_lengths().to_numpy(zero_copy_only=False),
                term.flatten().to_numpy(zero_copy_only=False), tf.flatten().to_numpy(zero_copy_only=False))
    for b in batches:
        if held and (docs + b.num_rows > BLOCK_DOCS or many > BLOCK_POSTINGS):
            yield out()
            held, docs, many = [], 0, 0
        held.append(b)
        docs += b.num_rows
        many += len(b.column(2).flatten())
    if docs:
        yield out()


def _search(docs: DataFrame, items: list[tuple], kind: pa.DataType, names: str, k: int) -> DataFrame:
    """The best ``k`` of every task for one slice of items."""
    words = sorted({w for _, found in items for w in found})
    vocabulary = {w: i for i, w in enumerate(words)}
    held = table(postings(docs, vocabulary), "postings")
    n, length = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = _frequencies(held, len(words))
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    wanted = []
    for _, found in items:
        at = np.array(sorted(vocabulary[w] for w in found), np.int32)
        wanted.append((at, weight[at] * np.array([found[words[t]] for t in at], np.int64)))
    item_ids = [item_id for item_id, _ in items]

    def run(batches):
        seen = Searcher(wanted, n, length, k)
        for block in _blocks(batches):
            seen.see(*block)
        sizes = [len(s) for s, _, _ in seen.best]
        item = np.repeat(np.arange(len(sizes)), sizes)
        scores, null, ids = (np.concatenate(x) for x in zip(*seen.best))
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), pa.array([item_ids[i] for i in item], kind), pa.array(ids, mask=null), pa.array(scores)],
            ["item", "item_id", "doc_id", "score"])
    return held.mapInArrow(run, names)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for each row of ``items(item_id, text)`` the ``k`` rows of ``docs(doc_id, text)``
    with the highest scores above 0, equal scores by ascending doc_id (null last).

    A null, empty or termless text has no terms: such an item gets no rows, such a document is never found and
    not counted. Every row of either table stands for itself, so repeated documents are listed with their
    equal scores, and items that share an id are each ranked. Either table empty: no rows. Other columns
    are not read. Scores are 64-bit integers: exact while a text's terms x documents stay below 10**17."""
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    field = items.schema["item_id"].dataType
    names = f"item int, item_id {field.simpleString()}, doc_id bigint, score bigint"
    kind = to_arrow_type(field)
    best = items.sparkSession.createDataFrame([], "item_id " + field.simpleString() + ", rank int, doc_id bigint, score bigint")
    for part in _slices(items):
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        found = (_search(docs, part, kind, names, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
                 .select("item_id", "rank", "doc_id", "score"))
        best = best.unionByName(table(found, "found"))
    return best
