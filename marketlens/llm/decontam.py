"""Benchmark decontamination: rare word n-grams of test items seed training passages, then
Smith-Waterman alignment over words scores the passage, so edited copies are found too.

The items' seeds are split into slices of bounded size. Each slice is broadcast and the corpus is
scanned once for it, so nothing of the corpus is shuffled and a larger benchmark means more scans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm import flat
from marketlens.llm.common import broadcast_if_small, table, text_blocks

#: A seed is the shortest run of 3 to 8 words whose chance under the corpus's word shares is below this,
#: or the longest run that the item has.
RARE = 1e-9
SEED_WORDS = (3, 4, 5, 6, 7, 8)
MATCH, MISMATCH, GAP = 2, -1, -1
#: An item leaks if the alignment reaches this share of the item's full score.
MIN_SCORE = 0.5
#: Shorter items can't be told from chance.
MIN_ITEM_WORDS = 5
#: Items whose words are broadcast at once.
SLICE_WORDS = 2_000_000


def _lower_words(data, off):
    data = flat.LOWER[data]
    start, end, first = flat.words(data, off)
    return flat.word_hashes(data, start, end), first


def _item_words(items: DataFrame):
    """Rows (item_id, n_words) are counted in Spark; slices of items then come to the driver."""
    sized = (items.where("item_id IS NOT NULL AND text IS NOT NULL")
             .select("item_id", "text", F.expr(r"size(split(text, r'[ \t-\r]+'))").alias("n")))
    total = sized.agg(F.sum("n")).first()[0] or 0
    parts = -(-total // SLICE_WORDS)
    for p in range(parts):
        rows = (sized.where(F.expr(f"pmod(xxhash64(item_id, text), {parts}) = {p}"))
                .select("item_id", "text").distinct().orderBy("item_id", "text").collect())
        out = []
        for r in rows:
            t = pa.array([r.text], pa.large_string())
            h, _ = _lower_words(*flat.block(t))
            if len(h) >= MIN_ITEM_WORDS:
                out.append((r.item_id, h))
        if out:
            yield out


def _shares(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Share of each of the (bounded) vocabulary's words among all words of the corpus."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        voc = held.value
        counts, total = np.zeros(len(voc), np.int64), 0
        for b in text_blocks(batches):
            h, _ = _lower_words(*flat.block(b.column(0)))
            at = np.minimum(np.searchsorted(voc, h), len(voc) - 1)
            counts += np.bincount(at[voc[at] == h], minlength=len(voc))
            total += len(h)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], total))], ["w", "n"])
    rows = (docs.select("text").mapInArrow(run, "w bigint, n bigint")
            .groupBy("w").agg(F.sum("n").alias("n")).collect())
    counts = np.zeros(len(voc := vocabulary))
    total = 1
    for r in rows:
        if r.w < 0:
            total = max(1, r.n)
        else:
            counts[r.w] = r.n
    return np.maximum(counts, 1) / max(total, 1)


def _seeds(items, vocabulary, shares):
    """{n: (sorted seed hashes, owner item, place in the item)}."""
    logs = np.log(shares)
    found = {n: ([], [], []) for n in SEED_WORDS}
    for owner, (_, h) in enumerate(items):
        lp = np.concatenate(([0.0], np.cumsum(logs[np.searchsorted(vocabulary, h)])))
        used = np.zeros(len(h), bool)
        prefix = flat.Prefix(h)
        for n in SEED_WORDS:
            if len(h) < n:
                break
            rare = ((lp[n:] - lp[:-n]) <= np.log(RARE)) & ~used[:len(h) - n + 1]
            if n == min(SEED_WORDS[-1], len(h)):  # the longest run possible, whatever its chance
                rare = ~used[:len(h) - n + 1]
            at = np.flatnonzero(rare)
            used[at] = True
            found[n][0].append(prefix.rolling(n)[at])
            found[n][1].append(np.full(len(at), owner))
            found[n][2].append(at)
    out = {}
    for n, (h, o, p) in found.items():
        if h and len(h := np.concatenate(h)):
            order = np.argsort(h, kind="stable")
            out[n] = (h[order], np.concatenate(o)[order], np.concatenate(p)[order])
    return out


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman with a linear gap: best score, and the aligned words' start and end in text."""
    m = len(text)
    steps = np.arange(m + 1) * -GAP
    row, begin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    best = (0, 0, 0)
    for w in item:
        diagonal = row[:-1] + np.where(text == w, MATCH, MISMATCH)
        up = row[1:] + GAP
        new, at = np.zeros(m + 1, np.int64), np.arange(m + 1)
        take = (diagonal >= up) & (diagonal > 0)
        new[1:] = np.maximum(np.maximum(diagonal, up), 0)
        at[1:] = np.where(take, begin[:-1], np.where(up > 0, begin[1:], at[1:]))
        lifted = new + steps                      # a gap to the right costs one step a word
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(m + 1), 0))
        value = top - steps
        at = np.where(value > new, at[source], at)
        row, begin = value, at
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), int(begin[j]), j)
    return best


def _passages(batches, items, seeds):
    """Per document and item: seed hits grouped into passages, each aligned with the item."""
    memo: dict = {}
    for b in text_blocks(batches):
        h, first = _lower_words(*flat.block(b.column(1)))
        if not len(h):
            continue
        prefix, hits = flat.Prefix(h), []
        for n, (table, owner, place) in seeds.items():
            r = prefix.rolling(n)
            r[~flat.inside(first, len(h), n)] = 0
            lo = np.searchsorted(table, r)
            pos = np.flatnonzero(table[np.minimum(lo, len(table) - 1)] == r)
            while len(pos):                       # a seed may belong to several items
                hits.append(np.stack([owner[lo[pos]], pos, place[lo[pos]]]))
                lo[pos] += 1
                ok = lo[pos] < len(table)
                pos = pos[ok]
                pos = pos[table[lo[pos]] == r[pos]]
        if not hits:
            continue
        hits = np.concatenate(hits, axis=1)
        doc = np.searchsorted(first, hits[1], side="right") - 1
        order = np.lexsort((hits[1], hits[0], doc))
        hits, doc = hits[:, order], doc[order]
        size = np.array([len(x[1]) for x in items])
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (hits[0, 1:] != hits[0, :-1]) | (
            hits[1, 1:] - hits[1, :-1] > 2 * size[hits[0, 1:]])
        cut = np.flatnonzero(new)
        rows = {}
        for a, z in zip(cut, np.append(cut[1:], len(doc))):
            d, o = int(doc[a]), int(hits[0, a])
            item = items[o][1]
            n, margin = len(item), len(item) // 2 + 2
            left = max(first[d], int((hits[1, a:z] - hits[2, a:z]).min()) - margin)
            right = min(first[d + 1], int((hits[1, a:z] - hits[2, a:z]).max()) + n + margin)
            part = h[left:right]
            key = (o, part.tobytes()) if len(part) <= 4 * n + 64 else None
            got = memo.get(key) if key else None
            if got is None:
                got = align(item, part)
                if key and len(memo) < 20_000:    # a cache: the result is the same without it
                    memo[key] = got
            old = rows.get((d, o))
            if old is None or got[0] > old[0]:
                rows[d, o] = (got[0], left - first[d] + got[1], left - first[d] + got[2], (old[3] if old else 0) + z - a)
            else:
                rows[d, o] = (*old[:3], old[3] + z - a)
        good = [(d, o, *r) for (d, o), r in rows.items() if r[0] >= MIN_SCORE * MATCH * len(items[o][1])]
        if good:
            ids = b.column(0).take(pa.array([g[0] for g in good]))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([items[g[1]][0] for g in good], pa.int64()),
                 pa.array([g[2] / (MATCH * len(items[g[1]][1])) for g in good]),
                 *(pa.array([int(g[k]) for g in good], pa.int64()) for k in (3, 4, 5))],
                ["doc_id", "item_id", "score", "start_word", "end_word", "n_seeds"])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, score, start_word, end_word, n_seeds)`` for every document and item whose
    best alignment reaches MIN_SCORE; documents without a leak have no row.

    Words are compared after lower-casing A-Z. Items with under MIN_ITEM_WORDS words, null items and
    null texts match nothing. Repeated documents are reported alike, repeated items once by item.
    Empty tables give no rows; further columns are not read."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id bigint, score double, start_word bigint, end_word bigint, n_seeds bigint"
    docs = docs.select("doc_id", "text")
    out = docs.sparkSession.createDataFrame([], schema)
    for items in _item_words(benchmark):
        vocabulary = np.unique(np.concatenate([h for _, h in items]))
        seeds = _seeds(items, vocabulary, _shares(docs, vocabulary))
        held = docs.sparkSession.sparkContext.broadcast((items, seeds))
        found = docs.mapInArrow(lambda b, held=held: _passages(b, *held.value), schema)
        out = out.unionByName(found)
    return (out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "start_word", "end_word", "n_seeds")).alias("x"))
            .select("doc_id", "item_id", "x.*"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leaked item, with all their columns.

    A leak is a matter of the text alone, so texts are judged and rows are dropped by their text (two 64-bit
    hashes), never by doc_id: rows that share an id, or have none, don't decide about each other."""
    def key(text):
        return F.concat_ws("-", F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit("second"), text)))
    leaked = leaks(docs.where("text IS NOT NULL").select(key(F.col("text")).alias("doc_id"), "text"), benchmark)
    bad = broadcast_if_small(table(leaked.select(F.col("doc_id").alias("_bad")).distinct(), "leaked"))
    return docs.join(bad, F.when(docs["text"].isNotNull(), key(docs["text"])) == bad["_bad"], "left_anti")
