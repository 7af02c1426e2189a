"""Class-based n-gram scoring: exchange clustering assigns every word that occurs at least LEAST times
to its best class, rarer words are classed by their count; class transitions and word emissions score
every text.

Counts cover every training document and every word. No list of words reaches the driver: each chunk
sends its words' context counts to the bucket of the word, the bucket sums them and finds the best class
of each word under the class bigrams (_ALL x _ALL, broadcast), and the chunk gets the classes back. Half
of the words move in a round, until the likelihood stops rising. The token streams are a table bucketed
by chunk: a round brings the classes to them, and never shuffles them."""

from __future__ import annotations

import gc
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm import flat
from marketlens.llm.chunks import (MIN_BUCKETS, ask, bucket_of, buckets, chunked, joined, opened, pack, release, replied,
                                   rows_of, unpack)
from marketlens.llm.common import table
from marketlens.session import ensure_checkpoint_dir

#: A word with at least this many training tokens takes part in the exchange.
LEAST = 3
CLASSES = 48
#: Text bytes for one bucket of the exchange while there are few; its moves do not see the others'.
STEP_BYTES = 1 << 20
#: Text bytes of a chunk: the larger it is, the fewer chunks hold the same word.
CHUNK_BYTES = 1 << 22
#: Text bytes hashed at a time: hashing holds some 50 bytes for each.
BLOCK_BYTES = 1 << 18
#: Words whose contexts a bucket holds open at once.
BLOCK_WORDS = 1 << 14
#: The exchange ends when neither half of the words raises the likelihood by this share.
RISE = 1e-4
#: Classes of rarer words by bit length of their count; the least one also holds unknown words.
BANDS = 40
_END = CLASSES + BANDS
_ALL = _END + 1
#: Weight of the class unigrams in a transition's estimate, in counts.
BACKOFF = 5.0
ADD = 0.1
_END_HASH = np.uint64(0x5EED0F7E47)


def held_out(doc_id) -> bool:
    """The remainder of crc32 by 10 is 0; a null doc_id is in training."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def _tokens(row):
    """Token hashes of a chunk (words lower-cased, an end after each text) and each text's end."""
    data, off = opened(row)
    parts, ends, a, held = [], [], 0, 0
    while a < len(off) - 1:
        z = max(a + 1, int(np.searchsorted(off, off[a] + BLOCK_BYTES, side="right")) - 1)
        text = flat.LOWER[data[off[a]:off[z]]]
        start, end, first = flat.words(text, off[a:z + 1] - off[a])
        tokens = np.empty(len(start) + z - a, np.uint64)
        ends.append(first[1:] + np.arange(1, z - a + 1))
        at = np.ones(len(tokens), bool)
        at[ends[-1] - 1] = False
        tokens[at] = flat.word_hashes(text, start, end)
        tokens[~at] = _END_HASH
        parts.append(tokens)
        ends[-1] = ends[-1] + held
        held += len(tokens)
        a = z
    return np.concatenate(parts), np.concatenate(ends)


def _training(row, ends):
    held = np.array([held_out(i) for i in row["ids"]], bool)
    return held, np.repeat(~held, np.diff(ends, prepend=0))


def tokenised(docs: DataFrame) -> tuple[DataFrame, int]:
    """The number of the exchange's buckets, and a written table: per chunk the token stream over its distinct words, and each word's training
    count in the whole corpus. ``lead`` marks one chunk of all that hold a word."""
    chunks = chunked(docs, CHUNK_BYTES)
    n = buckets(chunks)
    size = chunks.agg(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)"))).first()[0] or 0
    # MIN_BUCKETS only from MIN_BUCKETS * STEP_BYTES on
    few = max(1, min(n, -(-size // STEP_BYTES))) if n == MIN_BUCKETS else n

    def words(row):
        tokens, ends = _tokens(row)
        _, train = _training(row, ends)
        u, inv = np.unique(tokens, return_inverse=True)
        return u, {"word": u, "times": np.bincount(inv[train], minlength=len(u)).astype(np.uint64)}

    def meet(f):
        _, lead, back = np.unique(f["word"], return_index=True, return_inverse=True)
        total = np.bincount(back, weights=f["times"].astype(float))
        one = np.zeros(len(back), np.uint64)
        one[lead] = 1
        return {"total": total[back].astype(np.uint64), "lead": one}

    known = joined(chunks.repartition(few, "chunk"), ask(chunks, n, words, meet, {"word": 7, "times": 5}, {"total": 6, "lead": 1}), "counts")

    def out(batches):
        for b in batches:
            for row in rows_of(b):
                tokens, ends = _tokens(row)
                held, _ = _training(row, ends)
                u, inv = np.unique(tokens, return_inverse=True)
                z = lambda x, w: pa.array([_packed(x, w)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["chunk"]], pa.int64()), pa.array([row["ids"]], pa.list_(pa.int64())), pa.array([held.tolist()], pa.list_(pa.bool_())),
                     pa.array([ends.tolist()], pa.list_(pa.int64())), z(u, 8), z(inv, 4),
                     z(replied(row["counts"], u, n, "total", 6), 6), z(replied(row["counts"], u, n, "lead", 1), 1)],
                    ["chunk", "ids", "held", "ends", "words", "stream", "total", "lead"])
        release()
    rows = _bucketed(known.mapInArrow(out, "chunk bigint, ids array<bigint>, held array<boolean>, ends array<bigint>, words binary, "
                                      "stream binary, total binary, lead binary"), few)
    _dropped(chunks)
    return rows, few


def _bucketed(df: DataFrame, n: int) -> DataFrame:
    """``df`` as a written table in ``n`` buckets by chunk: a join by chunk shuffles the other side only."""
    spark, name = df.sparkSession, f"tokens_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    df.write.format("parquet").bucketBy(n, "chunk").option("path", path).saveAsTable(name)
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")                       # external: the name goes, the files stay
    return rows


#: Setting one up costs more than packing a short array.
_PACKER, _OPENER = zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()


def _packed(x: np.ndarray, width: int) -> bytes:
    return _PACKER.compress(x.astype(f"<u{width}").tobytes() if width in (1, 4, 8) else pack(x.astype(np.uint64), width))


def _unpacked(b: bytes, width: int) -> np.ndarray:
    raw = _OPENER.decompress(b)
    return np.frombuffer(raw, f"<u{width}") if width in (1, 4, 8) else unpack(raw, width)


def _open(row):
    """The distinct words, the stream, each word's training count, its lead mark, the texts' ends and held-out marks."""
    return (_unpacked(row["words"], 8), _unpacked(row["stream"], 4).astype(np.int64), _unpacked(row["total"], 6).astype(np.int64),
            _unpacked(row["lead"], 1) > 0 if "lead" in row else None, np.array(row["ends"], np.int64), np.array(row["held"], bool))


def _bands(total: np.ndarray) -> np.ndarray:
    return CLASSES + np.minimum(np.frexp(np.maximum(total, 1).astype(float))[1] - 1, BANDS - 1)


def _previous(cls: np.ndarray, ends: np.ndarray) -> np.ndarray:
    before = np.empty_like(cls)
    before[1:] = cls[:-1]
    before[np.concatenate(([0], ends[:-1]))] = _END
    return before


def _starting(words: np.ndarray, total: np.ndarray) -> np.ndarray:
    out = np.where(total >= LEAST, (words % np.uint64(CLASSES)).astype(np.int64), _bands(total))
    out[words == _END_HASH] = _END
    return out


def _moving(words: np.ndarray, total: np.ndarray, half: int) -> np.ndarray:
    """Places of the words whose turn it is."""
    return np.flatnonzero((total >= LEAST) & (words != _END_HASH) & ((words >> np.uint64(13)) % np.uint64(2) == half))


def _contexts(rows: DataFrame, n: int, half: int) -> DataFrame:
    """A written table. Of each chunk a row of bucket -1: its words' classes after the last round (``cls``)
    and its training transitions; and a row for each bucket with words of the chunk that move next: their
    hashes, classes, numbers of contexts, and the contexts (``code``: each class before, from 0, and
    after, from _ALL) with their counts."""
    names = ["cls", "trans", "words", "own", "sizes", "code", "times"]

    def run(batches):
        for b in batches:
            for row in rows_of(b):
                words, stream, total, _, ends, out = _open(row)
                if "cls" in row:
                    cls, moved = _unpacked(row["cls"], 1).astype(np.int64), _moving(words, total, 1 - half)
                    cls[moved] = replied(row["answers"], words[moved], n, "best", 1).astype(np.int64)
                else:
                    cls = _starting(words, total)
                mine = _moving(words, total, half)
                kind = np.int32 if 2 * _ALL * len(mine) < 1 << 31 else np.int64
                c, use = cls.astype(kind)[stream], np.repeat(~out, np.diff(ends, prepend=0))
                before = _previous(c, ends)
                trans = np.bincount((before * _ALL + c)[use], minlength=_ALL * _ALL)
                place = np.full(len(words), -1, kind)
                place[mine] = np.arange(len(mine))
                w = place[stream]
                at = np.flatnonzero(use & (w >= 0))           # an end follows the last word, so at + 1 exists
                w = w[at] * (2 * _ALL)
                key, times = np.unique(np.concatenate((w + before[at], w + _ALL + c[at + 1])), return_counts=True)
                sizes = np.bincount(key // (2 * _ALL), minlength=len(mine))
                code, h, own = key % (2 * _ALL), words[mine], cls[mine]
                found, first = np.unique(bucket_of(h, n), return_index=True)    # words, so their buckets, ascend
                first = np.append(first, len(mine))
                last = np.concatenate(([0], np.cumsum(sizes)))[first]
                cols = [[_packed(cls, 1)], [_packed(trans, 6)], [None], [None], [None], [None], [None]]
                for a, z, x, y in zip(first.tolist(), first[1:].tolist(), last.tolist(), last[1:].tolist()):
                    for col, v in zip(cols, (None, None, _packed(h[a:z], 7), _packed(own[a:z], 1), _packed(sizes[a:z], 1),
                                             _packed(code[x:y], 1), _packed(times[x:y], 4))):
                        col.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["chunk"]] * len(cols[0]), pa.int64()), pa.array([-1, *found.tolist()], pa.int32()),
                     *(pa.array(col, pa.binary()) for col in cols)], ["chunk", "bucket", *names])
        release()
    return table(rows.mapInArrow(run, "chunk bigint, bucket int, " + ", ".join(f"{c} binary" for c in names)), "contexts")


def _transitions(contexts: DataFrame) -> np.ndarray:
    def run(batches):
        t = np.zeros(_ALL * _ALL, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                t += _unpacked(x, 6).astype(np.int64)
        k = np.flatnonzero(t)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(t[k])], ["k", "n"])
    t = np.zeros(_ALL * _ALL)
    for r in contexts.where("bucket = -1").select("trans").mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect():
        t[r.k] = r.n
    return t.reshape(_ALL, _ALL)


def _classes(contexts: DataFrame) -> DataFrame:
    return contexts.where("bucket = -1").select("chunk", "cls")


def _xlogx(x):
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(t: np.ndarray) -> float:
    """Of the class bigrams; the words' own counts add a constant."""
    return float(_xlogx(t).sum() - _xlogx(t.sum(axis=0)).sum() - _xlogx(t.sum(axis=1)).sum())


def best_classes(own: np.ndarray, x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The exchange step of many words, each by itself: a word leaves its class in the class bigrams
    ``t`` and takes the class where their likelihood is highest. ``x[w, 0]`` counts the classes before
    word w, ``x[w, 1]`` those after it."""
    ks = np.arange(CLASSES)
    gain = np.zeros((len(own), CLASSES))
    for side in (0, 1):
        w, a = np.nonzero(x[:, side])
        if not len(w):
            continue
        n, c, each_t = x[w, side, a], own[w], t if side == 0 else t.T
        floor = np.maximum(each_t[:, :CLASSES], 0)
        # contexts alike in class and count change the likelihood alike, but for the word's own class
        pair, back = np.unique(n.astype(np.int64) * _ALL + a, return_inverse=True)
        change = (_xlogx(floor[pair % _ALL] + (pair // _ALL)[:, None]) - _xlogx(floor)[pair % _ALL])[back]
        left = np.maximum(each_t[a, c] - n, 0)                  # the word has left its class
        change[np.arange(len(w)), c] = _xlogx(left + n) - _xlogx(left)
        same = np.flatnonzero(a == c)
        base = each_t[a[same], :CLASSES]
        base[np.arange(len(same)), c[same]] -= n[same]
        base = np.maximum(base - x[w[same], 1 - side, :CLASSES], 0)
        change[same] = _xlogx(base + n[same, None]) - _xlogx(base)
        first = np.flatnonzero(np.diff(w, prepend=-1))
        gain[w[first]] += np.add.reduceat(change, first)
    # where a class is before and after the word, both counts come into one bigram
    l, r = x[:, 0, :CLASSES], x[:, 1, :CLASSES]
    d = np.maximum(np.diag(t)[:CLASSES] - (l + r) * (ks == own[:, None]), 0)
    gain += _xlogx(d + l + r) - _xlogx(d + l) - _xlogx(d + r) + _xlogx(d)
    n = x[:, 0].sum(axis=1, keepdims=True)
    size = np.maximum(t.sum(axis=0)[:CLASSES] - n * (ks == own[:, None]), 0)
    gain -= 2 * (_xlogx(size + n) - _xlogx(size))
    at = np.arange(len(own))
    gain[at, own] += 1e-9 * np.maximum(1.0, np.abs(gain[at, own]))
    return gain.argmax(axis=1)


def moves(f: dict, t: np.ndarray) -> np.ndarray:
    """The best class of each entry of a bucket: ``words``, ``own`` (class) and ``sizes`` (contexts) by entry,
    ``code`` and ``times`` by context. ``t`` are the class bigrams before the round."""
    u, back = np.unique(f["words"], return_inverse=True)
    own = np.empty(len(u), np.int64)
    own[back] = f["own"]                                   # the same in every chunk
    owner, times = np.repeat(back, f["sizes"].astype(np.int64)), f["times"].astype(float)
    order = np.argsort(-np.bincount(owner, weights=times, minlength=len(u)), kind="stable")
    rank = np.empty(len(u), np.int64)
    rank[order] = np.arange(len(u))
    # frequent words one by one, rarer ones in steps; the bigrams follow the bucket's moves
    cuts = [0]
    while cuts[-1] < len(u):
        cuts.append(min(len(u), cuts[-1] + min(1024, max(1, cuts[-1] // 32))))
    key = rank[owner] * (2 * _ALL) + f["code"].astype(np.int64)
    if blocks := len(u) > BLOCK_WORDS:
        by = np.argsort(key)
        key, times = key[by], times[by]
    best, t, lo, hi = own.copy(), t.copy(), 0, 0
    for a, z in zip(cuts, cuts[1:]):
        if z > hi:
            lo, hi = a, min(len(u), a + BLOCK_WORDS)
            i, j = np.searchsorted(key, (lo * 2 * _ALL, hi * 2 * _ALL)) if blocks else (0, len(key))
            block = np.bincount(key[i:j] - lo * 2 * _ALL, weights=times[i:j], minlength=(hi - lo) * 2 * _ALL).reshape(-1, 2, _ALL)
        some, x = order[a:z], block[a - lo:z - lo]
        best[some] = to = best_classes(own[some], x, t)
        go = np.flatnonzero(to != own[some])
        if len(go):
            step = np.zeros((len(go), _ALL))
            step[np.arange(len(go)), to[go]] = 1
            step[np.arange(len(go)), own[some][go]] = -1
            t += x[go, 0].T @ step + step.T @ x[go, 1]
            np.maximum(t, 0, out=t)
    return best[back]


def _exchange(contexts: DataFrame, n: int, t: np.ndarray) -> DataFrame:
    """``(chunk, answers)``: the best class of every word whose turn it is."""
    held = contexts.sparkSession.sparkContext.broadcast(t)

    def meet(rows: pa.Table) -> pa.Table:
        f = {c: [_unpacked(x, w) for x in rows.column(c).to_pylist()] for c, w in (("words", 7), ("own", 1), ("sizes", 1), ("code", 1), ("times", 4))}
        ends = np.cumsum([len(x) for x in f["words"]])
        best = moves({c: np.concatenate(x) for c, x in f.items()}, held.value)
        out = pa.array([_packed(x, 1) for x in np.split(best, ends[:-1])], pa.binary())
        release()
        return pa.Table.from_arrays([rows.column("bucket").combine_chunks(), rows.column("chunk").combine_chunks(), out], ["bucket", "chunk", "best"])

    sent = contexts.where("bucket >= 0").select("bucket", "chunk", "words", "own", "sizes", "code", "times")
    back = sent.groupBy("bucket").applyInArrow(lambda rows: meet(rows), "bucket int, chunk bigint, best binary")
    return back.repartition(n, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "best")).alias("answers"))


def _dropped(written: DataFrame) -> None:
    """Deletes a round's written table, and lets Spark clean the shuffles that no one holds."""
    jvm, files = written.sparkSession._jvm, written.inputFiles()
    if files:
        path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(written.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()


class Model:
    """Class transitions and emissions; the words' classes stay in their chunks."""


def fit(rows: DataFrame, n: int):
    """The chunks with their words' classes, the model (transitions and emission totals), N and V."""
    half, idle = 0, 0
    now = best = _contexts(rows, n, half)
    t = top = _transitions(now)
    while t.any():
        answers = _exchange(now, n, t)
        half = 1 - half
        new = _contexts(rows.select("chunk", "held", "ends", "words", "stream", "total").join(_classes(now), "chunk")
                        .join(answers, "chunk", "left"), n, half)
        del answers
        t = _transitions(new)
        if now is not best:
            _dropped(now)
        now, idle = new, idle + 1
        if likelihood(t) > likelihood(top):
            if likelihood(t) - likelihood(top) > RISE * abs(likelihood(top)):
                idle = 0
            _dropped(best)
            best, top = now, t
        if idle == 2:
            break
    rows, t = rows.join(_classes(best), "chunk"), top

    def sizes(batches):
        tokens, words = np.zeros(_ALL, np.int64), np.zeros(_ALL, np.int64)
        for b in batches:
            for row in rows_of(b):
                _, _, total, lead, _, _ = _open(row)
                at = lead & (total > 0)
                cls = _unpacked(row["cls"], 1)[at].astype(np.int64)
                tokens += np.bincount(cls, weights=total[at], minlength=_ALL).astype(np.int64)
                words += np.bincount(cls, minlength=_ALL)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_ALL)), pa.array(tokens), pa.array(words)], ["k", "n", "v"])
    tokens, words = np.zeros(_ALL), np.zeros(_ALL)
    for r in rows.mapInArrow(sizes, "k bigint, n bigint, v bigint").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        tokens[r.k], words[r.k] = r.n, r.v
    n_all, v_all = int(tokens.sum()), int(words.sum())
    words[CLASSES] += 1                                   # the unknown word
    model = Model()
    model.emission = np.log10(np.maximum(tokens + ADD * words, ADD))
    single = (t.sum(axis=0) + ADD) / (t.sum() + ADD * _ALL)
    model.transition = np.log10((t + BACKOFF * single) / (t.sum(axis=1, keepdims=True) + BACKOFF))
    return rows, model, n_all, v_all


def score(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (smoothed unigrams), score (class n-grams) as log10 probabilities, and perplexity.

    Null and empty texts are one end token. Repeated rows count as often as they occur. Without training
    rows all counts are 0 and texts get the smoothing's probability. An empty table gives no rows;
    further columns are not read."""
    rows, model, n_all, v_all = fit(*tokenised(docs))
    held = rows.sparkSession.sparkContext.broadcast(model)
    base = float(np.log10(n_all + ADD * (v_all + 1)))

    def run(batches):
        m = held.value
        for b in batches:
            for row in rows_of(b):
                words, stream, total, _, ends, out = _open(row)
                cls = _unpacked(row["cls"], 1).astype(np.int64)[stream]
                emit = np.log10(total + ADD)[stream]
                begin = np.concatenate(([0], ends[:-1]))
                add = lambda x, begin=begin: np.add.reduceat(x, begin)
                size, own = np.diff(ends, prepend=0), add(emit)
                model_score = own + add(m.transition[_previous(cls, ends), cls] - m.emission[cls])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(out), pa.array(size), pa.array(add((total > 0)[stream].astype(np.int64))),
                     pa.array(np.full(len(size), n_all)), pa.array(own - size * base), pa.array(model_score),
                     pa.array(10.0 ** np.minimum(-model_score / size, 300))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                            "base_score double, score double, perplexity double")
    return found.withColumn("doc_id", found["doc_id"].cast(kind))
