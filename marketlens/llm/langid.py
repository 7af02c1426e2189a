"""Language identification by hierarchical discrimination: duels of linear support vector machines choose
the language family, then one-versus-one machines choose among the languages of that family.

Features are hashed counts of letter n-grams within words (word ends marked), square-rooted and scaled to
unit length, over the whole lower-cased text. Machines are trained on a bounded sample of labelled
documents, each duel in a task of its own; every document is then judged where it lies."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens.llm.common import broadcast_if_small, table

#: Hash buckets of the n-grams, as a power of two.
BITS = 12
DIM = 1 << BITS
#: Labelled documents that the machines see: of one language at most, and of all of them (but MIN_ROWS of each).
MAX_ROWS, ALL_ROWS, MIN_ROWS = 1000, 6000, 20
#: Rounds over the sample and the price of a margin error.
ROUNDS, COST = 30, 1.0
#: Margins are scaled by this before they are squashed into a score.
SLOPE = 3.0
#: Characters whose n-grams are counted at once; longer texts are cut between words.
PIECE = 1 << 20
#: No letter to judge by.
UNKNOWN = "und"
# Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl it la oc pt ro sc wa",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv kw",
    "indo-aryan": "as bn gu hi mr ne or pa sa sd si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt ti",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "uralic": "et fi hu se",
    "dravidian": "kn ml ta te",
    "austronesian": "id jv mg mi ms su tl",
    "bantu": "ln rw sn sw xh zu",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    """The family of a language tag, by its first subtag; a language that is not listed is its own family."""
    return _FAMILY.get(lang.replace("_", "-").split("-")[0].lower(), lang)


_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of about PIECE characters, cut before a blank if one follows within a piece's length."""
    at = 0
    while len(text) - at > PIECE:
        cut = text.find(" ", at + PIECE, at + 2 * PIECE)
        cut = min(len(text), at + 2 * PIECE) if cut < 0 else cut
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def _count(texts: list[str]) -> np.ndarray:
    """Counts ``(text, bucket)`` of the letters, letter pairs and triples of each word, word ends marked."""
    flat = "".join(f"\n{t}\n" for t in texts)
    code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), "<u4")
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) + 2 for t in texts])
    letter = _is_letter()[code]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]                       # the first symbol after a word marks its end
    code, doc, letter = np.where(letter, code, 0)[keep].astype(np.uint32), doc[keep], letter[keep]

    def place(h):
        return ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)
    p = np.uint32(0x01000193)
    one = place(code[letter] + np.uint32(1))
    pair = place((code[:-1] * p + code[1:]) ^ np.uint32(0x55555555))
    at = [doc[letter] * DIM + one, np.where(letter[:-1], doc[:-1], doc[1:]) * DIM + pair]
    mid = np.flatnonzero(letter[1:-1]) + 1
    at.append(doc[mid] * DIM + place(((code[mid - 1] * p + code[mid]) * p + code[mid + 1]) ^ np.uint32(0x33333333)))
    return np.bincount(np.concatenate(at), minlength=len(texts) * DIM).reshape(len(texts), DIM)


def features(texts: list[str]) -> np.ndarray:
    """Unit rows; a text without a letter has a row of zeros."""
    out = np.zeros((len(texts), DIM), np.float32)
    held, size = [], 0

    def flush():
        if held:
            np.add.at(out, [i for i, _ in held], _count([t for _, t in held]).astype(np.float32))
            held.clear()
    for i, text in enumerate(texts):
        for piece in _pieces(text.lower()):
            if size + len(piece) > PIECE:
                flush()
                size = 0
            held.append((i, piece))
            size += len(piece)
    flush()
    np.sqrt(out, out=out)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and, last, the bias of a linear support vector machine (squared hinge, both sides weighing
    the same) by dual coordinate descent in a fixed order. ``y``: 1 or -1."""
    x = np.concatenate((x, np.ones((len(x), 1), x.dtype)), axis=1).astype(float)
    price = COST * np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    soft = 1 / (2 * price)
    q = (x * x).sum(axis=1) + soft
    w, a = np.zeros(x.shape[1]), np.zeros(len(x))
    order = np.random.default_rng(7)
    for _ in range(ROUNDS):
        moved = 0.0
        for i in order.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + soft[i] * a[i]
            new = max(0.0, a[i] - g / q[i])
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-4:
            break
    return w


def _sample(docs: DataFrame) -> DataFrame:
    """``(lang, text)``: the first texts of each language by hash, equal ones once."""
    keyed = docs.select("lang", F.xxhash64("text").alias("key"), "doc_id").groupBy("lang", "key").agg(F.min("doc_id").alias("doc_id"))
    keyed = table(keyed, "texts")
    sizes = table(keyed.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    cap = max(MIN_ROWS, min(MAX_ROWS, ALL_ROWS // max(1, sizes.count())))
    # hashes are spread evenly: only about twice the wanted rows of a language meet in its window
    low = F.expr(f"key / 18446744073709551616D + 0.5D <= {2 * cap + 100}D / n")
    first = Window.partitionBy("lang").orderBy("key")
    chosen = (keyed.join(broadcast_if_small(sizes), "lang").where(low).drop("n")
              .withColumn("r", F.row_number().over(first)).where(F.col("r") <= cap).drop("r"))
    rows = (docs.select("lang", "text", "doc_id", F.xxhash64("text").alias("key"))
            .join(broadcast_if_small(table(chosen, "chosen")), ["lang", "key", "doc_id"], "left_semi"))
    return rows.groupBy("lang", "key").agg(F.min("text").alias("text")).select("lang", "text")


def _rows(sample: DataFrame) -> DataFrame:
    """``(lang, at, value)``: the sample's features, sparse; texts without a letter are left out."""
    def run(batches):
        for b in batches:
            x = features(b.column(1).to_pylist())
            rows = [np.flatnonzero(r) for r in x]
            used = [i for i, r in enumerate(rows) if len(r)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(used, pa.int32())), pa.array([rows[i].astype(np.int32) for i in used], pa.list_(pa.int32())),
                 pa.array([x[i][rows[i]] for i in used], pa.list_(pa.float32()))], ["lang", "at", "value"])
    return table(sample.mapInArrow(run, "lang string, at array<int>, value array<float>"), "features")


def duels(langs: list[str]) -> list[tuple[str, str, str]]:
    """``(level, a, b)``: every two families, and every two languages of one family."""
    by = {f: sorted(x for x in langs if family(x) == f) for f in sorted({family(x) for x in langs})}
    return ([("family", a, b) for a, b in itertools.combinations(by, 2)]
            + [("language", a, b) for group in by.values() for a, b in itertools.combinations(group, 2)])


def fit(docs: DataFrame) -> dict:
    """The model learned from ``docs(doc_id, text, lang)``: its languages and a machine for every duel.

    At most MAX_ROWS texts a language, chosen by hash; null texts, null languages and texts without a letter
    teach nothing. The model's size follows the number of languages alone."""
    rows = _rows(_sample(docs.where("text IS NOT NULL AND lang IS NOT NULL")))
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    fights = duels(langs)
    taking = [(lang, k, int(lang == a or level == "family" and family(lang) == a) * 2 - 1)
              for k, (level, a, b) in enumerate(fights) for lang in langs
              if (lang if level == "language" else family(lang)) in (a, b)]
    if not fights:
        return {"langs": langs, "duels": [], "weights": np.zeros((0, DIM + 1))}
    sides = F.broadcast(rows.sparkSession.createDataFrame(taking, "lang string, duel int, y int"))

    def train(t: pa.Table) -> pa.Table:
        t = t.sort_by([("y", "ascending"), ("lang", "ascending")])
        sizes = t.column("at").combine_chunks().value_lengths().to_numpy()
        x = np.zeros((t.num_rows, DIM), np.float32)
        x[np.repeat(np.arange(len(sizes)), sizes), t.column("at").combine_chunks().flatten().to_numpy()] = \
            t.column("value").combine_chunks().flatten().to_numpy()
        y = t.column("y").to_numpy()
        by = np.lexsort((x @ np.cos(np.arange(DIM)), y))        # an order that does not depend on how rows arrive
        return pa.table({"duel": t.column("duel").slice(0, 1), "w": pa.array([machine(x[by], y[by])])})
    found = rows.join(sides, "lang").groupBy("duel").applyInArrow(train, "duel int, w array<double>").collect()
    return {"langs": langs, "duels": fights, "weights": np.array([r["w"] for r in sorted(found, key=lambda r: r["duel"])])}


def _won(score: np.ndarray, names: list[str], fights: list[tuple[int, str, str]]) -> np.ndarray:
    """``(text, name)``: the mean share that each name gets in its duels; 1 if it has no rival."""
    out = np.zeros((len(score), len(names)))
    for k, a, b in fights:
        p = 1 / (1 + np.exp(-SLOPE * score[:, k]))
        out[:, names.index(a)] += p
        out[:, names.index(b)] += 1 - p
    return out / (len(names) - 1) if len(names) > 1 else out + 1


def predict(model: dict, texts: list[str]) -> tuple[list[str], np.ndarray]:
    x = features(texts)
    score = x @ model["weights"][:, :-1].T.astype(np.float32) + model["weights"][:, -1]
    by = {f: [x for x in model["langs"] if family(x) == f] for f in sorted({family(x) for x in model["langs"]})}
    names = list(by)
    share = _won(score, names, [(k, a, b) for k, (level, a, b) in enumerate(model["duels"]) if level == "family"])
    best = share.argmax(axis=1) if names else np.zeros(len(x), int)
    lang, sure = np.full(len(x), UNKNOWN, object), np.zeros(len(x))
    lettered = x.any(axis=1)
    for f, name in enumerate(names):
        mine = np.flatnonzero((best == f) & lettered)
        inner = _won(score[mine], by[name], [(k, a, b) for k, (level, a, b) in enumerate(model["duels"])
                                             if level == "language" and a in by[name]])
        lang[mine] = np.array(by[name], object)[inner.argmax(axis=1)]
        sure[mine] = share[mine, f] * inner.max(axis=1)
    return lang.tolist(), sure


def identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row of ``docs(doc_id, text, lang)``.

    Learns from the rows where ``held_out`` is false and predicts from the text alone. ``lang_pred`` is a learned
    language, ``und`` with score 0 if the text is null or has no letter, or if nothing was learned; ``score``
    is the family's share of its duels times the language's. Rows where ``held_out`` is null (null doc_id) are
    not learned from and returned as false. Repeated rows get equal results; an empty table gives no rows;
    other columns are not read. Texts of any length are read whole; texts over PIECE characters are counted
    in pieces cut between words (inside one if it is longer than that)."""
    model = fit(docs.where(~held_out))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            lang, sure = predict(model, [t or "" for t in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(sure)],
                                             ["doc_id", "held_out", "lang_pred", "score"])
    return (docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
            .mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double"))
