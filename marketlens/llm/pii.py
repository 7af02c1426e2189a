"""Personal data by weak supervision: candidate spans, labelers that vote on them, expectation
maximisation over the vote patterns, and a span classifier trained on its posteriors."""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "iban", "national_id")
# The base patterns.
_PATTERN = {
    "ip": re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
# The base email pattern in its two halves, of which the first is read backwards from each @.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_MORE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z0-9-]{1,63})+"),
    "phone": re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])"),
    # the value behind = or :, with or without blanks and quotes; one in closed quotes is taken whole
    "secret": re.compile(r"""[=:]>?[ \t]*+(?:"([^"\r\n]{6,})"|'([^'\r\n]{6,})'|["']?([^\s"'<>&,;=:]{6,}))"""),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}
#: No kind can occur in a text without one of these.
_HINT = re.compile(r"[0-9@=:]|[(\[]at[)\]]")
# Gazetteers.
_TLDS = frozenset("com org net edu gov mil int info biz io de fr es it uk eu ch at nl pl us ca au in cn jp br ru".split())
_KEYWORDS = frozenset("password passwd pwd passphrase secret token apikey api_key api-key access_key auth_token".split())
_CUES = re.compile(r"(?i)\b(mail|e-?mail|call|phone|tel|fax|mobile|contact|card|visa|account|ip|host|server|address|iban|ssn|social|login|user)\b")
_COUNTER = re.compile(r"(?i)\b(version|release|isbn|order|figure|table|chapter|section|issue|doi)\b")
LABELERS = ("format", "checksum", "gazetteer", "context", "boundary", "variety")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))
    if kind == "card":
        d = _digits(s)
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(_digits(s)) <= 15
    return True


def _emails(text: str):
    """Leftmost non-overlapping emails, in linear time however long a word is: each @ takes the
    letters before it, back to the last match or @."""
    last, at = 0, text.find("@")
    while at >= 0:
        local = _LOCAL.match(text[last:at][::-1])
        domain = local and _DOMAIN.match(text, at)
        if domain:
            yield at - local.end(), domain.end()
        last = domain.end() if domain else at + 1
        at = text.find("@", last)


def _matches(kind: str, text: str):
    return _emails(text) if kind == "email" else (m.span() for m in _PATTERN[kind].finditer(text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans: leftmost non-overlapping matches of each kind that pass its check."""
    if not _HINT.search(text):
        return []
    return [(k, a, b) for k in BASE for a, b in _matches(k, text) if _valid(k, text[a:b])]


def _iban(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _mixed(s: str) -> bool:
    """Letters and digits in one word."""
    return bool(re.search(r"[0-9]", s) and re.search(r"[^\W\d_]", s)) and not re.search(r"\s", s)


def _named_secret(before: str) -> bool:
    """The word before the = or : names a secret; blanks and quotes around it do not matter."""
    return re.split(r"[^a-z0-9_-]+", before.rstrip("=:> \t\"'").lower())[-1] in _KEYWORDS


def _votes(kind: str, text: str, a: int, b: int, strict: bool) -> int:
    """The labelers' votes (1 for, 2 against, 0 abstains) as one base-3 number with the kind."""
    s, before = text[a:b], text[max(0, a - 40):a]
    digits = _digits(s)
    check = {"card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "ip": lambda: _valid("ip", s),
             "phone": lambda: 9 <= len(digits) <= 15, "iban": lambda: _iban(s),
             "national_id": lambda: digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00"}
    known = {"email": lambda: s.rsplit(".", 1)[-1].strip().lower() in _TLDS, "card": lambda: s[0] in "3456",
             "secret": lambda: _named_secret(before)}
    tell = lambda good, bad: 1 if good else 2 if bad else 0
    votes = (
        # a named secret may be a plain word too
        tell(strict, not strict and not (kind == "secret" and _named_secret(before))),
        tell(check[kind](), True) if kind in check else 0,
        tell(known[kind](), kind != "email") if kind in known else 0,
        tell(_CUES.search(before), _COUNTER.search(before)),
        tell(False, (a and text[a - 1].isalnum()) or text[b:b + 1].isalnum()) or 1,
        # a plain word or number behind a colon is no sign of a secret
        tell(len(set(s)) > 4 and (strict or kind != "secret"), len(set(s)) < 3),
    )
    code = KINDS.index(kind)
    for v in votes:
        code = code * 3 + v
    return code


def candidates(text: str) -> list[tuple[str, int, int, int, bool]]:
    """(kind, start, end, vote pattern, is a base span) of every candidate span of a whole text."""
    if not _HINT.search(text):
        return []
    out, base = [], {k: [] for k in KINDS}
    for k in BASE:
        for a, b in _matches(k, text):
            found = text[a:b]
            ok = _valid(k, found)
            # digit runs far from a card's length are no candidates
            if ok or k == "ip" or 12 <= len(_digits(found)) <= 20:
                out.append((k, a, b, _votes(k, text, a, b, ok), ok))
                if ok:
                    base[k].append((a, b))
    taken = sorted(x for v in base.values() for x in v)
    at = 0
    for k, p in _MORE.items():
        at = 0
        for m in p.finditer(text):
            a, b = m.span(m.lastindex or 0)
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            # a named secret stays whole, also if a digit run in it passes for a card
            if at == len(taken) or taken[at][0] >= b or (k == "secret" and _named_secret(text[max(0, a - 40):a])):
                out.append((k, a, b, _votes(k, text, a, b, k != "secret" or _mixed(text[a:b])), False))
    return out


def em(counts: dict[int, int], rounds: int = 50) -> dict[int, float]:
    """Pattern -> posterior of being personal data. One prior per kind; each labeler has, per class,
    a probability for every vote, shared by the kinds. At most len(KINDS) * 3**6 patterns exist."""
    codes = sorted(counts)
    if not codes:
        return {}
    votes = np.array([[c // 3 ** (len(LABELERS) - 1 - j) % 3 for j in range(len(LABELERS))] for c in codes])
    kind = np.array([c // 3 ** len(LABELERS) for c in codes])
    n = np.array([counts[c] for c in codes], float)
    q = np.clip(((votes == 1).sum(1) + 0.5) / ((votes > 0).sum(1) + 1.0), 0.05, 0.95)
    for _ in range(rounds):
        logit = np.zeros(len(codes))
        prior = np.array([(n[kind == k] @ q[kind == k] + 1) / (n[kind == k].sum() + 2) for k in range(len(KINDS))])
        logit += np.log(prior / (1 - prior))[kind]
        for j in range(len(LABELERS)):
            # a vote for counts at least as much among personal data as among the rest
            for v in (0, 1, 2):
                at = votes[:, j] == v
                p = (n[at] @ q[at] + 1) / (n @ q + 3)
                r = (n[at] @ (1 - q[at]) + 1) / (n @ (1 - q) + 3)
                logit[at] += np.log(p / r)
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return dict(zip(codes, q.tolist()))


def classifier(counts: dict[int, int], posterior: dict[int, float], steps: int = 300) -> dict[int, float]:
    """Logistic regression on kind and votes, fitted to the posteriors weighted by log count;
    returned as its probability for every pattern seen."""
    codes = sorted(counts)
    if not codes:
        return {}
    width = len(KINDS) + 3 * len(LABELERS)
    x = np.zeros((len(codes), width))
    for i, c in enumerate(codes):
        x[i, c // 3 ** len(LABELERS)] = 1
        for j in range(len(LABELERS)):
            x[i, len(KINDS) + 3 * j + c // 3 ** (len(LABELERS) - 1 - j) % 3] = 1
    y, w = np.array([posterior[c] for c in codes]), np.log1p(np.array([counts[c] for c in codes], float))
    theta = np.zeros(width)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ theta)))
        theta += 0.5 * ((x.T @ (w * (y - p))) / w.sum() - 1e-4 * theta)
    return dict(zip(codes, (1 / (1 + np.exp(-(x @ theta)))).tolist()))


def fit(docs: DataFrame) -> dict[int, float]:
    """Vote patterns are counted over every document; only their counts reach the driver."""
    def run(batches):
        found: dict[int, int] = {}
        for b in batches:
            for t in b.column(0).to_pylist():
                for c in candidates(t or ""):
                    found[c[3]] = found.get(c[3], 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], ["code", "n"])
    rows = (docs.select("text").mapInArrow(run, "code int, n bigint")
            .groupBy("code").agg(F.sum("n").alias("n")).collect())
    counts = {r.code: r.n for r in rows}
    return classifier(counts, em(counts))


def spans(text: str, model: dict[int, float]) -> list[tuple[str, int, int]]:
    """All spans by kind, then start: base spans, and candidates that the classifier accepts."""
    found = [(KINDS.index(k), a, b) for k, a, b, code, base in candidates(text)
             if base or model.get(code, 0.0) >= 0.5]
    return [(KINDS[k], a, b) for k, a, b in sorted(found)]


def _join(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def annotate(docs: DataFrame, model: dict[int, float] | None = None) -> DataFrame:
    """One row per row of ``docs``: counts of the base kinds, the digest of the base spans, all spans.

    Null text is empty and has no spans; repeated rows are annotated alike; an empty table gives no
    rows and an empty model; further columns are not read. Offsets are code points, end exclusive."""
    model = fit(docs) if model is None else model

    def run(batches):
        for b in batches:
            cols = [[] for _ in range(6)]
            for t in b.column(1).to_pylist():
                every = spans(t or "", model)
                base = base_spans(t or "")
                for i, k in enumerate(BASE):
                    cols[i].append(sum(x[0] == k for x in base))
                cols[4].append(hashlib.sha256(_join(base).encode()).hexdigest())
                cols[5].append(_join(every))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])],
                ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, " + ", ".join(f"n_{k} bigint" for k in BASE) + ", base_sha256 string, spans string")


def redacted(text: str, model: dict[int, float]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, end = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans(text, model)):
        if a >= end:
            out += [text[end:a], f"[{k.upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:]


def redact(docs: DataFrame, model: dict[int, float] | None = None) -> DataFrame:
    """``docs`` with its columns, ``text`` redacted and ``n_chars`` (if there) brought up to date."""
    model = fit(docs) if model is None else model

    def run(batches):
        for b in batches:
            k = b.schema.get_field_index("text")
            new = pa.array([t if t is None else redacted(t, model) for t in b.column(k).to_pylist()],
                           b.schema.field(k).type)
            yield b.set_column(k, b.schema.field(k), new)
    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.expr("CASE WHEN text IS NULL THEN n_chars ELSE char_length(text) END")
                             .cast(docs.schema["n_chars"].dataType))
    return out


def model_json(model: dict[int, float]) -> str:
    return json.dumps({str(k): round(v, 6) for k, v in sorted(model.items())})
