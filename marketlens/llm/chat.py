"""Chat formatting with typed content parts: a visitor flattens text, image, audio and document
parts into ordered placeholders and records attachments and their expanded token counts."""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template's own marks; no text can hold them unescaped.
_ROLE, _TEXT, _END = "<|role|>", "<|text|>", "<|end|>\n"
_CONTROL = re.compile(r"<\||</?s>|\[/?INST\]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|role\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.S)
#: Pixels of a patch, audio tokens a second, tokens of a document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 256
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: str) -> str:
    """Backslashes are doubled and a backslash splits every control string; reversible."""
    return _CONTROL.sub(lambda m: m.group()[0] + "\\" + m.group()[1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Flattener:
    """Visits the parts of one turn in order; ``text`` is the flattened content."""

    def __init__(self, attachments: list, turn: int):
        self.out, self.attachments, self.turn = [], attachments, turn

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part):
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part):
        w, h = part.get("width") or 0, part.get("height") or 0
        self._attach("image", part, math.ceil(w / PATCH) * math.ceil(h / PATCH))

    def visit_audio(self, part):
        self._attach("audio", part, math.ceil((part.get("seconds") or 0) * AUDIO_RATE))

    def visit_document(self, part):
        self._attach("document", part, (part.get("pages") or 0) * PAGE_TOKENS)

    def visit_unknown(self, part):
        self._attach("other", part, 0)

    def _attach(self, kind, part, tokens):
        self.out.append(f"<|{kind} {len(self.attachments)}|>")
        self.attachments.append((self.turn, kind, part.get("ref"), tokens))

    @property
    def text(self) -> str:
        return "".join(self.out)


def formatted(turns: list[tuple[str, list[dict]]]) -> tuple[str, list[tuple[int, int]], list]:
    """The formatted text, its loss mask (code points of assistant contents) and its attachments."""
    out, at, mask, attachments = [], 0, [], []
    for n, (role, parts) in enumerate(turns):
        v = Flattener(attachments, n)
        for p in parts:
            v.visit(p)
        head, body = _ROLE + escape(role) + _TEXT, v.text
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, _END]
        at += len(head) + len(body) + len(_END)
    return "".join(out), mask, attachments


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, content) of each turn, unescaped."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def with_parts(conversations: DataFrame) -> DataFrame:
    """Plain text as one text part, whatever it holds; null text is empty."""
    nothing = ", ".join(f"CAST(NULL AS {t}) AS {n}" for n, t in
                        (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))
    return conversations.select("conv_id", "turn", "role", F.expr(
        f"array(struct('text' AS type, coalesce(text, '') AS text, {nothing}))").alias("parts"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, parts)`` -> one row per conversation: the formatted text, the loss
    mask, attachments with references and token counts, and total expanded tokens.

    Turns are ordered by turn, ties by role and parts; a null role is the empty role; null parts are
    no content; null conv_ids form one conversation; an empty table gives no rows. A conversation is
    one output value, so its turns meet in one row; nothing else is gathered."""
    grouped = (turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), "parts").alias("t"))
               .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))
    kind = turns.schema["conv_id"].dataType.simpleString()
    item = pa.struct([("turn", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for b in batches:
            texts, masks, items = [], [], []
            for rows in b.column(1).to_pylist():
                t, m, a = formatted([(r["role"], r["parts"] or []) for r in rows])
                texts.append(t)
                masks.append([{"start": x, "end": y} for x, y in m])
                items.append([{"turn": n, "kind": k, "ref": r, "tokens": c} for n, k, r, c in a])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(texts, pa.string()), pa.array(masks, pa.list_(span)), pa.array(items, pa.list_(item))],
                ["conv_id", "formatted", "loss_mask", "attachments"])
    return grouped.mapInArrow(run, f"conv_id {kind}, formatted string, loss_mask array<struct<start:bigint,end:bigint>>, "
                              "attachments array<struct<turn:int,kind:string,ref:string,tokens:bigint>>")


def digests(done: DataFrame) -> DataFrame:
    """What is read back from formatted conversations, as counts and digests."""
    kind = done.schema["conv_id"].dataType.simpleString()

    def run(batches):
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            cols = [[] for _ in range(5)]
            for text, mask in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                turns = read_back(text)
                loss = "".join(unescape(text[m["start"]:m["end"]]) for m in mask)
                for c, v in zip(cols, (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text))):
                    c.append(v)
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))],
                                             ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    return done.select("conv_id", "formatted", "loss_mask").mapInArrow(
        run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
