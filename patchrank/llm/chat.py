"""Chat formatting with typed content parts.

A turn is a list of parts: text, image, audio, document. A visitor flattens them into one string with ordered placeholders, and records
where each attachment stands, what it refers to and how many tokens it expands to. A conversation is its turns in order; since the
template is local to a turn, turns are formatted where they lie, without a shuffle, however long a conversation is.

    <|turn:ROLE|>\\n BODY <|end|>\\n

Control strings inside roles and texts are broken by a backslash after their first character, and backslashes are doubled, so
``unescape`` restores every text exactly. Neighbouring text parts may hold a control string between them; a text part that could end
one begun in the parts before it starts with a backslash. The loss mask holds the text parts of the roles that are learned.
"""
from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchrank.llm.common import spread

CONTROL = ("<|", "|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>")
LEARNED = ("assistant",)
OPENING = frozenset(c[0] for c in CONTROL)
REACH = max(map(len, CONTROL)) - 1  # characters of the text so far that a control string may begin in
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
TURN = re.compile(r"<\|turn:(.*?)\|>\n(.*?)<\|end\|>\n", re.DOTALL)
PART = ("struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>")
TURNS = ("conv_id {conv}, turn {turn}, formatted STRING, loss ARRAY<STRUCT<start: INT, end: INT>>, "
         "attachments ARRAY<STRUCT<position: INT, kind: STRING, ref: STRING, tokens: INT>>")


def escape(text: str) -> str:
    if not any(c in text for c in ("\\", "<", "|", "[")):
        return text
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


@dataclass
class Flattener:
    """Visitor over the parts of one turn."""
    patch: int = 14
    audio_rate: float = 25.0
    page_tokens: int = 512
    out: list[str] = field(default_factory=list)
    at: int = 0
    tail: str = ""
    texts: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[tuple] = field(default_factory=list)

    def put(self, s: str) -> None:
        self.out.append(s)
        self.at += len(s)

    def visit(self, part: dict) -> None:
        kind = part.get("kind") or "text"
        getattr(self, f"visit_{kind}", self.visit_other)(part)

    def visit_text(self, part):
        body = escape(part.get("text") or "")
        if body:
            if body[0] != "\\" and not OPENING.isdisjoint(self.tail):
                body = "\\" + body
            self.tail = (self.tail + body)[-REACH:]
            self.texts.append((self.at, self.at + len(body)))
        self.put(body)

    def attach(self, kind, part, tokens):
        self.attachments.append((self.at, kind, part.get("ref"), tokens))
        self.put(f"<|{kind}:{len(self.attachments) - 1}|>")
        self.tail = ""

    def visit_image(self, part):
        self.attach("image", part, -(-(part.get("width") or 0) // self.patch) * -(-(part.get("height") or 0) // self.patch))

    def visit_audio(self, part):
        self.attach("audio", part, int(-(-(part.get("seconds") or 0.0) * self.audio_rate // 1)))

    def visit_document(self, part):
        self.attach("document", part, (part.get("pages") or 0) * self.page_tokens)

    def visit_other(self, part):
        self.attach("other", part, 0)


def format_turn(role: str | None, parts: list[dict], **options):
    """(formatted string, loss spans, attachments) of a turn, positions in code points."""
    flat = Flattener(**options)
    flat.put(f"<|turn:{escape(role or '')}|>\n")
    for part in parts:
        flat.visit(part)
    loss = flat.texts if role in LEARNED else []
    flat.put("<|end|>\n")
    return "".join(flat.out), loss, flat.attachments


def _formatter(options):
    def rows(stream):
        for batch in stream:
            out = [format_turn(r, [p for p in parts or () if p], **options) for r, parts in zip(batch.column("role").to_pylist(), batch.column("parts").to_pylist())]
            loss = [[{"start": a, "end": b} for a, b in x[1]] for x in out]
            attached = [[dict(zip(("position", "kind", "ref", "tokens"), a)) for a in x[2]] for x in out]
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            note = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array([x[0] for x in out], pa.string()), pa.array(loss, span), pa.array(attached, note)],
                ["conv_id", "turn", "formatted", "loss", "attachments"])
    return rows


def format_turns(turns: DataFrame, **options) -> DataFrame:
    """(conv_id, turn, formatted, loss, attachments), one row per turn of ``turns`` (conv_id, turn, role, and parts or text).

    A null text, part list or role is empty. A part without a kind is text; an unknown kind becomes a placeholder without tokens.
    """
    if "parts" not in turns.columns:
        text = F.struct(F.lit("text").alias("kind"), F.col("text").cast("string").alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (
            ("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])
        turns = turns.withColumn("parts", F.array(text))
    kinds = {"conv": turns.schema["conv_id"].dataType.simpleString(), "turn": turns.schema["turn"].dataType.simpleString()}
    return turns.select("conv_id", "turn", F.col("role").cast("string"), F.col("parts").cast(f"array<{PART}>")).mapInArrow(_formatter(options), TURNS.format(**kinds))


def _reader(stream):
    """Read conversations back from formatted turns in order; only digests are held, so a conversation may be of any length."""
    key, state = object(), None

    def row():
        conv, n, turns, chars, loss, size = state
        return pa.RecordBatch.from_arrays(
            [pa.array([conv], kind), *(pa.array([v], t) for v, t in ((n, pa.int64()), (turns.hexdigest(), pa.string()), (chars, pa.int64()), (loss.hexdigest(), pa.string()), (size, pa.int64())))],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    done = []
    for batch in stream:
        kind = batch.schema.field("conv_id").type
        for conv, text, loss in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
            if state is None or conv != key:
                if state is not None:
                    done.append(row())
                key, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for m in TURN.finditer(text):
                state[1] += 1
                state[2].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            for s in loss:
                learned = unescape(text[s["start"]:s["end"]])
                state[3] += len(learned)
                state[4].update(learned.encode())
            state[5] += len(text)
        if len(done) >= 1024:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
            done = []
    if state is not None:
        done.append(row())
    if done:
        yield from pa.Table.from_batches(done).combine_chunks().to_batches()


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its formatted turns in the order of turn (nulls first; ties by the formatted string)."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    dealt = formatted.repartition(spread(formatted.sparkSession, 0, 1), "conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return dealt.select("conv_id", "formatted", "loss").mapInArrow(
        _reader, f"conv_id {kind}, n_turns BIGINT, turns_sha256 STRING, loss_chars BIGINT, loss_sha256 STRING, formatted_chars BIGINT")


def assemble(formatted: DataFrame) -> DataFrame:
    """(conv_id, text, n_attachments, expanded_tokens): whole conversations as strings, for those that fit in a row."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "formatted")))
    tokens = F.aggregate("attachments", F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"])
    return formatted.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["formatted"]), "").alias("text"),
                                            F.sum(F.size("attachments")).alias("n_attachments"), F.sum(tokens).alias("expanded_tokens"))
