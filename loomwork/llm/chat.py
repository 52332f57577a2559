"""Chat formatting of conversations with typed content parts.

A turn's content is an ordered list of parts: text, image, audio or document. A
visitor flattens them into one string in which every part that isn't text is a
placeholder, and records the attachment each placeholder stands for and the
number of tokens it expands to. Turns are then wrapped in

    <|im_start|>ROLE\\nBODY<|im_end|>\\n

Control strings inside texts and roles are escaped reversibly: a ``<`` followed
by any number of backslashes and a ``|`` gets one more backslash, so a body
never holds ``<|``. The loss mask covers each assistant text and nothing else.

Defined results: turns are ordered by turn, role, then text, nulls first;
repeated rows stay repeated; a null text is an empty text, a null role an empty
role; null ids form one conversation; an unknown kind of part raises; further
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_TO_ESCAPE, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)

#: Tokens that an attachment stands for where its part doesn't say.
DEFAULT_TOKENS = {"image": 576, "audio": 1500, "document": 2048}


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(r"<\1\\|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass
class Flat:
    """One turn's body: escaped text with placeholders, attachments in order, expanded tokens."""

    pieces: list[str] = field(default_factory=list)
    attachments: list[tuple[str, str, int]] = field(default_factory=list)
    expanded: int = 0

    @property
    def body(self) -> str:
        return "".join(self.pieces)


class PartVisitor:
    """Visits parts in order. Neighbouring texts are joined before they are escaped."""

    def __init__(self):
        self.flat, self.texts, self.placeholders = Flat(), [], []

    def visit(self, part: dict) -> None:
        kind = part.get("type")
        if kind == "text":
            self.texts.append(part.get("text") or "")
        elif kind in DEFAULT_TOKENS:
            self._flush()
            count = int(part["tokens"]) if part.get("tokens") is not None else DEFAULT_TOKENS[kind]
            self.flat.pieces.append(f"<|{kind}_{len(self.flat.attachments)}|>")
            self.flat.attachments.append((kind, str(part.get("ref") or ""), count))
            self.flat.expanded += count
        else:
            raise ValueError(f"unknown kind of content part: {kind!r}")

    def _flush(self) -> None:
        if self.texts:
            self.flat.pieces.append(escape("".join(self.texts)))
            self.texts = []

    def done(self) -> Flat:
        self._flush()
        return self.flat


def flatten(parts: list[dict]) -> Flat:
    visitor = PartVisitor()
    for part in parts:
        visitor.visit(part)
    return visitor.done()


_PLACEHOLDER = re.compile(r"<\|(image|audio|document)_\d+\|>")


def text_of(body: str) -> str:
    """The texts of a body, unescaped, without its placeholders."""
    return "".join(unescape(x) for i, x in enumerate(_PLACEHOLDER.split(body)) if i % 2 == 0)


FORMATTED = (
    "conv_id long, formatted string, loss array<struct<start:long,end:long>>, "
    "attachments array<struct<kind:string,ref:string,tokens:long>>, expanded_tokens long, n_turns long"
)


def format_conversations(turns: DataFrame, *, parts: str | None = None, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: formatted text, loss spans in code points, attachments, expanded tokens.

    ``parts`` names a column with JSON lists of typed parts; where it is null or
    not given, the turn is its ``text``. Conversations are spread by id, sorted
    on disk if need be, and streamed turn by turn; only the conversation being
    written is held.
    """
    content = F.col(parts) if parts else F.lit(None).cast("string")
    rows = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"), content.alias("parts"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text", "parts")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def ended(conv, held) -> tuple:
            text, at, loss, attachments, expanded = [], 0, [], [], 0
            for role, plain, content in held:
                flat = flatten(json.loads(content) if content is not None else [{"type": "text", "text": plain}])
                head, body = f"{START}{escape_role(role)}\n", flat.body
                if role == loss_role:
                    # placeholders are no part of the text to learn
                    inner = at + len(head)
                    spans, last = [], 0
                    for m in _PLACEHOLDER.finditer(body):
                        spans.append((last, m.start()))
                        last = m.end()
                    loss += [{"start": inner + a, "end": inner + b} for a, b in [*spans, (last, len(body))] if b > a]
                attachments += [{"kind": k, "ref": r, "tokens": n} for k, r, n in flat.attachments]
                expanded += flat.expanded
                whole = f"{head}{body}{END}\n"
                text.append(whole)
                at += len(whole)
            return conv, "".join(text), loss, attachments, expanded, len(held)

        kinds = [
            pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
            pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])), pa.int64(), pa.int64(),
        ]
        names = ["conv_id", "formatted", "loss", "attachments", "expanded_tokens", "n_turns"]

        def out(done: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

        conv, held, done, size = None, [], [], 0
        for batch in batches:
            ids, roles, texts, contents = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            for row in zip(ids, roles, texts, contents, strict=True):
                if held and row[0] != conv:
                    done.append(ended(conv, held))
                    held, size = [], size + len(done[-1][1])
                    if size > 4 << 20:
                        yield out(done)
                        done, size = [], 0
                conv = row[0]
                held.append(row[1:])
        if held:
            done.append(ended(conv, held))
        if done:
            yield out(done)

    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, FORMATTED)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, body) of every turn of a formatted conversation; bodies stay escaped."""
    found, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        found.append((unescape_role(m[1]), m[2]))
        at = m.end()
    return found


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns, and all text under the loss mask."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for batch in batches:
            rows = []
            for conv, text, loss in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                turns = read_back(text)
                said = "".join(f"{role}\n{text_of(body)}\n" for role, body in turns)
                learnt = "".join(unescape(text[x["start"] : x["end"]]) for x in loss)
                sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                rows.append((conv, len(turns), sha(said), len(learnt), sha(learnt), len(text)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in DIGESTS.split(", ")])

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, DIGESTS)
