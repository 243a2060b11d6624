"""Chat formatting: typed content parts are flattened by a visitor, turns are marked, control strings are escaped."""

from __future__ import annotations

import hashlib
import json
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import partitions

OPEN, MIDDLE, CLOSE = "<|turn|>", "<|says|>", "<|end|>\n"
#: Strings that never occur in the output's texts: all marks begin with "<|"; the rest are marks of other templates.
_CONTROL = re.compile(r"(<)(\\*)(\||/?s>)|(\[)(\\*)(/?INST\])")
_ESCAPED = re.compile(r"(<)\\(\\*)(\||/?s>)|(\[)\\(\\*)(/?INST\])")
_TURN = re.compile(r"<\|turn\|>(.*?)<\|says\|>(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    """Put a backslash after the first character of each control string; more where there are some already."""
    return _CONTROL.sub(lambda m: f"{m[1]}\\{m[2]}{m[3]}" if m[1] else f"{m[4]}\\{m[5]}{m[6]}", text)


def unescape(text: str) -> str:
    """The inverse of escape()."""
    return _ESCAPED.sub(lambda m: f"{m[1]}{m[2]}{m[3]}" if m[1] else f"{m[4]}{m[5]}{m[6]}", text)


@dataclass
class Costs:
    """Tokens that an attachment stands for."""

    patch: int = 28  # pixels of an image patch's side
    image_default: int = 256
    audio_per_second: int = 25
    page: int = 512


#: Numbers beyond it are no sizes of attachments.
MOST = 10**6


def number(x) -> float | None:
    """A size that a part states; None where it is no number from 0 to MOST."""
    try:
        value = float(x)
    except (TypeError, ValueError, OverflowError):
        return None
    return value if 0 <= value <= MOST else None


def encodable(text: str) -> str:
    """Halves of surrogate pairs, which JSON can escape alone, become U+FFFD."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def parts_of(text: str) -> list | str:
    """The parts that a text states as JSON: an array, a string or one part; other text is a text part as it stands."""
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return text
    return found if isinstance(found, list | str) else [found] if isinstance(found, dict) else text


@dataclass
class PartVisitor:
    """Flattens typed parts to text with placeholders in order; keeps what they refer to and their token counts."""

    costs: Costs = field(default_factory=Costs)
    out: list[str] = field(default_factory=list)  # escaped
    texts: list[str] = field(default_factory=list)  # not yet in out: adjacent texts are escaped as one
    refs: list[tuple[str, str, int]] = field(default_factory=list)

    def visit(self, part) -> None:
        if isinstance(part, str):
            return self.visit_text({"text": part})
        kind = part.get("type", "text") if isinstance(part, dict) else "unknown"
        known = {"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}
        return known.get(kind if isinstance(kind, str) else "", self.visit_unknown)(part)

    def visit_text(self, part) -> None:
        self.texts.append(encodable(str(part.get("text") or "")))

    def _flush(self) -> None:
        if self.texts:
            self.out.append(escape("".join(self.texts)))
            self.texts = []

    def flattened(self) -> str:
        """All parts so far, in order."""
        self._flush()
        return "".join(self.out)

    def _attach(self, kind: str, part, tokens: int) -> None:
        ref = part.get("url") or part.get("path") or part.get("id") or ""
        self._flush()
        self.out.append(f"<|{kind}:{len(self.refs)}|>")
        self.refs.append((kind, encodable(str(ref)), tokens))

    def visit_image(self, part) -> None:
        w, h, p = number(part.get("width")), number(part.get("height")), self.costs.patch
        self._attach("image", part, math.ceil(w / p) * math.ceil(h / p) if w and h else self.costs.image_default)

    def visit_audio(self, part) -> None:
        self._attach("audio", part, int((number(part.get("seconds")) or 0) * self.costs.audio_per_second))

    def visit_document(self, part) -> None:
        self._attach("document", part, int(number(part.get("pages")) or 1) * self.costs.page)

    def visit_unknown(self, part) -> None:
        self.texts.append(encodable(json.dumps(part, ensure_ascii=False, sort_keys=True)))


def format_turn(role: str, content, costs: Costs | None = None) -> tuple[str, list[tuple[str, str, int]], list[int]]:
    """(formatted turn, attachments as (kind, reference, tokens), start and end of the content in it)."""
    visitor = PartVisitor(costs or Costs())
    for part in content if isinstance(content, list) else [content or ""]:
        visitor.visit(part)
    head, body = f"{OPEN}{escape(role)}{MIDDLE}", visitor.flattened()
    return f"{head}{body}{CLOSE}", visitor.refs, [len(head), len(head) + len(body)]


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of formatted text, unescaped; placeholders stay in the text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


_FORMATTED = "conv_id long, turn long, formatted string, loss boolean, content_start int, content_end int, attachments array<struct<kind:string,ref:string,tokens:bigint>>, attachment_tokens long"
_TYPES = pa.schema([
    ("conv_id", pa.int64()), ("turn", pa.int64()), ("formatted", pa.string()), ("loss", pa.bool_()), ("content_start", pa.int32()), ("content_end", pa.int32()),
    ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))), ("attachment_tokens", pa.int64()),
])


def _format(typed: bool):
    def run(batches):
        for batch in batches:
            rows = []
            for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                content = parts_of(text) if typed and text else text
                out, refs, (a, z) = format_turn(role or "", content)
                rows.append({"conv_id": conv, "turn": turn, "formatted": out, "loss": role == "assistant", "content_start": a, "content_end": z, "attachments": [dict(zip(("kind", "ref", "tokens"), r, strict=True)) for r in refs], "attachment_tokens": sum(r[2] for r in refs)})
            yield pa.RecordBatch.from_pylist(rows, schema=_TYPES)

    return run


def format_turns(turns: DataFrame, typed: bool = False) -> DataFrame:
    """Format each row (conv_id, turn, role, text) by itself, without a shuffle: a conversation is its turns' strings in order.

    typed: text is a JSON array of parts, as {"type": "text", "text": ...}, {"type": "image", "url", "width", "height"},
    {"type": "audio", "url", "seconds"}, {"type": "document", "url", "pages"}; otherwise it is one text part. Text that is
    no such JSON is a text part as it stands, a part of unknown type is the text of its JSON, and a size that is no number
    from 0 to a million counts as not stated. The loss
    mask is [content_start, content_end) of turns with loss (role assistant), in code points of the formatted string.
    Null text and null role count as empty. Turns of equal number are all kept; an empty table gives an empty result;
    other columns are ignored.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.mapInArrow(_format(typed), _FORMATTED)


def _digest(batches):
    key, state = None, None
    empty = lambda: [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    line = lambda: (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
    for batch in batches:
        out = []
        for conv, formatted, loss, a, z in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss", "content_start", "content_end")), strict=True):
            if state is None or conv != key:
                if state is not None:
                    out.append(line())
                key, state = conv, empty()
            for role, text in read_turns(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            if loss:
                text = unescape(formatted[a:z])
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(formatted)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(6)], names=names)
    if state is not None:
        r = line()
        yield pa.RecordBatch.from_arrays([pa.array([r[k]], kinds[k]) for k in range(6)], names=names)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Read back each conversation from its formatted turns: counts and digests, in a stream of sorted turns, so that memory does not grow with a conversation.

    Turns go by number (null first); turns of equal number by their formatted text, repeated rows count each. The rows of
    a null conv_id are one conversation. An empty table gives an empty result. A conversation is read by one task, as its
    digests run over its turns in order; the rows stream through it, sorted by Spark, which spills.
    """
    dealt = formatted.select("conv_id", "turn", "formatted", "loss", "content_start", "content_end").repartition(partitions(formatted.sparkSession), "conv_id")
    return dealt.sortWithinPartitions("conv_id", "turn", "formatted").mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
