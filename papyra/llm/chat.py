"""Chat formatting with typed content parts.

A turn's content is a list of parts (text, image, audio, document). A visitor goes over the parts
in order: text is escaped and kept, every other part becomes an ordered placeholder such as
``<image:0>`` and is recorded as an attachment (turn, number, type, reference, expanded tokens).

A turn is written as ``<s>role\\ntext</s>\\n``. Control strings inside texts and roles get one escape
sign after their first sign, and ones that are escaped already get one more, so that the escape can
be undone exactly and no text can open or close a turn. Only assistant texts are under the loss mask.

Formatting is a map over rows. A conversation is put together from the formatted segments of its
turns, sorted by turn within one task that reads them as a stream and keeps only running sums, so
a conversation of any length needs bounded memory. Its hash is a chain over its turns, which is
why the turns of one conversation pass through one task.

Defined results: a null text or role is empty; turns with the same number are ordered by role, then by
text (its UTF-8 bytes, before it is escaped); a null turn comes first, a null conversation id is a
conversation of its own. Repeated rows are turns each. A part of an unknown type is an attachment of that
type with the placeholder ``<other:n>`` and no tokens. A text of any length is one turn. Other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm.common import map_rows
from papyra.session import prepare

OPEN, CLOSE = "<s>", "</s>"
ESCAPE = "\\"
#: Strings that mean something to templates in use; the first sign, then the rest.
CONTROL = re.compile(
    r"(<|\[)(\\*)(/?s>|/?INST\]|</?SYS>>|\|[a-z_]{1,24}\|>|(?:image|audio|document|other):[0-9]+>)"
)
_ESCAPED = re.compile(
    r"(<|\[)\\(\\*)(/?s>|/?INST\]|</?SYS>>|\|[a-z_]{1,24}\|>|(?:image|audio|document|other):[0-9]+>)"
)

#: Tokens that a part stands for: fixed for an image tile, by second of audio, by page of a document.
TOKENS = {"image": 256, "audio": 25, "document": 512}

PART = T.StructType(
    [
        T.StructField("type", T.StringType()), T.StructField("text", T.StringType()),
        T.StructField("ref", T.StringType()), T.StructField("units", T.LongType()),
    ]
)
ATTACHMENT = T.StructType(
    [
        T.StructField("number", T.LongType()), T.StructField("type", T.StringType()),
        T.StructField("ref", T.StringType()), T.StructField("tokens", T.LongType()),
    ]
)


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    """A role is one line: line feeds and escape signs are written out as well."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass
class Flattener:
    """Visits parts in order and collects the text, the attachments and the expanded tokens."""

    out: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    tokens: int = 0

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        visit = {"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}
        visit.get(kind, self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.text.append(part.get("text") or "")

    def body(self) -> str:
        self._flush()
        return "".join(self.out)

    def _flush(self) -> None:
        """Texts that follow each other are escaped together: a control string may lie across them."""
        self.out.append(escape("".join(self.text)))
        self.text.clear()

    def visit_image(self, part: dict) -> None:
        self._attach("image", part)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part)

    def visit_unknown(self, part: dict) -> None:
        self._attach(part["type"], part)

    def _attach(self, kind: str, part: dict) -> None:
        self._flush()
        number, tokens = len(self.attachments), TOKENS.get(kind, 0) * max(1, part.get("units") or 1)
        self.out.append(f"<{kind if kind in TOKENS else 'other'}:{number}>")
        self.attachments.append({"number": number, "type": kind, "ref": part.get("ref"), "tokens": tokens})
        self.tokens += tokens


def format_turn(role: str | None, parts: list[dict] | None) -> tuple[str, int, int, list[dict], int]:
    """``(segment, loss_start, loss_end, attachments, expanded tokens)``; no loss: an empty span."""
    role, visitor = role or "", Flattener()
    for p in parts or []:
        if p is not None:
            visitor.visit(p)
    head, body = f"{OPEN}{escape_role(role)}\n", visitor.body()
    at = len(head)
    end = at + len(body) if role == "assistant" else at
    return f"{head}{body}{CLOSE}\n", at, end, visitor.attachments, visitor.tokens


def read_turn(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn; placeholders stay as they are."""
    if not segment.startswith(OPEN) or not segment.endswith(f"{CLOSE}\n"):
        raise ValueError("not a formatted turn")
    role, _, body = segment[len(OPEN) : -len(CLOSE) - 1].partition("\n")
    return unescape_role(role), unescape(body)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation: only the template can hold an unescaped close."""
    return [read_turn(s + f"{CLOSE}\n") for s in formatted.split(f"{CLOSE}\n")[:-1]]


def _formatter():
    def fn(roles, contents):
        made = [format_turn(r, p) for r, p in zip(roles, contents, strict=True)]
        return tuple(map(list, zip(*made, strict=True))) if made else ([],) * 5

    return fn


def text_part(text: Column) -> Column:
    """A plain text as a list of one part."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"), F.coalesce(text.cast("string"), F.lit("")).alias("text"),
            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"),
        )
    )


def format_turns(
    turns: DataFrame, content: Column | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``conv_id, turn, segment, loss_start, loss_end, attachments, n_expanded`` of every row.

    ``content`` is a column of ``PART`` lists; without it the text column is one text part.
    """
    out = T.StructType(
        [
            T.StructField("segment", T.StringType()), T.StructField("loss_start", T.LongType()),
            T.StructField("loss_end", T.LongType()), T.StructField("attachments", T.ArrayType(ATTACHMENT)),
            T.StructField("n_expanded", T.LongType()),
        ]
    )
    parts = text_part(F.col(f"`{text_col}`")) if content is None else content
    rows = turns.select(
        F.col(f"`{id_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
        F.col(f"`{role_col}`").cast("string").alias("__role"), parts.alias("__parts"),
    )
    return map_rows(rows, [F.col("__role"), F.col("__parts")], out, _formatter, keep=["conv_id", "turn"])


DIGEST = T.StructType(
    [
        T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()), T.StructField("n_attachments", T.LongType()),
        T.StructField("n_expanded", T.LongType()),
    ]
)


class _Sums:
    """What is known of a conversation so far, read back from its segments."""

    def __init__(self):
        self.n = self.loss = self.chars = self.attachments = self.expanded = 0
        self.turns, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, segment, start, end, n_attachments, expanded):
        role, text = read_turn(segment)
        self.n += 1
        self.chars += len(segment)
        self.turns.update(f"{role}\n{text}\n".encode())
        masked = unescape(segment[start:end])
        self.loss += len(masked)
        self.masked.update(masked.encode())
        self.attachments += n_attachments
        self.expanded += expanded

    def row(self):
        return (self.n, self.turns.hexdigest(), self.loss, self.masked.hexdigest(), self.chars, self.attachments, self.expanded)


def digest_conversations(segments: DataFrame) -> DataFrame:
    """``conv_id`` and ``DIGEST`` of every conversation, read back from formatted segments."""
    prepare(segments.sparkSession)
    id_type = segments.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", id_type), *DIGEST])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        at, sums, ready = None, None, []

        def flush():
            cols = list(zip(*ready, strict=True))
            ready.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow
            )

        for b in batches:
            cols = [b.column(n).to_pylist() for n in ("conv_id", "segment", "loss_start", "loss_end", "n_att", "n_expanded")]
            for conv, *rest in zip(*cols, strict=True):
                if sums is None or conv != at:
                    if sums is not None:
                        ready.append((at, *sums.row()))
                    at, sums = conv, _Sums()
                sums.add(*rest)
            if len(ready) >= 5000:
                yield flush()
        if sums is not None:
            ready.append((at, *sums.row()))
        if ready:
            yield flush()

    thin = segments.select(
        "conv_id", "turn", "segment", "loss_start", "loss_end", F.size("attachments").cast("long").alias("n_att"), "n_expanded"
    )
    rows = thin.repartition("conv_id").select("*", *_order(F.col("segment")))
    return rows.sortWithinPartitions("conv_id", "turn", "__role", "__body").mapInArrow(run, schema)


def _order(segment: Column) -> list[Column]:
    """Role and text of a segment as they were, to order turns of one number by."""
    head = F.instr(segment, "\n")
    role = F.substring(segment, F.lit(len(OPEN) + 1), head - F.lit(len(OPEN) + 1))
    body = F.substring(segment, head + 1, F.length(segment) - head - F.lit(len(CLOSE) + 1))
    plain = lambda c: F.when(F.contains(c, F.lit(ESCAPE)), F.regexp_replace(c, _ESCAPED.pattern, "$1$2$3")).otherwise(c)
    # What ``escape_role`` wrote out is undone in the same order: line feeds are marked so that "\\n" stays apart from "\n".
    parts = F.split(plain(role), r"\\\\", -1)
    unfed = F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return [F.array_join(unfed, "\\").alias("__role"), plain(body).alias("__body")]
