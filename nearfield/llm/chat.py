"""Chat formatting with a grammar round trip.

Every turn is rendered between the marks of its role. The grammar is regular
and deterministic: a turn begins with exactly one of the opening marks and ends
at the first closing mark of that role. Before a turn is kept, it is parsed
again and compared with its source; content that conflicts with the grammar (a
mark, or something that looks like an escaped mark) is escaped by one backslash
behind the mark's first character. Escaping is a bijection, so what is read
back is the source: one pass makes source and parse identical, which is checked
for every turn.

Rows are streamed in order of (conversation, turn, role, text). A conversation
comes out as chunks of whole turns of about `chunk_chars` characters, and what
is finished goes on when it comes to as much, so memory holds about one chunk
and one slice of rows, however long a conversation is; a very long turn is a
chunk of its own. The digests of a conversation are chains over its turns, so a
conversation is one task's, which streams it; different ones share nothing.

Defined results: a null role or text is an empty one; rows with equal turns
follow in order of role and text; repeated rows are turns each; a null
conversation id is a conversation of its own; without rows there are no chunks
and no conversations. Only conv_id, turn, role and text are read, so other
columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, functions as F, types as T

from .batches import slices

#: The marks of this template.
MARKS = {
    "system": ("<<SYS>>\n", "\n<</SYS>>\n"),
    "user": ("[INST] ", " [/INST]"),
    "assistant": ("<s>", "</s>"),
}
OTHER = ("<<ROLE ", ">>\n", "\n<</ROLE>>\n")
#: A mark inside a text: its first character, backslashes from escaping, and what must follow.
_MARK = re.compile(r"([\[<])(\\*)(?=/?INST\]|/?s>|</?SYS>>|</?ROLE)")


def escape(text: str) -> str:
    return _MARK.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _MARK.sub(lambda m: m[1] + m[2][1:], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as it stands between its marks, and where its text begins and ends."""
    if role in MARKS:
        begin, end = MARKS[role]
    else:
        begin, end = f"{OTHER[0]}{quote(role, safe='')}{OTHER[1]}", OTHER[2]
    return begin + text + end, len(begin), len(begin) + len(text)


def parse(rendered: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text as it stands, its start, its end) of each turn; ValueError if the grammar doesn't hold."""
    at = 0
    while at < len(rendered):
        for role, (begin, end) in MARKS.items():
            if rendered.startswith(begin, at):
                at += len(begin)
                break
        else:
            if not rendered.startswith(OTHER[0], at):
                raise ValueError(f"no turn begins at {at}")
            to = rendered.find(OTHER[1], at)
            if to < 0:
                raise ValueError(f"the role at {at} has no end")
            role, end = unquote(rendered[at + len(OTHER[0]) : to]), OTHER[2]
            at = to + len(OTHER[1])
        to = rendered.find(end, at)
        if to < 0:
            raise ValueError(f"the turn at {at} has no end")
        yield role, rendered[at:to], at, to
        at = to + len(end)


def recovered(rendered: str) -> list[tuple[str, str]] | None:
    """The turns that the grammar finds, unescaped; None if it doesn't hold."""
    try:
        return [(r, unescape(t)) for r, t, _, _ in parse(rendered)]
    except ValueError:
        return None


def render_safely(role: str, text: str) -> tuple[str, int, int]:
    """render(), with every control string inside the text escaped, and the source recovered by the grammar.

    Escaping changes every conflict at once and unescape() is its inverse, so
    one pass makes source and parse identical; each turn is checked for it.
    """
    out = render(role, escape(text))
    if recovered(out[0]) != [(role, text)]:
        raise ValueError(f"a turn of role {role!r} can't be told from its marks")
    return out


FORMATTED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("chunk", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("loss_spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)
READ_BACK = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
    ]
)


def _emit(rows: list[tuple], schema: T.StructType):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.field(i).type) for i in range(len(kinds))], schema=kinds)


def format_conversations(conversations: DataFrame, *, loss_roles: tuple[str, ...] = ("assistant",), chunk_chars: int = 1 << 20) -> DataFrame:
    """FORMATTED: chunks of each conversation; loss_spans are [start, end) in the chunk's text."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ordered = rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        out, held, key, number, parts, size, spans, begun = [], 0, None, 0, [], 0, [], False
        for b in slices(batches):
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if begun and (conv != key or size >= chunk_chars):
                    out.append((key, number, "".join(parts), spans))
                    held += size
                    number, parts, size, spans = number + 1, [], 0, []
                    if held >= chunk_chars or len(out) >= 4096:
                        yield _emit(out, FORMATTED)
                        out, held = [], 0
                if not begun or conv != key:
                    key, number, begun = conv, 0, True
                piece, start, end = render_safely(role, text)
                if role in loss_roles:
                    spans.append([size + start, size + end])
                parts.append(piece)
                size += len(piece)
        if begun:
            out.append((key, number, "".join(parts), spans))
        if out:
            yield _emit(out, FORMATTED)

    return ordered.mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """READ_BACK: digests of each conversation as its formatted text says it, parsed by the grammar."""
    ordered = formatted.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "chunk")

    class State:
        def __init__(self, key):
            self.key, self.turns, self.loss_chars, self.chars = key, 0, 0, 0
            self.all, self.loss = hashlib.sha256(), hashlib.sha256()

        def row(self):
            return self.key, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars

    def run(batches):
        out, now = [], None
        for b in slices(batches, 256):
            for conv, text, spans in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if now is None or conv != now.key:
                    if now is not None:
                        out.append(now.row())
                    now = State(conv)
                now.chars += len(text)
                for role, body, _, _ in parse(text):
                    now.turns += 1
                    now.all.update(f"{role}\n{unescape(body)}\n".encode())
                for s, e in spans:
                    said = unescape(text[s:e])
                    now.loss_chars += len(said)
                    now.loss.update(said.encode())
            if len(out) >= 1024:
                yield _emit(out, READ_BACK)
                out = []
        if now is not None:
            out.append(now.row())
        if out:
            yield _emit(out, READ_BACK)

    return ordered.mapInArrow(run, READ_BACK)
