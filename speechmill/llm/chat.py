"""Prefix-target expansion of conversations.

Every assistant turn becomes an example of its own: all turns before it are context, and only its
reply is trainable. Texts are escaped, so that no text can look like a mark of the template, and the
escapes are taken back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TARGET = "assistant"
EXAMPLES = "conv_id long, example long, turns long, is_last boolean, text string, loss_start long, loss_end long"
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def escaped(text: str) -> str:
    """No ``<|`` is left; a backslash marks what was changed."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escaped_role(role: str) -> str:
    """As for texts, and on one line."""
    return escaped(role).replace("\n", "\\n")


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def formatted(role: str, text: str) -> tuple[str, str, str]:
    """What stands before a turn's text, the text, and what stands after."""
    return f"{START}{escaped_role(role)}\n", escaped(text), f"{END}\n"


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns of an example, unescaped."""
    return [(unescaped_role(m[1]), unescaped(m[2])) for m in _TURN.finditer(text)]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _write(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in EXAMPLES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def expanded(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Examples of all conversations: ``conv_id, example, turns, is_last, text, loss_start, loss_end``.

    ``text`` holds the whole context and the reply, the loss mask is a range of its code points
    (the reply's escaped text). Turns after the last reply, or a conversation without one, make a last
    example without loss. Turns are ordered by turn, then role and text, nulls first; null role and text
    count as empty, equal rows are turns each, and a null conv_id is a conversation like any other.

    Conversations are streamed in order from a sort that spills; a task holds one context at a time.
    """
    size = 4 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, current, context, turns, example, waiting = [], 0, object(), "", 0, 0, None

        def closed() -> Iterator[tuple]:
            """The last example of the conversation that ends here."""
            if waiting is not None and waiting[2] == turns:
                yield (*waiting[:3], True, *waiting[4:])
            elif turns:
                if waiting is not None:
                    yield waiting
                yield (current, example, turns, True, context, None, None)

        for key, who, what in _rows(batches):
            if key != current:
                out += closed()
                current, context, turns, example, waiting = key, "", 0, 0, None
            before, body, after = formatted(who, what)
            at = len(context) + len(before)
            context += before + body + after
            turns += 1
            if who == TARGET:
                if waiting is not None:
                    out.append(waiting)
                    held += len(waiting[4])
                waiting = (current, example, turns, False, context, at, at + len(body))
                example += 1
            if held >= size or len(out) >= 5_000:
                yield _write(out)
                out, held = [], 0
        out += closed()
        if out:
            yield _write(out)

    rows = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, EXAMPLES)


def digests(examples: DataFrame) -> DataFrame:
    """What a conversation's examples say, read back from their texts and masks alone.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``. Examples are streamed
    in order, so a conversation is hashed without being gathered.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _digested(batches):
            columns = list(zip(*batch, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    ordered = examples.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return ordered.select("conv_id", "is_last", "text", "loss_start", "loss_end").mapInArrow(run, schema)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    loss, chars, total, out = hashlib.sha256(), 0, 0, []
    for key, is_last, text, start, end in _rows(batches):
        total += len(text)
        if start is not None:
            reply = unescaped(text[start:end])
            loss.update(reply.encode("utf-8", "surrogatepass"))
            chars += len(reply)
        if is_last:
            turns = hashlib.sha256()
            found = parsed(text)
            for role, body in found:
                turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
            out.append((key, len(found), turns.hexdigest(), chars, loss.hexdigest(), total))
            loss, chars, total = hashlib.sha256(), 0, 0
        if len(out) >= 5_000:
            yield out
            out = []
    if out:
        yield out
