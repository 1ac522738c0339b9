r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it are its context, only
the reply is trainable.  All examples of a conversation are prefixes of one formatted
text, so the files hold each formatted turn once, with its place in that text, and an
example is the prefix that ends with its reply; ``example_texts`` writes them out.
Turns behind the last reply form a closing example without a trainable part.  A turn
is ``<s>role``, a line end, the text, ``</s>`` and a line end; control strings inside
texts get a backslash behind their first character, and backslashes are doubled.

Rows stream in order of conversation and turn, so a conversation of any length needs
the memory of one batch.

Defined results: a null text or role is empty; turns of equal number follow by role,
then text; equal rows stay; a null conversation id is a conversation; an empty table
gives no examples; columns other than the four are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountloom.llm.frames import map_arrow, row_slices

WRITE_CHARS = 1 << 22  # characters of examples in a batch
OPEN, CLOSE = "<s>", "</s>\n"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "|>")
TURNS = ("conv_id long, position long, example long, formatted string, start long, "
         "loss_start long, loss_chars long")
_CONTROL = re.compile(f"(?={'|'.join(map(re.escape, CONTROLS))}).")  # controls may overlap
EXAMPLES = "conv_id long, example long, text string, loss_start long, loss_chars long, closes boolean"
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    doubled = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: m[0] + "\\", doubled)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The formatted turn, and where its text starts in it."""
    head = OPEN + escape(role).replace("\n", "\\\n") + "\n"
    return head + escape(text) + CLOSE, len(head)


def parse_turn(formatted: str) -> tuple[str, str, int]:
    """``(role, text, start of the text)`` of a formatted turn."""
    body = formatted[len(OPEN):-len(CLOSE)]
    end = re.search(r"(?<!\\)(?:\\\\)*\n", body).end() - 1
    return unescape(body[:end]), unescape(body[end + 1:]), len(OPEN) + end + 1


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[kind]) for (_, kind), v in zip(fields, zip(*rows))],
                                      names=[name for name, _ in fields])


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv: object = _render  # no conversation yet
    position = start = example = 0
    for batch in batches:
        for part in row_slices(batch, "text"):
            out = []
            for c, role, text in zip(*(part.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
                if c != conv:
                    conv, position, start, example = c, 0, 0, 0
                formatted, at = format_turn(role, text)
                reply = role == "assistant"
                out.append((c, position, example, formatted, start,
                            at if reply else None, len(formatted) - at - len(CLOSE) if reply else None))
                position, start, example = position + 1, start + len(formatted), example + reply
            yield _batch(out, TURNS)


def _ordered(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``TURNS``: each formatted turn with the example that it ends or belongs to first.

    ``start`` is its place in the formatted conversation; ``loss_start`` and
    ``loss_chars`` mark the reply inside ``formatted``.
    """
    return map_arrow(_ordered(conversations), _render, TURNS)


def expand_conversations(conversations: DataFrame) -> DataFrame:
    """``EXAMPLES``: every example whole, in one pass over the ordered turns.

    ``loss_start`` and ``loss_chars`` mark the reply; ``closes`` the last example of a
    conversation, which holds all its turns.
    """
    return map_arrow(_ordered(conversations), lambda batches: _write_out(_render(batches)), EXAMPLES)


def _in_order(turns: DataFrame) -> DataFrame:
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "position")


def examples(turns: DataFrame) -> DataFrame:
    """One row per example: its characters and the trainable stretch, without its text."""
    return turns.groupBy("conv_id", "example").agg(
        F.max(F.col("start") + F.length("formatted")).alias("chars"),
        F.max(F.when(F.col("loss_start").isNotNull(), F.col("start") + F.col("loss_start"))).alias("loss_start"),
        F.max("loss_chars").alias("loss_chars"))


def _write_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("conv_id", "example", "formatted", "start", "loss_start", "loss_chars")
    key: object = _write_out
    prefix: list[str] = []
    last: tuple | None = None
    out: list[tuple] = []
    held = 0

    def done(closes: bool) -> None:
        nonlocal held
        c, example, start, loss_start, loss_chars = last
        text = "".join(prefix)
        held += len(text)
        out.append((c, example, text, None if loss_start is None else start + loss_start, loss_chars, closes))

    def flush() -> pa.RecordBatch:
        nonlocal held
        batch = _batch(out, EXAMPLES)
        out.clear()
        held = 0
        return batch

    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in names)):
            if last is not None and (row[0] != key or row[1] != last[1]):
                done(row[0] != key)
                if held > WRITE_CHARS:
                    yield flush()
            if row[0] != key:
                key, prefix = row[0], []
            prefix.append(row[2])
            last = (row[0], row[1], row[3], row[4], row[5])
    if last is not None:
        done(True)
        yield flush()


def example_texts(turns: DataFrame) -> DataFrame:
    """Every example written out whole from formatted turns; as ``expand_conversations`` gives them."""
    return map_arrow(_in_order(turns), _write_out, EXAMPLES)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("conv_id", "example", "formatted", "start", "loss_start", "loss_chars")
    fields = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    out: list[tuple] = []
    now: list = []

    def close() -> None:
        conv, turns, whole, chars, loss, total, _, end = now
        out.append((conv, turns, whole.hexdigest(), chars, loss.hexdigest(), total + end))

    def flush() -> pa.RecordBatch:
        columns = [pa.array(v, pa.string() if "sha256" in n else pa.int64())
                   for n, v in zip(fields, zip(*out))]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=list(fields))

    for batch in batches:
        for conv, example, formatted, start, loss_start, loss_chars in zip(
                *(batch.column(n).to_pylist() for n in names)):
            if not now or now[0] != conv:
                if now:
                    close()
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, example, 0]
            role, text, _ = parse_turn(formatted)
            if example != now[6]:  # the example before is complete: it ends where this turn starts
                now[5] += start
                now[6] = example
            now[1] += 1
            now[2].update(f"{role}\n{text}\n".encode())
            now[7] = start + len(formatted)
            if loss_start is not None:
                reply = unescape(formatted[loss_start:loss_start + loss_chars])
                now[3] += len(reply)
                now[4].update(reply.encode())
        if out:
            yield flush()
    if now:
        close()
        yield flush()


def conversation_digest(turns: DataFrame) -> DataFrame:
    """Per conversation, read from its formatted turns: turns, hash, loss and formatted characters.

    ``formatted_chars`` counts the code points of all its examples written out.
    """
    return map_arrow(_in_order(turns), _digest,
                     "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                     "formatted_chars long")


READ = ("conv_id long, example long, chars long, reply string, n_turns long, turns_sha256 string")
DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each example its length and unescaped reply, of a closing one also its turns."""
    for batch in batches:
        for part in row_slices(batch, "text"):
            out = []
            for conv, example, text, at, chars, closes in zip(
                    *(part.column(f.split()[0]).to_pylist() for f in EXAMPLES.split(", "))):
                reply = None if at is None else unescape(text[at:at + chars])
                turns, whole = None, None
                if closes:  # no text holds the end of a turn
                    found = [parse_turn(t + CLOSE) for t in text.split(CLOSE)[:-1]]
                    whole = hashlib.sha256()
                    for role, said, _ in found:
                        whole.update(f"{role}\n{said}\n".encode())
                    turns, whole = len(found), whole.hexdigest()
                out.append((conv, example, len(text), reply, turns, whole))
            if out:
                yield _batch(out, READ)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: list = []

    def row() -> tuple:
        conv, turns, whole, chars, loss, total = now
        return conv, turns, whole, chars, loss.hexdigest(), total

    for batch in batches:
        out = []
        for conv, _, chars, reply, turns, whole in zip(
                *(batch.column(f.split()[0]).to_pylist() for f in READ.split(", "))):
            if not now or now[0] != conv:
                if now:
                    out.append(row())
                now = [conv, None, None, 0, hashlib.sha256(), 0]
            if reply is not None:
                now[3] += len(reply)
                now[4].update(reply.encode())
            if turns is not None:
                now[1:3] = turns, whole
            now[5] += chars
        if out:
            yield _batch(out, DIGEST)
    if now:
        yield _batch([row()], DIGEST)


def examples_digest(examples: DataFrame) -> DataFrame:
    """``conversation_digest`` read from ``EXAMPLES``: replies under the loss mask in order, turns of the last one.

    Only lengths, digests and replies move.
    """
    read = map_arrow(examples.select(*[f.split()[0] for f in EXAMPLES.split(", ")]), _read_back, READ)
    return map_arrow(read.repartition("conv_id").sortWithinPartitions("conv_id", "example"), _add_up, DIGEST)
