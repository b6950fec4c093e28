"""Chat formatting with a grammar that is checked by reading every turn back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template (fixed values). One turn is
#   ### Role: text</turn>\n
# Control strings inside a role or a text are preceded by a backslash, and so is a backslash.
HEAD, COLON, END = "### ", ": ", "</turn>\n"
_CONTROLS = re.compile(r"\\|#(?=##)|</turn>")
_ROLE_CONTROLS = re.compile(r"\\|#(?=##)|</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:\\.|(?!###|</turn>)[^\\:])*): ((?:\\.|(?!###|</turn>)[^\\])*)</turn>\n", re.DOTALL)


def parse_turn(text: str, start: int = 0) -> tuple[str, str, int, int, int] | None:
    """The turn that begins at `start`: role, text, begin and end of the written text, end of the turn."""
    m = _TURN.match(text, start)
    if m is None:
        return None
    return _ESCAPED.sub(r"\1", m[1]), _ESCAPED.sub(r"\1", m[2]), m.start(2), m.end(2), m.end()


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """One written turn and the span of its text.

    The plain form is tried first; if reading it back does not give exactly this role
    and text, the conflicting strings are escaped.
    """
    for role_form, text_form in ((role, text), (_ROLE_CONTROLS.sub(r"\\\g<0>", role), _CONTROLS.sub(r"\\\g<0>", text))):
        piece = f"{HEAD}{role_form}{COLON}{text_form}{END}"
        read = parse_turn(piece)
        if read is not None and read[:2] == (role, text) and read[4] == len(piece):
            return piece, read[2], read[3]
    raise ValueError("a turn could not be written reversibly")


def format_turns(conversations: DataFrame) -> DataFrame:
    """Written turns: conv_id, position, piece, loss_from, loss_to (null: no loss on this turn).

    `conversations(conv_id, turn, role, text)`: the rows of a conversation in order of
    turn; ties go by role, then text; null turns come first. Null roles and texts are
    written as empty ones; rows of a null conv_id form one conversation; repeated rows are
    repeated turns; an empty table gives an empty table; further columns are left out.
    The pieces of a conversation, in order of position, are its formatted text. The loss
    mask covers the written text of assistant turns. A long conversation streams through
    its task turn by turn and is never held whole.
    """
    clean = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                                 F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, position = object(), 0
        for batch in batches:
            ids = batch.column("conv_id")
            places, pieces, begins, ends = [], [], [], []
            for conv, role, text in zip(ids.to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                position = position + 1 if conv == current else 0
                current = conv
                piece, begin, end = render_turn(role, text)
                masked = role == "assistant"
                places.append(position)
                pieces.append(piece)
                begins.append(begin if masked else None)
                ends.append(end if masked else None)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(places, pa.int64()), pa.array(pieces, pa.string()), pa.array(begins, pa.int64()),
                 pa.array(ends, pa.int64())], names=["conv_id", "position", "piece", "loss_from", "loss_to"])

    kind = clean.schema["conv_id"].dataType.simpleString()
    return order.mapInArrow(write, f"conv_id {kind}, position long, piece string, loss_from long, loss_to long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, taken from the written pieces alone.

    conv_id, n_turns, turns_sha256 (over role, newline, text, newline of each turn),
    loss_chars and loss_sha256 (over the unescaped text under the loss mask, in order),
    formatted_chars. A piece that the parser refuses raises an error.
    """
    order = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "position")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done, kind = None, [], None

        def close() -> None:
            if state is not None:
                conv, n, turns, chars, loss, length = state
                done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), length))

        def rows() -> pa.RecordBatch:
            kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=[
                "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            done.clear()
            return out

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss_from", "loss_to")]
            for conv, piece, begin, end in zip(*columns):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                read = parse_turn(piece)
                if read is None or read[4] != len(piece):
                    raise ValueError(f"conversation {conv} cannot be read back")
                state[1] += 1
                state[2].update(f"{read[0]}\n{read[1]}\n".encode())
                if begin is not None:
                    masked = _ESCAPED.sub(r"\1", piece[begin:end])
                    state[3] += len(masked)
                    state[4].update(masked.encode())
                state[5] += len(piece)
            if done:
                yield rows()
        close()
        if done:
            yield rows()

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return order.mapInArrow(digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                    "formatted_chars long")
