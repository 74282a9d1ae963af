r"""Chat formatting held by a grammar round trip.

    conversation = { turn }
    turn         = "### " role ": " text "</turn>" newline
    role, text   = { "\" control | other }        a control stands for itself after a backslash
    control      = "\" | "### " | "</turn>"       and ": " in a role

A control string that is not escaped is an error inside a text, and a backslash before anything else is plain. A turn is rendered
without escapes first and parsed again. Where the parser does not give back role and text, what conflicts is escaped:
control strings, and if that is not enough backslashes too, after which every string comes back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import slices

OPEN, COLON, CLOSE = "### ", ": ", "</turn>"
#: In a role and in a text: an escape, or a control string that stands alone.
ROLE = re.compile(r"\\(\\|### |</turn>|: )|### |</turn>|: ")
TEXT = re.compile(r"\\(\\|### |</turn>)|### |</turn>")
CONTROL = {ROLE: re.compile(r"### |</turn>|: "), TEXT: re.compile(r"### |</turn>")}
SCHEMA = "conv_id bigint, part int, text string, mask array<struct<start: bigint, end: bigint>>, n_turns bigint, escapes int"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Conflict(ValueError):
    """A string that is no conversation of the grammar."""


def unescaped(text: str, field: re.Pattern = TEXT) -> str:
    """The text that an escaped one stands for."""
    return field.sub(lambda m: m[1] or m[0], text)


def _until(text: str, at: int, field: re.Pattern, stop: str) -> int:
    """Where the field that begins at `at` ends: at the first `stop` that is not escaped."""
    for m in field.finditer(text, at):
        if m[1] is None:
            if m[0] != stop:
                raise Conflict(f"{m[0]!r} at {m.start()}")
            return m.start()
    raise Conflict(f"no {stop!r} after {at}")


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn of a formatted conversation; start to end is the text as it stands there."""
    at = 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise Conflict(f"no {OPEN!r} at {at}")
        colon = _until(text, at + len(OPEN), ROLE, COLON)
        start = colon + len(COLON)
        end = _until(text, start, TEXT, CLOSE)
        if not text.startswith("\n", end + len(CLOSE)):
            raise Conflict(f"no end of line after {end}")
        yield unescaped(text[at + len(OPEN) : colon], ROLE), unescaped(text[start:end]), start, end
        at = end + len(CLOSE) + 1


def _escaped(text: str, field: re.Pattern, level: int) -> str:
    if level > 1:
        text = text.replace("\\", "\\\\")
    return CONTROL[field].sub(r"\\\g<0>", text) if level else text


def render(role: str, text: str) -> tuple[str, int, int, int]:
    """(the turn as formatted, start and end of its text there, level of escapes): the least level that comes back."""
    for level in range(3):
        head = OPEN + _escaped(role, ROLE, level) + COLON
        body = _escaped(text, TEXT, level)
        turn = head + body + CLOSE + "\n"
        try:
            if [t[:2] for t in parse(turn)] == [(role, text)]:
                return turn, len(head), len(head) + len(body), level
        except Conflict:
            continue
    raise AssertionError("the last level always comes back")


def _formatted(learned: str, most: int):
    """Rows (conv_id, role, text), a conversation's one after the other -> parts of formatted conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        now, part, turns, mask, chars, level, out, held = none, 0, [], [], 0, 0, [], 0

        def told():
            names = ("conv_id", "part", "text", "mask", "n_turns", "escapes")
            kinds = (pa.int64(), pa.int32(), pa.string(), SPAN, pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in slices(batches, 4 << 20):
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv_id != now or chars > most:
                    if turns:
                        out.append((now, part, "".join(turns), mask, len(turns), level))
                        held += chars
                    part = part + 1 if conv_id == now else 0
                    now, turns, mask, chars, level = conv_id, [], [], 0, 0
                turn, start, end, used = render(role, text)
                if role == learned:
                    mask.append({"start": chars + start, "end": chars + end})
                turns.append(turn)
                chars += len(turn)
                level = max(level, used)
            if held > most:
                yield told()
                out, held = [], 0
        if turns:
            out.append((now, part, "".join(turns), mask, len(turns), level))
        if out:
            yield told()

    return run


def format_chats(convs: DataFrame, learned: str = "assistant", most: int = 4 << 20) -> DataFrame:
    """conv_id, part, text, mask, n_turns, escapes: the formatted conversations, in order of conv_id and part within a partition.

    Turns stand by turn (null first), equal ones by role and text; null roles and texts are empty. mask: code points (start, end) of
    the texts of role `learned`, as they stand in this row's text. escapes: 0, 1 (control strings) or 2 (backslashes too).
    A conversation of more than `most` code points is several rows, each of whole turns, so that no task holds more than that and one
    turn. Rows without a conv_id are one conversation with a null id; repeated rows are turns each; other
    columns are not read. No rows give no conversations.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = convs.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), empty("role"), empty("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_formatted(learned, most), SCHEMA)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of formatted conversations, in order -> what their text and mask say, a row a conversation."""
    none = object()
    now, out = none, []
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        for conv_id, text, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv_id != now:
                if now is not none:
                    out.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                now, n, turns, loss_chars, loss, chars = conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
            for role, said, _, _ in parse(text):
                turns.update(f"{role}\n{said}\n".encode())
                n += 1
            for span in mask:
                said = unescaped(text[span["start"] : span["end"]])
                loss.update(said.encode())
                loss_chars += len(said)
            chars += len(text)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)
            out = []
    if now is not none:
        yield pa.RecordBatch.from_arrays([pa.array([x], None if x is not None else pa.int64()) for x in (now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)], names=names)


def read_back(chats: DataFrame, in_order: bool = False) -> DataFrame:
    """conv_id, n_turns, turns_sha256 (role and text, a newline after each), loss_chars, loss_sha256 (all texts under the mask,
    unescaped), formatted_chars: what a reader finds in formatted conversations, a row for each.

    in_order: the parts stand as format_chats leaves them; else (a table that was written) they are brought together first.
    """
    if not in_order:
        chats = chats.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return chats.select("conv_id", "text", "mask").mapInArrow(_read, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def read_turns(chats: DataFrame) -> DataFrame:
    """conv_id, part, place, role, text: the turns that the parser finds in each row of formatted conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            rows = [(c, p, k, role, said) for c, p, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, (role, said, _, _) in enumerate(parse(text))]
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "part", "place", "role", "text"])

    return chats.select("conv_id", "part", "text").mapInArrow(run, "conv_id bigint, part int, place bigint, role string, text string")
