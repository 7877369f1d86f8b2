r"""Chat formatting in budgeted windows of whole turns.

A turn is written as ``<s>role``, a line feed, the text and ``</s>``. Backslashes
in a role or text are doubled, and one is put into each control string in it
(``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, and a line feed in a role), so that
texts cannot end or open a turn and are read back exactly.

A turn's size is its number of tokens as written, by the vocabulary at ``path``.
Prefix sums of the sizes, searched for the budget, choose the windows: each takes
all next new turns that fit into ``budget`` besides the system turn, if the
conversation begins with one, and the latest earlier turns that fit into
``history``. History gives way first and the system turn next where one new turn
needs their room; a turn is never cut, so one that alone is over the budget stands
alone and is the only case of a window over it. Repeated turns are context: only
the texts of new assistant turns are under the loss mask, each exactly once.

A task holds one conversation's system turn, history and current window only,
so a conversation may be of any length. Order: turn, then role, then text;
nulls come first. Nulls: a null role or text is written as an empty one; rows
with a null conv_id form one conversation of their own.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe

OPEN, CLOSE, TARGET, SYSTEM = "<s>", "</s>", "assistant", "system"
_CONTROL = re.compile(r"<(?=/?s>)|\[(?=/?INST\])")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<s>((?:[^\\\n]|\\.)*)\n(.*?)</s>", re.S)


@dataclass
class Settings:
    budget: int = 512
    history: int = 128


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m.group() + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def written(role: str, text: str) -> str:
    return f"{OPEN}{escape(role).replace(chr(10), chr(92) + chr(10))}\n{escape(text)}{CLOSE}"


def turns_in(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the escaped text) of the turns of a formatted window."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(formatted)]


@dataclass
class Turn:
    role: str
    text: str  # as written, with marks
    body: int  # characters of the escaped text in it
    size: int


def turn(role: str, text: str, size: int) -> Turn:
    return Turn(role, written(role, text), len(escape(text)), size)


def windows(turns: Iterator[Turn], s: Settings) -> Iterator[tuple[str, int, list[tuple[int, int]]]]:
    """(formatted text, number of leading context turns, loss spans) of each window of one conversation."""
    held: list[Turn] = []  # the turns that a window may still need
    sums = [0]  # of the sizes of held turns before each
    system: Turn | None = None
    new, first, more = 0, True, True

    def fill(upto: int):
        nonlocal more
        while more and sums[-1] <= upto:
            got = next(turns, None)
            if got is None:
                more = False
            else:
                held.append(got)
                sums.append(sums[-1] + got.size)

    fill(0)
    if held and held[0].role == SYSTEM:
        system = held[0]
    while True:
        fill(sums[new])
        if new == len(held):
            return
        own = held[new].size
        kept = [system] if system and not first and system.size + own <= s.budget else []
        room = s.budget - own - sum(x.size for x in kept)
        start = bisect.bisect_left(sums, sums[new] - max(0, min(s.history, room)), 0, new + 1)
        left = s.budget - sum(x.size for x in kept) - (sums[new] - sums[start])
        fill(sums[new] + left)
        end = max(new + 1, bisect.bisect_right(sums, sums[new] + left) - 1)
        context = kept + held[start:new]
        out, spans, at = [], [], 0
        for i, x in enumerate(context + held[new:end]):
            if i >= len(context) and x.role == TARGET:
                spans.append((at + len(x.text) - len(CLOSE) - x.body, at + len(x.text) - len(CLOSE)))
            out.append(x.text)
            at += len(x.text)
        yield "".join(out), len(context), spans
        # what is too far back for any history goes, and the system turn, which is not repeated as history
        drop = max(bisect.bisect_left(sums, sums[end] - s.history, 0, end + 1), 1 if first and system else 0)
        held, base = held[drop:], sums[drop]
        sums = [x - base for x in sums[drop:]]
        new, first = end - drop, False


def _runs(it, columns: list[str]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """(conv_id, its rows) in the order of sorted batches; the rows of one must be used up before the next."""
    def rows():
        for batch in it:
            lists = [batch.column(c).to_pylist() for c in columns]
            yield from zip(*lists)

    source = rows()
    head = next(source, None)
    while head is not None:
        conv = head[0]

        def own():
            nonlocal head
            while head is not None and head[0] == conv:
                yield head[1:]
                head = next(source, None)

        mine = own()
        yield conv, mine
        for _ in mine:
            pass


def _emit(rows, fields: list[tuple[str, pa.DataType]], most: int = 256):
    def batch(part):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])

    part = []
    for r in rows:
        part.append(r)
        if len(part) >= most:
            yield batch(part)
            part = []
    if part:
        yield batch(part)


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def format_windows(conversations: DataFrame, path: str, settings: Settings | None = None) -> DataFrame:
    """conv_id, window, text, n_context and loss (spans of code points) of every window.

    The rows of a conversation are together and in the order of its windows.
    """
    s = settings or Settings()
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"),
        F.coalesce(conversations["role"].cast("string"), F.lit("")).alias("role"),
        F.coalesce(conversations["text"].cast("string"), F.lit("")).alias("text"),
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(it):
        codec = bpe.codec(path)

        def sized(batch: pa.RecordBatch) -> pa.RecordBatch:
            pieces = [written(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            return batch.append_column("size", pa.array(codec.counts(pieces), pa.int64()))

        def out():
            for conv, turns in _runs(map(sized, it), ["conv_id", "role", "text", "size"]):
                for i, (text, n, spans) in enumerate(windows((turn(*x) for x in turns), s)):
                    yield conv, i, text, n, [{"start": a, "end": b} for a, b in spans]

        yield from _emit(out(), [("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("n_context", pa.int32()), ("loss", _SPAN)])

    return dealt.mapInArrow(run, "conv_id long, window long, text string, n_context int, loss array<struct<start:int,end:int>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, parsed from format_windows' rows, in their order."""

    def run(it):
        def out():
            for conv, rows in _runs(it, ["conv_id", "text", "n_context", "loss"]):
                n, loss_chars, chars, turns, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for text, n_context, spans in rows:
                    for role, said, _, _ in turns_in(text)[n_context:]:
                        n += 1
                        turns.update(f"{role}\n{said}\n".encode())
                    for span in spans:
                        said = unescape(text[span["start"] : span["end"]])
                        loss_chars += len(said)
                        loss.update(said.encode())
                    chars += len(text)
                yield conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        kinds = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
        yield from _emit(out(), kinds)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
