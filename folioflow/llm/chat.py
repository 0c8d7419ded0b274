"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Turn k's span is found by
rendering the first k and the first k - 1 turns and comparing: what the longer output adds is the span.
A template whose longer output does not begin with the shorter one rewrites history, which is reported
with the first turn where it does. Within a span, the loss mask is the rendered text of an assistant's
turn: what its span has beyond the span that the same turn gets with an empty text.

``control_template`` marks turns and escapes control strings inside texts reversibly, so a text that
looks like a turn's end stays text; ``read_back`` parses its output alone back to turns.

Scale: turns stream in order of (conversation, turn) through one pass; rows of a conversation are
sorted by the shuffle, which spills, and only the current conversation is held. A template may be declared
``local``: a turn's span depends on that turn only. The first ``CHECKED`` turns of every conversation are rendered
as full prefixes all the same; later ones alone, but the full prefix is rendered again whenever the number of
turns has doubled and at the end, and must be the spans joined. If it isn't, the turns since the last such
prefix are rendered again as full prefixes, and so are all that follow; what was given out stands checked. This
costs a conversation's length a few times, not its square, and is done whatever the length. A declared template that
rewrites history between two such prefixes and restores it before the second is not found out. Other templates are
always rendered in full.

The turns and spans after the first ``CHECKED`` are held in memory up to ``HELD`` characters and in a temp file beyond;
where they lie changes no result. A template with ``pieces``, a function from an iterator of turns to the
strings that its output joins, is checked in one pass over them; one without takes its turns as a list and gives one
string, so a conversation must fit in memory.

Null texts and roles are empty. Rows with equal turn numbers keep the order (turn, role, text).
"""

from __future__ import annotations

import hashlib
import pickle
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.shared import bounded_batches

Turn = tuple[str, str]
CHECKED, HELD, BLOCK = 16, 50_000_000, 1_000_000

OPEN, CLOSE, HEAD_END = "### ", " </turn>\n", ": "
ESCAPE = "\\"
#: strings that the template uses, and its escape sign
_CONTROL = re.compile(r"\\|###|</turn>|:|\n")
_ESCAPED = re.compile(r"\\(\\|h|t|c|n)")
_TO = {"\\": "\\\\", "###": "\\h", "</turn>": "\\t", ":": "\\c", "\n": "\\n"}
_FROM = {"\\": "\\", "h": "###", "t": "</turn>", "c": ":", "n": "\n"}
#: a text needs only these escaped; a role also must not hold what ends a heading
_IN_TEXT = re.compile(r"\\|###|</turn>")


def escape(text: str, role: bool = False) -> str:
    return (_CONTROL if role else _IN_TEXT).sub(lambda m: _TO[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _FROM[m[1]], text)


def control_pieces(turns: Iterable[Turn]) -> Iterator[str]:
    return (f"{OPEN}{escape(role, True)}{HEAD_END}{escape(text)}{CLOSE}" for role, text in turns)


def control_template(turns: list[Turn]) -> str:
    return "".join(control_pieces(turns))


control_template.local = True
control_template.pieces = control_pieces


def read_back(rendered: str) -> list[Turn]:
    """The turns of ``control_template``'s output."""
    out, at = [], 0
    while at < len(rendered):
        head = rendered.index(HEAD_END, at)
        end = rendered.index(CLOSE, head)
        out.append((unescape(rendered[at + len(OPEN) : head]), unescape(rendered[head + len(HEAD_END) : end])))
        at = end + len(CLOSE)
    return out


class Rendered:
    """Spans of one conversation, fed turn by turn."""

    def __init__(self, template: Callable[[list[Turn]], str]):
        self.template, self.local = template, getattr(template, "local", False)
        self.turns: list[Turn] = []
        self.n, self.before, self.rewrites_at = 0, template([]), None

    def alone(self) -> bool:
        """Whether the next turn is rendered alone."""
        return self.local and self.n >= CHECKED and self.rewrites_at is None

    def feed(self, turn: Turn) -> tuple[str, tuple[int, int] | None]:
        """(what the turn adds, its mask inside that for an assistant)."""
        alone = self.alone()
        self.n += 1
        if alone:
            before = self.template([])
            now, bare = self.template([turn]), self.template([(turn[0], "")])
        else:
            self.turns.append(turn)
            before, now = self.before, self.template(self.turns)
            bare = self.template([*self.turns[:-1], (turn[0], "")]) if turn[0] == "assistant" else None
            self.before = now
        if not now.startswith(before):
            self.rewrites_at = self.rewrites_at or self.n
            same = next((i for i, (a, b) in enumerate(zip(before, now)) if a != b), min(len(before), len(now)))
            return now[same:], None
        span = now[len(before) :]
        if self.local and self.n <= CHECKED and self.template([turn]) != self.template([]) + span:
            self.local = False  # declared wrongly: all turns are here still, so prefixes stay whole
        if turn[0] != "assistant" or bare is None or not bare.startswith(before):
            return span, None
        empty = bare[len(before) :]
        tail = 0  # what follows the text is the shared end, as far as the shared start leaves room
        head = next((i for i, (a, b) in enumerate(zip(span, empty)) if a != b), min(len(span), len(empty)))
        while tail < len(empty) - head and span[-1 - tail] == empty[-1 - tail]:
            tail += 1
        return span, (head, len(span) - tail)


def _anchored_mask(template, turn: Turn, span: str, mask: tuple[int, int] | None) -> tuple[int, int] | None:
    """The text may begin like the template's closing: compare with two probe texts instead, which
    share no first and no last sign, to find where texts begin and how long the closing is."""
    if mask is None:
        return None
    a, b = template([(turn[0], "A")]), template([(turn[0], "BB")])
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), None)
    if head is None or len(b) != len(a) + 1 or template([turn]) != span:
        return mask
    return head, len(span) - (len(a) - head - 1)


class Output:
    """Digest of an output that comes in parts, whatever the parts are."""

    def __init__(self, parts: Iterable[str]):
        self.hash = hashlib.blake2b()
        for part in parts:
            self.add(part)

    def add(self, part: str) -> None:
        self.hash.update(part.encode("utf-8", "surrogatepass"))

    def __eq__(self, other: Output) -> bool:
        return self.hash.digest() == other.hash.digest()


class Waiting:
    """Rows of ``Turns`` in order, of which the first ``settled`` are given out: the last ones in memory, up to ``HELD``
    characters, those before in compressed blocks of a temp file."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.n, self.settled, self.chars = 0, 0, 0
        self.file, self.blocks = None, []  # of a block: rows, offset, bytes in the file, bytes

    def __enter__(self) -> Waiting:
        return self

    def __exit__(self, *_) -> None:
        if self.file is not None:
            self.file.close()

    @staticmethod
    def _size(row: tuple) -> int:
        return len(row[0][0]) + len(row[0][1]) + len(row[2])

    def append(self, row: tuple) -> None:
        self.rows.append(row)
        self.n += 1
        self.chars += self._size(row)
        if self.chars <= HELD:
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        block, size = [], 0
        for r in self.rows:
            block.append(r)
            size += self._size(r)
            if size >= BLOCK:
                self._write(block)
                block, size = [], 0
        if block:
            self._write(block)
        self.rows, self.chars = [], 0

    def _write(self, block: list[tuple]) -> None:
        raw = pickle.dumps(block, pickle.HIGHEST_PROTOCOL)
        small = pa.compress(raw, codec="zstd", asbytes=True)
        self.blocks.append((len(block), self.file.seek(0, 2), len(small), len(raw)))
        self.file.write(small)

    def between(self, first: int, stop: int) -> Iterator[tuple]:
        at = 0
        for n, offset, small, raw in self.blocks:
            if first < at + n and at < stop:
                self.file.seek(offset)
                block = pickle.loads(pa.decompress(self.file.read(small), raw, codec="zstd", asbytes=True))
                yield from block[max(first - at, 0) : stop - at]
            at += n
        yield from self.rows[max(first - at, 0) : max(stop - at, 0)]

    def open(self) -> Iterator[tuple]:
        return self.between(self.settled, self.n)

    def settle(self) -> None:
        self.settled = self.n


class Turns:
    """The turns of one conversation with what each adds to the output, in order and checked:
    (turn, n, span, mask, whether the output before was rewritten)."""

    def __init__(self, turns: Iterator[Turn], template: Callable[[list[Turn]], str]):
        self.turns, self.template, self.state = turns, template, Rendered(template)

    def __iter__(self):
        state, due, output = self.state, 2 * CHECKED, None
        with Waiting() as waiting:
            for turn in self.turns:
                alone = state.alone()
                row = self._fed(turn)
                if not alone:
                    yield row
                    continue
                output = output or Output([state.before])
                waiting.append(row)
                output.add(row[2])
                if state.n == due or state.rewrites_at is not None:
                    due *= 2
                    yield from self._settled(waiting, output)
            if waiting.settled < waiting.n:
                yield from self._settled(waiting, output)

    def _fed(self, turn: Turn) -> tuple:
        span, mask = self.state.feed(turn)
        return turn, self.state.n, span, _anchored_mask(self.template, turn, span, mask), self.state.rewrites_at == self.state.n

    def _whole(self, waiting: Waiting) -> Output:
        """The prefix of all turns up to now."""
        turns = chain(self.state.turns, (r[0] for r in waiting.between(0, waiting.n)))
        pieces = getattr(self.template, "pieces", None)
        return Output(pieces(turns) if pieces else [self.template(list(turns))])

    def _settled(self, waiting: Waiting, output: Output):
        """The rows that waited, if the prefix is what they make; else rendered again one by one. A turn that alone
        does not begin as no turns do (``rewrites_at``) speaks against the declaration too."""
        state = self.state
        if state.rewrites_at is None and self._whole(waiting) == output:
            yield from waiting.open()
            waiting.settle()
            return
        state.local, state.rewrites_at, state.n = False, None, state.n - (waiting.n - waiting.settled)
        state.turns += [r[0] for r in waiting.between(0, waiting.settled)]
        state.before = self.template(state.turns)
        for turn, *_ in waiting.open():
            yield self._fed(turn)
        waiting.settle()


def conversations(rows: Iterator[tuple], template: Callable[[list[Turn]], str]) -> Iterator[tuple[object, Turns]]:
    """Per conversation its id and its turns; one is read to its end before the next begins."""
    rows = iter(rows)
    row = next(rows, None)
    while row is not None:
        key = row[0]

        def turns():
            nonlocal row
            while row is not None and row[0] == key:
                turn = (row[1] or "", row[2] or "")
                row = next(rows, None)
                yield turn

        live = Turns(turns(), template)
        yield key, live
        for _ in live.turns:
            pass


def _rows(batches):
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            yield from zip(part.column("conv").to_pylist(), part.column("role").to_pylist(), part.column("text").to_pylist())


def ordered(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    bounded_batches(df.sparkSession)
    src = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    return src.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")


def format_chats(df: DataFrame, template: Callable[[list[Turn]], str] = control_template, **columns: str) -> DataFrame:
    """A row per turn in order: conv_id, n (from 1), span (what the turn adds to the output), mask_start
    and mask_end inside the span for assistants, rewrites (the output before it was changed)."""
    src = ordered(df, **columns)
    kind, key_type = src.schema["conv"].dataType.simpleString(), src_type(src)

    def run(batches):
        out: list[tuple] = []

        def flush():
            return pa.RecordBatch.from_pylist([dict(zip(("conv_id", "n", "span", "mask_start", "mask_end", "rewrites"), r)) for r in out], schema=pa.schema([("conv_id", key_type), ("n", pa.int64()), ("span", pa.string()), ("mask_start", pa.int64()), ("mask_end", pa.int64()), ("rewrites", pa.bool_())]))

        size = 0
        for key, turns in conversations(_rows(batches), template):
            for _, n, span, mask, rewrites in turns:
                out.append((key, n, span, *(mask or (None, None)), rewrites))
                size += len(span)
                if size > 4_000_000:
                    yield flush()
                    out.clear()
                    size = 0
        if out:
            yield flush()

    return src.mapInArrow(run, f"conv_id {kind}, n bigint, span string, mask_start bigint, mask_end bigint, rewrites boolean")


def src_type(df: DataFrame) -> pa.DataType:
    """Arrow's type of the conversations' ids, whatever it is."""
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["conv"].dataType)


def chat_digests(df: DataFrame, **columns: str) -> DataFrame:
    """Per conversation, read back from ``control_template``'s spans: n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, rewrites_history."""
    src = ordered(df, **columns)
    kind, key_type = src.schema["conv"].dataType.simpleString(), src_type(src)

    def run(batches):
        out: list[dict] = []
        schema = pa.schema([("conv_id", key_type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites_history", pa.bool_())])
        for key, turns in conversations(_rows(batches), control_template):
            every, loss, n, chars, length = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, _, span, mask, _ in turns:
                for role, text in read_back(span):
                    every.update(f"{role}\n{text}\n".encode())
                    n += 1
                if mask:
                    text = unescape(span[mask[0] : mask[1]])
                    loss.update(text.encode())
                    chars += len(text)
                length += len(span)
            out.append({"conv_id": key, "n_turns": n, "turns_sha256": every.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": length, "rewrites_history": turns.state.rewrites_at is not None})
            if len(out) >= 5_000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return src.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, rewrites_history boolean")
