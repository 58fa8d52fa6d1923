"""Conversation structure repair: rows stream past by turn while a small table of best repairs is carried on.

Rows of a conversation meet in one task, sorted by turn. After each of them the
cheapest way to repair what has passed is known for each of four states: nothing
said yet, or the last role is that of a system, user or assistant row. What is
carried from batch to batch is only how much more each state costs than the
cheapest and the order of their edits; there are few such tables, so the step
from one to the next is remembered. One byte for each state says where its best
edit came from; the end of the conversation is traced back from there. Rows and
bytes of a conversation that is held beyond ``HELD_BYTES`` go to a file of the
task's own, as do the digests of what was said beyond ``RECENT``, so a giant
conversation needs disk, not memory.

Edits of a row: Keep costs 0, Rerole (to user or assistant) 1, Delete 2, each
but the last 5 more for a truncated row; Insert, of an empty user or assistant
row anywhere, costs 5. Blank and duplicate rows are deleted. Roles that remain
read ``(s?(ua)+)?`` by their initials. Of the cheapest repairs the one whose
edits' initials come first is taken; initials and rows determine it.

Defined cases: a null role or text counts as one space; null turns come first;
rows of one turn are taken in the order of role and text. A null ``conv_id`` is
a conversation of its own. Repeated rows are duplicates like others. A
conversation whose rows are all marked as not ``present`` has an empty repair.
An empty table gives no rows. Other columns, of any name, are not read.
"""

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaeflow.llm.common import utf8

#: Costs by edit; a truncated row that stays adds ``TRUNCATED``.
COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED = 5
#: Bytes of an open conversation's rows, and digests of what it said, that are held in memory.
HELD_BYTES, RECENT = 8_000_000, 100_000
#: Rows whose bytes are traced back at a time.
_BLOCK = 1 << 16
#: Digests in a run that is not merged with others any more.
_LONGEST = 4_000_000

_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: After so many inserted rows, the state that each state has become.
_INSERTED = {_START: (_START, _USER, _ASSISTANT), _SYSTEM: (_SYSTEM, _USER, _ASSISTANT), _USER: (_USER, _ASSISTANT),
             _ASSISTANT: (_ASSISTANT, _USER)}
#: The states that may follow by a row that stays.
_NEXT = {_START: (_SYSTEM, _USER), _SYSTEM: (_USER,), _USER: (_ASSISTANT,), _ASSISTANT: (_USER,)}
#: Rows inserted at the end.
_CLOSING = {_START: 0, _SYSTEM: 2, _USER: 1, _ASSISTANT: 0}
_INITIALS = {b"s": _SYSTEM, b"u": _USER, b"a": _ASSISTANT}
_NAMES = {_USER: b"user", _ASSISTANT: b"assistant"}
_LEGAL = (b"su", b"ua", b"au")
_EDITS = "KRD"
_FAULTS = ("", "blank", "duplicate", "truncated")
_SOUND, _BLANK, _DUPLICATE, _CUT = range(4)


class Steps:
    """Tables of best repairs as numbers, and the steps between them.

    A table has for each state what it costs more than the cheapest, and its place among the states
    in the order of edits. Strings of edits up to and with the same row never begin one another, so
    this order decides between longer ones.
    """

    def __init__(self):
        self.tables = [((0, 0), None, None, None)]
        self.numbers = {self.tables[0]: 0}
        self.known: dict[tuple[int, int, int], tuple[int, int, bytes]] = {}

    def step(self, table: int, fault: int, role: int) -> tuple[int, int, bytes]:
        """The next table, how much the cheapest costs more, and where each state's best edit came from."""
        key = (table, fault, role)
        if key not in self.known:
            self.known[key] = self._step(*key)
        return self.known[key]

    def _step(self, table: int, fault: int, role: int) -> tuple[int, int, bytes]:
        best: dict[int, tuple] = {}
        for before, entry in enumerate(self.tables[table]):
            if entry is None:
                continue
            cost, place = entry
            for inserted, state in enumerate(_INSERTED[before]):
                for letter, after, more in self._edits(state, fault, role):
                    tail = "I" * inserted + letter
                    found = (cost + COSTS["I"] * inserted + more, place, tail, before, inserted)
                    if after not in best or found < best[after]:
                        best[after] = found
        # whatever these two lead to, an assistant row leads to for less: without the system row, which costs a Delete
        done = best[_ASSISTANT][0]
        best = {s: found for s, found in best.items() if found[0] <= done + {_START: COSTS["D"], _SYSTEM: 0}.get(s, found[0])}
        least = min(found[0] for found in best.values())
        order = sorted(best, key=lambda state: best[state][1:3])
        made = tuple((best[state][0] - least, order.index(state)) if state in best else None for state in range(4))
        if made not in self.numbers:
            self.numbers[made] = len(self.tables)
            self.tables.append(made)
        origin = bytes(
            best[state][3] | best[state][4] << 2 | _EDITS.index(best[state][2][-1]) << 4 if state in best else 255
            for state in range(4))
        return self.numbers[made], least, origin

    @staticmethod
    def _edits(state: int, fault: int, role: int):
        """``(letter, state after it, cost)`` of what may be done with a row."""
        yield "D", state, COSTS["D"]
        if fault in (_BLANK, _DUPLICATE):
            return
        more = TRUNCATED if fault == _CUT else 0
        for after in _NEXT[state]:
            if after == role:
                yield "K", after, COSTS["K"] + more
            if after in _NAMES:
                yield "R", after, COSTS["R"] + more

    def last(self, table: int) -> int:
        """The state that the cheapest whole repair is in before its last insertions."""
        closed = [(entry[0] + COSTS["I"] * _CLOSING[state], entry[1], state)
                  for state, entry in enumerate(self.tables[table]) if entry is not None]
        return min(closed)[2]


class Said:
    """Digests of what was said; older ones in sorted runs that are mapped from files."""

    def __init__(self):
        self.recent: set[bytes] = set()
        self.runs: list[np.ndarray] = []

    def again(self, digest: bytes) -> bool:
        if digest in self.recent:
            return True
        for run in self.runs:
            at = int(run.searchsorted(np.bytes_(digest)))
            # cells drop zero bytes at their end
            if at < len(run) and run[at] == digest.rstrip(b"\0"):
                return True
        self.recent.add(digest)
        if len(self.recent) >= RECENT:
            self._settle()
        return False

    def _settle(self) -> None:
        run = np.array(list(self.recent), "S16")
        while self.runs and len(self.runs[-1]) <= len(run) and len(run) + len(self.runs[-1]) <= _LONGEST:
            run = np.concatenate([run, self.runs.pop()])
        run.sort()
        with tempfile.TemporaryFile() as file:
            run.tofile(file)
            file.flush()
            self.runs.append(np.memmap(file, "S16", "r", shape=run.shape))
        self.recent = set()


class Spool:
    """Bytes that are appended, then read from the end and written over in blocks; in a file beyond a size."""

    def __init__(self, width: int):
        self.width, self.rows = width, 0
        self.file = tempfile.SpooledTemporaryFile(max_size=HELD_BYTES)

    def append(self, data: bytes) -> None:
        self.file.write(data)
        self.rows += len(data) // self.width

    def block(self, start: int, end: int) -> bytes:
        self.file.seek(start * self.width)
        return self.file.read((end - start) * self.width)

    def put(self, start: int, data: bytes) -> None:
        self.file.seek(start * self.width)
        self.file.write(data)


_ROW = pa.schema([("turn", pa.int64()), ("role", pa.binary()), ("text", pa.binary()), ("fault", pa.int8()), ("illegal", pa.bool_())])


class Rows:
    """Rows of the open conversation, in order; in a file beyond ``HELD_BYTES``."""

    def __init__(self):
        self.held, self.size, self.file, self.writer = [], 0, None, None

    def append(self, row: tuple) -> None:
        self.held.append(row)
        self.size += len(row[1]) + len(row[2]) + 200
        if self.size > HELD_BYTES:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
                self.writer = pa.ipc.new_stream(self.file, _ROW)
            columns = [pa.array(c, field.type) for c, field in zip(zip(*self.held), _ROW)]
            self.writer.write_batch(pa.record_batch(columns, schema=_ROW))
            self.held, self.size = [], 0

    def __iter__(self) -> Iterator[tuple]:
        if self.file is not None:
            self.writer.close()
            self.file.seek(0)
            for batch in pa.ipc.open_stream(self.file):
                yield from zip(*(column.to_pylist() for column in batch.columns))
            self.file.close()
        yield from self.held


class Conversation:
    """One conversation while its rows stream past."""

    def __init__(self, number: int | None, steps: Steps):
        self.number, self.steps = number, steps
        self.rows, self.said, self.origins = Rows(), Said(), Spool(4)
        self.table, self.before, self.pending = 0, None, []

    def add(self, turn: int | None, role: bytes, text: bytes) -> None:
        content = text.strip()  # of bytes: the six kinds of white space of the rule
        if not content:
            fault = _BLANK
        elif self.said.again(hashlib.blake2b(b"%d:%b%b" % (len(role), role, text), digest_size=16).digest()):
            fault = _DUPLICATE
        else:
            fault = _SOUND if content[-1:] in (b".", b"!", b"?") else _CUT
        initial = role.decode("utf-8", "replace")[:1].encode()
        illegal = self.before is not None and self.before + initial not in _LEGAL
        self.before = initial
        self.table, _, origin = self.steps.step(self.table, fault, _INITIALS.get(initial, -1))
        self.pending.append(origin)
        if len(self.pending) >= _BLOCK:
            self._flush()
        self.rows.append((turn, role, text, fault, illegal))

    def _flush(self) -> None:
        self.origins.append(b"".join(self.pending))
        self.pending = []

    def _decide(self) -> int:
        """Write each row's edit into its first byte, from the last row to the first; the state at the end."""
        self._flush()
        ending = state = self.steps.last(self.table)
        for end in range(self.origins.rows, 0, -_BLOCK):
            start = max(0, end - _BLOCK)
            block = bytearray(self.origins.block(start, end))
            for at in range(len(block) - 4, -1, -4):
                block[at] = origin = block[at + state]
                state = origin & 3
            self.origins.put(start, block)
        return ending

    def edits(self) -> Iterator[tuple]:
        """``(conv_id, step, edit, cost, turn, role, text, fault, illegal, place)`` in order."""
        ending = self._decide()
        step, place, state, rows = 0, 0, _START, iter(self.rows)

        def inserted():
            nonlocal step, place, state
            state = _INSERTED[state][1]
            row = (self.number, step, "I", COSTS["I"], None, _NAMES[state], b"", None, False, place)
            step, place = step + 1, place + 1
            return row

        for start in range(0, self.origins.rows, _BLOCK):
            block = self.origins.block(start, min(self.origins.rows, start + _BLOCK))
            for origin, (turn, role, text, fault, illegal) in zip(block[::4], rows):
                for _ in range(origin >> 2 & 3):
                    yield inserted()
                letter = _EDITS[origin >> 4]
                cost = COSTS[letter]
                if letter != "D":
                    cost += TRUNCATED * (fault == _CUT)
                    state = _INITIALS[role[:1]] if letter == "K" else _NEXT[state][-1]
                    role = _NAMES[state] if letter == "R" else role
                yield (self.number, step, letter, cost, turn, role, text, _FAULTS[fault], illegal, None if letter == "D" else place)
                step, place = step + 1, place + (letter != "D")
        for _ in range(_CLOSING[ending]):
            yield inserted()
        if not step:
            yield (self.number, None, None, 0, None, None, None, None, False, None)


_MADE = (("conv_id", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("cost", pa.int64()), ("turn", pa.int64()),
         ("role", pa.string()), ("text", pa.string()), ("fault", pa.string()), ("illegal", pa.bool_()), ("place", pa.int64()))
_EDIT_ROWS = ("conv_id bigint, step bigint, edit string, cost bigint, turn bigint, role string, text string, fault string, "
              "illegal boolean, place bigint")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_MADE)
    return pa.record_batch([pa.array(c, kind) for c, (_, kind) in zip(columns, _MADE)], names=[n for n, _ in _MADE])


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    steps, held, opened = Steps(), [], None
    size = 0

    def ended() -> Iterator[pa.RecordBatch]:
        nonlocal held, size
        for row in opened.edits():
            held.append(row)
            size += len(row[6] or b"") + 200
            if size > HELD_BYTES:
                yield _batch(held)
                held, size = [], 0

    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("conv_id", "present", "turn", "role", "text")]
        for number, present, turn, role, text in zip(*columns):
            if opened is None or opened.number != number:
                if opened is not None:
                    yield from ended()
                opened = Conversation(number, steps)
            if present:
                opened.add(turn, role, text)
    if opened is not None:
        yield from ended()
    yield _batch(held)


def repair(conversations: DataFrame, present: str | None = None) -> DataFrame:
    """The edits that repair every conversation, one row each, in order of ``step``.

    ``edit`` is K, R, D or I; ``role`` and ``text`` are those after it (of a deleted row its own), ``fault``
    the row's first fault or empty, ``illegal`` whether its role may not follow that of the row before it,
    ``place`` where it stands in what remains. A conversation without rows has one row without an edit. Rows of a conversation stay together and in order.
    ``present`` names a boolean column: rows where it does not hold only name their conversation.
    """
    here = F.lit(True) if present is None else F.coalesce(F.col(present), F.lit(False))
    space = F.lit(" ")
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), here.alias("present"), F.col("turn").cast("bigint").alias("turn"),
        utf8(F.coalesce("role", space)).alias("role"), utf8(F.coalesce("text", space)).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_repair, _EDIT_ROWS)


def repaired(edits: DataFrame) -> DataFrame:
    """The conversations' rows after repair: ``conv_id, turn, role, text``, turns numbered from 0."""
    return edits.where("place IS NOT NULL").select("conv_id", F.col("place").alias("turn"), "role", "text")


_REPORT = (("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
           ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()))
_REPORTS = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
            "audit string, repaired_sha256 string")


class Report:
    """Counts and the digest of one conversation, updated edit by edit."""

    def __init__(self, number: int | None):
        self.number, self.counts, self.illegal, self.cost = number, dict.fromkeys(_FAULTS, 0), 0, 0
        self.first = self.last = None
        self.turns, self.audit, self.digest, self.begun = 0, bytearray(), hashlib.sha256(), False

    def add(self, edit, cost, turn, role, text, fault, illegal) -> None:
        if edit is None:
            return
        self.audit += edit.encode()
        self.cost += cost
        self.illegal += illegal
        if edit != "I":
            self.counts[fault] += 1
            if turn is not None and turn != self.last:
                self.first = turn if self.first is None else self.first
                self.last, self.turns = turn, self.turns + 1
        if edit != "D":
            self.digest.update(b"\n" * self.begun + role.encode() + b":" + text.encode())
            self.begun = True

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.number, gaps, self.counts["blank"], self.counts["duplicate"], self.counts["truncated"], self.illegal, self.cost,
                self.audit.decode(), self.digest.hexdigest())


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened = None

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(_REPORT)
        return pa.record_batch([pa.array(c, kind) for c, (_, kind) in zip(columns, _REPORT)], names=[n for n, _ in _REPORT])

    for batch in batches:
        rows = []
        columns = [batch.column(name).to_pylist() for name, _ in _MADE[:-1]]
        for number, step, *edit in zip(*columns):
            if not step:  # the first of a conversation, or its only one
                if opened is not None:
                    rows.append(opened.row())
                opened = Report(number)
            opened.add(*edit)
        yield made(rows)
    yield made([opened.row()] if opened is not None else [])


def reports(edits: DataFrame) -> DataFrame:
    """For each conversation its faults, the cost and initials of its edits, and a digest of what remains.

    ``edits`` comes from ``repair``, in its order; nothing moves. ``gaps`` are numbers that turns leave out.
    """
    return edits.mapInArrow(_report, _REPORTS)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults made by a hash of ``conv_id:turn``, and ``present``, which does not hold for those taken away.

    Of 20 rows, one each is taken away, emptied, loses its marks of sentence ends, is repeated, becomes the user's.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(name).cast("string"), space) for name in ("conv_id", "turn")))
    kind = F.crc32(key) % 20
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = conversations.select(
        F.col("conv_id"), F.col("turn"), F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.coalesce(text, space).alias("text"), (kind != 0).alias("present"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")
