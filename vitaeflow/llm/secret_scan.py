"""Secret scans by one automaton for all rules.

The rules' patterns, read backwards, are compiled into a single deterministic
automaton. One pass over the bytes of a text, from the last to the first, then
tells for every position which rules match from there on. Walking each rule's
own automaton from its leftmost free start gives the longest match, and the
next search begins after it: leftmost, non-overlapping spans for each rule.
All patterns are ASCII, so bytes and code points agree on what matches; spans
are in code points.

A rule's ``head`` is the part before the value; a value shorter than ``least``
drops the match, but the search still goes on behind it.

Defined cases: a null or empty text has no spans. Repeated rows are scanned
each for itself. Very long texts cost one state of memory, plus their events.
"""

from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaeflow.llm.automaton import Automaton, compile_trees, longest, mirrored, parse
from vitaeflow.llm.common import array_function, utf8

MARK = "[REDACTED]"


@dataclass(frozen=True)
class SecretRule:
    """``begin`` is what must follow a start for the pass to report it: the pattern, or its shortest passing form."""

    kind: str
    pattern: str
    head: str = ""
    least: int = 1
    any_case_head: bool = False
    begin: str = ""


# The three base rules as the contract states them.
_ASSIGN_HEAD = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE = (
    SecretRule("assign", "[A-Za-z0-9+/_.=-]+", head=_ASSIGN_HEAD, least=8, any_case_head=True),
    SecretRule("access", "AKIA[A-Z0-9]+", least=16),
    # shorter runs cannot hold a passing one, so only starts of 32 digits are reported
    SecretRule("hex", "[0-9a-f]+", least=32, begin="[0-9a-f]{32}"),
)
ADDED = (
    SecretRule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("host_token", "gh[oprsu]_[A-Za-z0-9]+", least=40),
    SecretRule("chat_token", "xox[abprs]-[A-Za-z0-9-]+", least=20),
    SecretRule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
)
RULES = BASE + ADDED


@dataclass(frozen=True)
class Scanner:
    rules: tuple[SecretRule, ...]
    starts: Automaton
    whole: tuple[Automaton, ...]
    heads: tuple[Automaton | None, ...]


def _tree(rule: SecretRule, tail: str):
    tail_tree = parse(tail)
    return ("cat", [parse(rule.head, rule.any_case_head), tail_tree]) if rule.head else tail_tree


@lru_cache(maxsize=8)
def scanner(rules: tuple[SecretRule, ...] = RULES) -> Scanner:
    """The compiled rules; made once and shipped to the tasks as arrays."""
    return Scanner(
        rules,
        compile_trees([mirrored(_tree(rule, rule.begin or rule.pattern)) for rule in rules], anywhere=True),
        tuple(compile_trees([_tree(rule, rule.pattern)], anywhere=False) for rule in rules),
        tuple(compile_trees([parse(rule.head, rule.any_case_head)], anywhere=False) if rule.head else None for rule in rules),
    )


def _pass(auto: Automaton):
    """A function from bytes to ``(position, bits)`` of the starts in them, last first."""
    width = auto.width
    # rows in place of state numbers: a step is two look-ups. Accepting states are told by their row's last cell.
    rows: list[list] = [[None] * (width + 1) for _ in range(auto.states)]
    steps, accepts = auto.next.tolist(), auto.accepts.tolist()
    for s, row in enumerate(rows):
        for c in range(width):
            row[c] = rows[steps[s * width + c]]
        row[width] = accepts[s]
    begin = rows[0]

    def run(data: bytes) -> list[tuple[int, int]]:
        classes = data.translate(auto.class_of)
        found, row, at = [], begin, len(data)
        for c in reversed(classes):
            row = row[c]
            at -= 1
            if row[width]:
                found.append((at, row[width]))
        return found

    return run


def spans_in(compiled: Scanner, starts: list[tuple[int, int]], data: bytes) -> list[tuple[int, int, int]]:
    """``(start, end, rule)`` of all passing matches, as byte offsets, by start and then rule."""
    found = []
    for i, rule in enumerate(compiled.rules):
        after = 0
        for at, bits in reversed(starts):
            if not bits >> i & 1 or at < after:
                continue
            after = longest(compiled.whole[i], data, at)
            head = longest(compiled.heads[i], data, at) if rule.head else at
            if after - head >= rule.least:
                found.append((at, after, i))
    return sorted(found, key=lambda span: (span[0], span[2]))


def find(compiled: Scanner, run, data: bytes | None) -> list[tuple[int, int, int]]:
    starts = run(data) if data else []
    return spans_in(compiled, starts, data) if starts else []


def in_code_points(spans: list[tuple[int, int, int]], data: bytes) -> list[tuple[int, int, int]]:
    if not spans or data.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[a]), int(before[b]), i) for a, b, i in spans]


def _scan(compiled: Scanner):
    def make():
        run = _pass(compiled.starts)
        kinds = [rule.kind for rule in compiled.rules]
        cell = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

        def work(texts: pa.Array) -> pa.Array:
            rows = [in_code_points(find(compiled, run, data), data) for data in texts.to_pylist()]
            flat = [span for row in rows for span in row]
            values = pa.StructArray.from_arrays(
                [pa.array([kinds[i] for _, _, i in flat], pa.string()), pa.array([a for a, _, _ in flat], pa.int64()),
                 pa.array([b for _, b, _ in flat], pa.int64())], fields=list(cell))
            offsets = pa.array([0, *accumulate(len(row) for row in rows)], pa.int32())
            return pa.ListArray.from_arrays(offsets, values)

        return work

    return array_function(make, "array<struct<kind: string, start: bigint, end: bigint>>")


def scan(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, text: str = "text") -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end in code points; by start, then rule) of every row; no shuffle."""
    return docs.select("doc_id", _scan(scanner(rules))(utf8(f"`{text}`")).alias("spans"))


def masked(data: bytes, spans: list[tuple[int, int, int]]) -> bytes:
    """The text with every stretch covered by spans replaced by ``MARK``."""
    parts, at, end = [], 0, -1
    for a, b, _ in spans:
        if a >= end:
            parts += [data[at:a], MARK.encode()]
        end = max(end, b)
        at = end
    return b"".join([*parts, data[at:]])


def _mask(compiled: Scanner):
    def make():
        run = _pass(compiled.starts)

        def work(texts: pa.Array) -> pa.Array:
            rows = []
            for data in texts.to_pylist():
                spans = find(compiled, run, data)
                rows.append(masked(data, spans) if spans else data)
            return pa.array(rows, pa.binary()).cast(pa.string())

        return work

    return array_function(make, "string")


def redact(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced by ``MARK``; ``n_chars``, if there, follows. Other columns stay."""
    changed = docs.withColumn("text", _mask(scanner(rules))(utf8("text")))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed = changed.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))
    return changed.select(*(F.col(f"`{c}`") for c in docs.columns))
