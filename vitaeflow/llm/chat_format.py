"""Chat formatting: conversations rendered by a compiled template, turn by turn.

A conversation is rendered in the order of its turns while its rows stream
past, so a conversation of any length costs the memory of one turn; only the
rows of one conversation have to meet in one task, since its digest is one
sequential SHA-256. The result has one row per turn: its piece of the output,
where the piece stands, and the generation spans.

Defined cases: null role or text count as empty. Rows of equal turn keep the
order of role and text; null turns come first. A null ``conv_id`` is a
conversation of its own. Repeated rows are turns of their own. An empty table
gives no rows. Columns beside ``conv_id, turn, role, text`` are not read.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaeflow.llm.templates import compile_template, unescape

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"

#: The production template. Roles and texts are escaped, so its control strings mark turns and nothing else.
CHAT = (
    "{% for message in messages %}<|turn|>{{ role | escape }}<|text|>"
    "{% if role == 'assistant' %}{% generation %}{{ text | escape }}{% endgeneration %}"
    "{% else %}{{ text | escape }}{% endif %}<|end|>\n{% endfor %}"
)

_TURNS = "conv_id bigint, position bigint, start bigint, piece string, spans array<struct<start: bigint, end: bigint>>"


def ordered(conversations: DataFrame) -> DataFrame:
    """The rows of each conversation together and in order."""
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")


def format_turns(conversations: DataFrame, template: str = CHAT) -> DataFrame:
    """One row per turn with its part of the formatted text; rows of a conversation stay together and in order.

    ``start`` is the code point at which the piece stands in the whole; ``spans`` are generation
    spans in the whole. A template that cannot be read raises here.
    """
    compile_template(template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = compile_template(template)
        waiting = None  # the turn before: whether it is the last is known with the next row
        position = start = 0
        previous = ""

        def made(last: bool):
            nonlocal position, start, previous
            conv, role, text = waiting
            out = compiled.turn({"role": role, "text": text, "index": position, "first": position == 0, "last": last,
                                 "previous_role": previous})
            row = (conv, position, start, out.text(), [{"start": start + a, "end": start + b} for a, b in out.spans])
            position, start, previous = (0, 0, "") if last else (position + 1, start + out.length, role)
            return row

        for batch in batches:
            rows = []
            for row in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "role", "text"))):
                if waiting:
                    rows.append(made(last=waiting[0] != row[0]))
                waiting = row
            yield _batch(rows)
        if waiting:
            yield _batch([made(last=True)])

    return ordered(conversations).mapInArrow(run, _TURNS)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_KINDS = (("conv_id", pa.int64()), ("position", pa.int64()), ("start", pa.int64()), ("piece", pa.string()), ("spans", _SPANS))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_KINDS)
    return pa.record_batch([pa.array(c, kind) for c, (_, kind) in zip(columns, _KINDS)], names=[n for n, _ in _KINDS])


def read_back(piece: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    role, _, rest = piece.partition(TURN)[2].partition(TEXT)
    return unescape(role), unescape(rest.partition(END)[0])


def summaries(turns: DataFrame) -> DataFrame:
    """For each conversation what can be read back from its formatted turns; no further shuffle.

    ``turns`` comes from ``format_turns`` with a template that marks turns like ``CHAT``. Digests are
    updated turn by turn, so nothing of a conversation is held but its counters.
    """
    schema = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
              "formatted_chars bigint")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def closed():
            conv, n, all_text, loss_chars, loss, chars = state
            return (conv, n, all_text.hexdigest(), loss_chars, loss.hexdigest(), chars)

        for batch in batches:
            rows = []
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "position", "start", "piece", "spans")]
            for conv, position, start, piece, spans in zip(*columns):
                if position == 0:
                    if state:
                        rows.append(closed())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_back(piece)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                for span in spans:
                    part = unescape(piece[span["start"] - start : span["end"] - start])
                    state[3] += len(part)
                    state[4].update(part.encode())
                state[5] += len(piece)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], names=names)
        if state:
            yield pa.record_batch([pa.array([v], k) for v, k in zip(closed(), kinds)], names=names)

    return turns.mapInArrow(run, schema)
