"""Quality rules as a ledger of failure bits.

Every text is measured once, every rule is evaluated once on the measurements,
and the outcome is one bit per rule. Policies are named, versioned sets of
rules; applying one, comparing two or leaving a rule out only looks at the
bits, so none of it reads a text again.

Defined cases: a null or empty text has no words and measures 0 everywhere; it
fails ``few_words``. Repeated rows are measured each for itself. Ratios with a
zero base are 0. The ledger keeps ``doc_id`` (null included) and no other
column of its input, so columns of any name may come along.
"""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaeflow.llm.common import Numbering, array_function, code_points, free_name, utf8

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters")
_MEASURES_TYPE = "struct<" + ", ".join(f"{name}: bigint" for name in MEASURES) + ">"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    numbers = Numbering()
    word = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
    size = len(numbers)
    if size < 1 << 21:
        key = (word[:-2] * size + word[1:-1]) * size + word[2:]
    else:  # more than 2 million different words: number the pairs before the triples
        pair = np.unique(word[:-1] * size + word[1:], return_inverse=True)[1]
        key = pair[:-1] * size + word[2:]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    found = np.zeros(n - 2, bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= found
    return int(covered.sum())


def measure_text(data: bytes | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    if not data:
        return (0,) * len(MEASURES)
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip(_SPACE)]
    upper = len(data) - len(data.translate(None, _UPPER))
    return (
        len(words),
        code_points(data.translate(None, _SPACE)),
        len(data) - len(data.translate(None, _SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        upper,
        upper + len(data) - len(data.translate(None, _LOWER)),
    )


def _measure():
    def work(texts: pa.Array) -> pa.Array:
        rows = [measure_text(data) for data in texts.to_pylist()]
        columns = zip(*rows) if rows else [()] * len(MEASURES)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(MEASURES))

    return work


Measure = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    """``fails(m)`` holds for a text that breaks the rule, ``m(name)`` being a measurement.

    A bit never changes its meaning; a changed rule gets a new one.
    """

    bit: int
    name: str
    fails: Callable[[Measure], Column]


@dataclass(frozen=True)
class Policy:
    """The rules a text must not break, under a version."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...]) -> int:
        known = {rule.name: rule.bit for rule in rules}
        return sum(1 << known[name] for name in self.rules)


RULES = (
    Rule(0, "few_words", lambda m: m("n_words") < 50),
    Rule(1, "repeated_words", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    Rule(2, "symbols", lambda m: 5 * m("n_symbols") > m("n_words")),
    Rule(3, "upper_case", lambda m: 10 * m("n_upper") > 6 * m("n_letters")),
    Rule(4, "repeated_lines", lambda m: 10 * m("n_dup_lines") > 3 * m("n_lines")),
    Rule(5, "short_words", lambda m: m("word_chars") < 3 * m("n_words")),
    Rule(6, "long_words", lambda m: m("word_chars") > 10 * m("n_words")),
    Rule(7, "some_repeated_words", lambda m: 100 * m("n_repeat_words") > 20 * m("n_words")),
)

#: The base rules alone, the rules for junk that clean prose does not break, and all rules.
POLICIES = (
    Policy("base-1", ("few_words", "repeated_words")),
    Policy("junk-1", ("few_words", "repeated_words", "symbols", "upper_case")),
    Policy("strict-1", tuple(rule.name for rule in RULES)),
)
PRODUCTION = POLICIES[1]


def failure_bits(m: Measure, rules: tuple[Rule, ...] = RULES) -> Column:
    bits = [F.when(rule.fails(m), F.lit(1 << rule.bit).cast("bigint")).otherwise(0) for rule in rules]
    return reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("bigint"))


def measured(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """``docs`` with the measurements of each text in the struct column ``name``."""
    return docs.withColumn(name, array_function(_measure, _MEASURES_TYPE)(utf8(f"`{text}`")))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``doc_id``, the measurements and ``failures``, the bits of the rules that fail; no shuffle."""
    rows = measured(docs.select("doc_id", F.col(f"`{text}`").alias("text")), "m")
    rows = rows.select("doc_id", *(F.col(f"m.{name}") for name in MEASURES))
    return rows.withColumn("failures", failure_bits(F.col, rules))


def passes(failures: Column, policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether no rule of the policy failed."""
    return failures.bitwiseAND(F.lit(policy.mask(rules))) == 0


def verdicts(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with ``kept_by``, the versions under which each text is kept."""
    kept = [F.when(passes(F.col("failures"), policy, rules), F.lit(policy.version)) for policy in policies]
    return rows.withColumn("kept_by", F.array_compact(F.array(*kept)))


def ablations(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each policy and each of its rules: texts failing it, failing it alone, and kept without it.

    One aggregation over the bits with partial sums; its result has one row per
    policy and rule. An empty ledger gives zeros.
    """
    bit = {rule.name: 1 << rule.bit for rule in rules}
    failures, made = F.col("failures"), []
    for policy in policies:
        mask = policy.mask(rules)
        for name in policy.rules:
            made.append(F.struct(
                F.lit(policy.version).alias("version"),
                F.lit(name).alias("rule"),
                F.count_if(failures.bitwiseAND(F.lit(bit[name])) != 0).alias("failing"),
                F.count_if(failures.bitwiseAND(F.lit(mask)) == bit[name]).alias("failing_alone"),
                F.count_if(failures.bitwiseAND(F.lit(mask & ~bit[name])) == 0).alias("kept_without"),
            ))
    return rows.agg(F.array(*made).alias("r")).select(F.inline("r"))


def keep_good(docs: DataFrame, policy: Policy = PRODUCTION, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their columns; one scan, no shuffle."""
    name = free_name(docs, "measured")
    failures = failure_bits(lambda m: F.col(f"`{name}`.{m}"), rules)
    return measured(docs, name).where(passes(failures, policy, rules)).drop(name)
