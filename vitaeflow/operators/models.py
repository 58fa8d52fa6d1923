"""Model calls: batch functions supplied by the user, or requests answered elsewhere."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaeflow.operators.candidates import latest_rows

#: ``embed(texts) -> vectors``
Embedder = Callable[[list[str]], list[list[float]]]
#: ``model(request bodies) -> reply bodies``, both JSON texts
ChatModel = Callable[[list[str]], list[str]]

#: Calls that one task makes at most, where rows are dealt out for them, and the first pause in seconds.
TASK_CALLS, _PAUSE = 64, 0.2


def _vector_checker():
    """A closure, so that workers need no import of this package."""

    def checked(value):
        """The numbers of an embedding, or an error."""
        import numpy

        cells = numpy.asarray(value)
        if cells.ndim != 1 or cells.dtype.kind not in "iuf":
            raise ValueError("not a list of numbers")
        with numpy.errstate(over="ignore"):
            cells = cells.astype(numpy.float32)
        if not len(cells) or not numpy.isfinite(cells).all():
            raise ValueError("no numbers" if not len(cells) else "numbers that are not finite")
        return cells.tolist()

    return checked


def _text_checker():
    def checked(value):
        if not isinstance(value, str):
            raise ValueError(f"{type(value).__name__} instead of text")
        return value

    return checked


def _call(rows: DataFrame, function: Callable, source: str, output: str, kind: T.DataType, checked: Callable,
          batch_size: int, concurrency: int | None, attempts: int, expected: int | None = None) -> DataFrame:
    """Add ``output`` and ``error``: one call per ``batch_size`` inputs.

    Only the input column goes to Python. A failing call is tried ``attempts`` times, each after a
    longer pause, then input by input, so that one bad input costs one row; null inputs are not sent.
    Calls that fail in the same batch of rows share their pauses.
    A result that ``checked`` does not take costs its own row and no other.

    With ``concurrency`` the rows are dealt to that many tasks, and to more where a task would have
    over ``TASK_CALLS`` calls, so that a lost task repeats few of them. How many run at a time is up
    to the cluster's cores; a service that takes fewer is best protected by a limiter in ``function``.
    ``expected`` is the number of rows where it is known, which saves counting them.
    """
    result = T.StructType([T.StructField("value", kind), T.StructField("error", T.StringType())])

    def judged(value):
        if value is None:
            return None, "empty result"
        try:
            return checked(value), None
        except Exception as problem:
            return None, f"malformed result: {problem}"

    def asked(inputs):
        """Results for ``inputs``, or what went wrong with the call."""
        try:
            given = function(inputs)
            if isinstance(given, (str, bytes, dict)):
                raise ValueError(f"{type(given).__name__} instead of a list of results")
            answers = list(given)
            if len(answers) != len(inputs):
                raise ValueError(f"{len(answers)} results for {len(inputs)} inputs")
        except Exception as problem:
            return None, problem
        return [judged(value) for value in answers], None

    def alone(one):
        answers, problem = asked([one])
        return (None, f"model call failed: {problem}") if problem else answers[0]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import time

        import pandas

        for batch in batches:
            values, errors = [None] * len(batch), ["no input"] * len(batch)
            present = [i for i, text in enumerate(batch) if text is not None]
            calls = [present[start : start + batch_size] for start in range(0, len(present), batch_size)]
            # the calls that failed share a pause
            for number in range(max(1, attempts)):
                if number and calls:
                    time.sleep(_PAUSE * 2 ** (number - 1))
                failed = []
                for part in calls:
                    answers, problem = asked([batch.iloc[i] for i in part])
                    if problem:
                        failed.append((part, problem))
                    else:
                        for i, (value, error) in zip(part, answers):
                            values[i], errors[i] = value, error
                calls = [part for part, _ in failed]
            for part, problem in failed:
                if len(part) == 1:
                    errors[part[0]] = f"model call failed: {problem}"
                else:
                    for i in part:
                        values[i], errors[i] = alone(batch.iloc[i])
            yield pandas.DataFrame({"value": pandas.Series(values, dtype=object), "error": errors})

    # nondeterministic: Catalyst must neither repeat nor reorder the calls
    call = F.pandas_udf(run, result).asNondeterministic()
    if concurrency is not None:
        number = rows.count() if expected is None else expected
        rows = rows.repartition(max(concurrency, math.ceil(number / (TASK_CALLS * batch_size))))
    called = rows.withColumn("_call", call(F.col(source))).withColumn(output, F.col("_call.value"))
    error = F.col("_call.error")
    if "error" in rows.columns:
        error = F.coalesce(F.col("error"), error)
    return called.withColumn("error", error).drop("_call")


def _answered(rows: DataFrame, function: Callable, source: str, output: str, kind: T.DataType, checked: Callable, ledger, **how) -> DataFrame:
    if ledger is None:
        return _call(rows, function, source, output, kind, checked, **how)
    # what is asked of a ledger is counted there
    how["expected"] = None
    return ledger.answered(rows, lambda asked: _call(asked, function, source, "value", kind, checked, **how), source, output)


def embed(rows: DataFrame, embedder: Embedder, text: str = "text", output: str = "vector", batch_size: int = 64,
          concurrency: int | None = None, attempts: int = 2, expected: int | None = None, ledger=None) -> DataFrame:
    """Add the embedding of a text column and ``error``.

    With a ``sources.ledger.Ledger``, equal texts are embedded once, and those it knows not at all.
    """
    return _answered(rows, embedder, text, output, T.ArrayType(T.FloatType()), _vector_checker(), ledger,
                     batch_size=batch_size, concurrency=concurrency, attempts=attempts, expected=expected)


def complete(rows: DataFrame, model: ChatModel, payload: str = "payload", output: str = "body", batch_size: int = 16,
             concurrency: int | None = None, attempts: int = 2, expected: int | None = None, ledger=None) -> DataFrame:
    """Add the reply body to request bodies and ``error``; with a ``Ledger``, equal requests are sent once in all."""
    return _answered(rows, model, payload, output, T.StringType(), _text_checker(), ledger,
                     batch_size=batch_size, concurrency=concurrency, attempts=attempts, expected=expected)


def chat_model(answer: Callable[[list[str]], list[str]]) -> ChatModel:
    """A chat model from a function over prompts, for offline runs: it unpacks
    requests and packs replies, counting words as tokens."""

    def model(payloads: list[str]) -> list[str]:
        import json

        prompts = [json.loads(p)["messages"][-1]["content"][0]["text"] for p in payloads]
        replies = []
        for prompt, text in zip(prompts, answer(prompts)):
            usage = {"total_tokens": len(prompt.split()) + len(text.split())}
            replies.append(json.dumps({"choices": [{"message": {"content": text}}], "usage": usage}))
        return replies

    return model


def hash_embed(rows: DataFrame, text: str = "text", output: str = "vector", dimension: int = 256) -> DataFrame:
    """Offline embedding without a model: hashed word counts, scaled to length one.

    A word's place is the first eight hex digits of its MD5 modulo ``dimension``, which other systems
    can repeat.
    """
    from pyspark.ml.feature import CountVectorizerModel, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = F.array_remove(F.split(F.lower(F.col(text)), r"\s+"), "")
    places = F.transform(words, lambda word: F.pmod(F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint"), F.lit(dimension)).cast("string"))
    counter = CountVectorizerModel.from_vocabulary([str(i) for i in range(dimension)], inputCol="_words", outputCol="_counts")
    counted = counter.transform(rows.withColumn("_words", F.coalesce(places, F.array().cast("array<string>"))))
    scaled = Normalizer(p=2.0, inputCol="_counts", outputCol="_unit").transform(counted)
    return scaled.withColumn(output, vector_to_array("_unit", "float32")).drop("_words", "_counts", "_unit")


def requests(rows: DataFrame, request_id: str, payload: str = "payload") -> DataFrame:
    """The table of requests for a model that runs elsewhere."""
    return rows.select(F.col(request_id).cast("string").alias("request_id"), F.col(payload).alias("payload"))


def join_replies(asked: DataFrame, replies: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Requests with their reply body, null where none came.

    Replies may repeat (calls are at least once): the last by ``order`` counts,
    else the greatest body, so that the choice is repeatable.
    """
    last = latest_rows(replies, "request_id", order or ["body"])
    return asked.join(last.select("request_id", "body"), "request_id", "left")
