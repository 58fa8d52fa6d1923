"""Schemas of the tables the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

from vitaeflow.fixed_values import RECORD_FIELDS, SOURCE_NAME


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_S, _I, _L = T.StringType(), T.IntegerType(), T.LongType()

STORED_DOCUMENTS = _struct(
    ("run_norm", _S), ("path", _S), ("modificationTime", T.TimestampType()), ("length", _L), ("content", T.BinaryType())
)

# The same with contents once: which content a key has, and the contents.
REFERENCES = _struct(
    ("run_norm", _S), ("path", _S), ("modificationTime", T.TimestampType()), ("length", _L), ("digest", _S)
)
CONTENTS = _struct(("digest", _S), ("length", _L), ("content", T.BinaryType()))

RECORD = _struct(*((name, _S) for name in RECORD_FIELDS))
CANDIDATES = T.StructType([*RECORD.fields, T.StructField(SOURCE_NAME, _S)])
STAGING = T.StructType([*CANDIDATES.fields, T.StructField("ingest_ts", T.TimestampType()), T.StructField("path", _S)])

CHUNKS = _struct(("RUN", _S), ("chunk_no", _I), ("text", _S), ("vector", T.ArrayType(T.FloatType())))

# Versions of files that an intake has taken in.
SEEN_FILES = _struct(("path", _S), ("modificationTime", T.TimestampType()), ("length", _L))

CHAT_REPLY = _struct(
    ("choices", T.ArrayType(_struct(("message", _struct(("content", _S)))))),
    ("usage", _struct(("total_tokens", _L))),
)
EMBEDDING_REPLY = _struct(("data", T.ArrayType(_struct(("embedding", T.ArrayType(T.FloatType()))))))

# What Spark's binaryFile source yields; streams need it spelled out.
BINARY_FILES = _struct(
    ("path", _S), ("modificationTime", T.TimestampType()), ("length", _L), ("content", T.BinaryType())
)
