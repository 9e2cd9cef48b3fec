"""Spark types from short texts, without a running session."""

from __future__ import annotations

import re

from pyspark.sql import types as T

_PLAIN = {
    "string": T.StringType, "int": T.IntegerType, "long": T.LongType, "bigint": T.LongType, "double": T.DoubleType,
    "float": T.FloatType, "boolean": T.BooleanType, "binary": T.BinaryType, "timestamp": T.TimestampType,
}
_TOKEN = re.compile(r"[\w]+|[<>:,]")


def struct_of(text: str) -> T.StructType:
    """``"a int, b array<struct<c: string>>"`` as a type."""
    tokens = _TOKEN.findall(text)
    fields, at = _fields(tokens, 0)
    if at != len(tokens):
        raise ValueError(f"cannot read {text!r}")
    return T.StructType(fields)


def type_of(text: str) -> T.DataType:
    """``"array<double>"`` as a type."""
    return _type(_TOKEN.findall(text), 0)[0]


def _fields(tokens: list[str], at: int) -> tuple[list[T.StructField], int]:
    fields = []
    while True:
        name = tokens[at]
        kind, at = _type(tokens, at + (2 if tokens[at + 1] == ":" else 1))
        fields.append(T.StructField(name, kind))
        if at == len(tokens) or tokens[at] != ",":
            return fields, at
        at += 1


def _type(tokens: list[str], at: int) -> tuple[T.DataType, int]:
    if tokens[at] == "array":
        inner, at = _type(tokens, at + 2)
        return T.ArrayType(inner), at + 1
    if tokens[at] == "struct":
        fields, at = _fields(tokens, at + 2)
        return T.StructType(fields), at + 1
    return _PLAIN[tokens[at]](), at + 1
