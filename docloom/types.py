"""Spark types of short descriptions, without a session: workers and tools import modules that have none."""

from __future__ import annotations

from pyspark.sql import types as T

_SIMPLE = {"string": T.StringType, "bigint": T.LongType, "long": T.LongType, "int": T.IntegerType, "double": T.DoubleType, "float": T.FloatType, "boolean": T.BooleanType, "binary": T.BinaryType}


def _parts(text: str) -> list[str]:
    """Cut at the commas outside angle brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [x.strip() for x in (*out, text[start:]) if x.strip()]


def data_type(text: str) -> T.DataType:
    """A type: a simple name, array<...>, or struct<name:type,...>."""
    text = text.strip()
    if text.startswith("array<"):
        return T.ArrayType(data_type(text[6:-1]))
    if text.startswith("struct<"):
        return T.StructType([T.StructField(*(f(x) for f, x in zip((str.strip, data_type), p.split(":", 1), strict=True))) for p in _parts(text[7:-1])])
    return _SIMPLE[text]()


def struct(text: str) -> T.StructType:
    """A row type: "name type, ..."."""
    return T.StructType([T.StructField(p.split(None, 1)[0], data_type(p.split(None, 1)[1])) for p in _parts(text)])
