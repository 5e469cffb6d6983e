"""Struct types from plain field lists, without needing a session."""

from __future__ import annotations

from pyspark.sql import types as T

_STRINGS = T.ArrayType(T.StringType())


def struct_of(fields: str, **nested: T.DataType) -> T.StructType:
    """``"name type, …"`` as a struct; ``strings`` is an array of strings, other types may be passed by field name."""
    struct = T.StructType()
    for field in fields.split(","):
        name, dtype = field.split()
        if dtype == "nested":
            struct = struct.add(name, nested[name])
        else:
            struct = struct.add(name, _STRINGS if dtype == "strings" else dtype)
    return struct
