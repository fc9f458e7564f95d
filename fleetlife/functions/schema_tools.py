"""Helpers over a DataFrame's schema: flatten, reorder, make writable as text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flattened_columns(schema: T.StructType) -> list[Column]:
    """Leaves of nested structs named ``outer_inner``; a leaf named like its parent keeps the short name."""

    def leaves(fields: Iterable[T.StructField], path: tuple[str, ...]):
        for field in fields:
            here = (*path, field.name)
            if isinstance(field.dataType, T.StructType):
                for name, source in leaves(field.dataType.fields, here):
                    yield (field.name if name == field.name else f"{field.name}_{name}"), source
            else:
                yield field.name, ".".join(f"`{p}`" for p in here)

    return [F.col(source).alias(name) for name, source in leaves(schema.fields, ())]


def flatten(df: DataFrame) -> DataFrame:
    return df.select(*flattened_columns(df.schema))


def reorder(df: DataFrame, first: Iterable[str]) -> DataFrame:
    """Named columns first, the rest after them; names the frame lacks are ignored."""
    lead = [c for c in dict.fromkeys(first) if c in df.columns]
    return df.select(*[F.col(f"`{c}`") for c in lead + [c for c in df.columns if c not in lead]])


def text_safe(df: DataFrame) -> DataFrame:
    """Columns that a flat text format cannot hold become text: JSON for nested types, plain text for dates."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
            column = F.to_json(column)
        elif not isinstance(field.dataType, (T.NumericType, T.StringType, T.BooleanType)):
            column = column.cast("string")
        out.append(column.alias(field.name))
    return df.select(*out)
