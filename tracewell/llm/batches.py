"""Stretches of Arrow batches that are worked on together."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stretches(texts: pa.Array, most: int = 3_000_000) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of successive rows with about ``most`` characters."""
    first, own, size = 0, [], 0
    for i, one in enumerate(texts):
        own.append(one.as_py() or "")
        size += len(own[-1])
        if size >= most:
            yield first, own
            first, own, size = i + 1, [], 0
    yield first, own


def text_or_row(docs: DataFrame, keep_row: bool) -> list[Column]:
    """The text as a string; with ``keep_row`` the whole row as a struct ``row`` instead, which holds it, so that a text crosses to Python once."""
    text = F.col("text").cast("string").alias("text")
    return [F.struct(*[text if c == "text" else F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_row else [text]


def texts_of(column: pa.Array) -> pa.Array:
    """The texts in a column of ``text_or_row``."""
    return column.field(column.type.get_field_index("text")) if pa.types.is_struct(column.type) else column
