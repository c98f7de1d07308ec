"""A data source of transfer rows by block, in Python: batch reads in ranges of blocks, and streams whose offset is the last block.

``spark.dataSource.register(BlockSource)`` makes ``format("blocks")`` known. Options: ``path``, a Parquet file or folder that Arrow can open on every
executor; ``block``, the column of whole block numbers (``block_number``); ``per_partition``, blocks a partition (10,000). Filters on the block column
are taken over by the reader and cut the ranges; files and row groups outside a range are skipped by their statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType


@dataclass
class Blocks(InputPartition):
    """Blocks ``first`` to ``last``, both included."""

    first: int
    last: int


def _files(path: str) -> ds.Dataset:
    return ds.dataset(path.removeprefix("file://"), format="parquet")


def _limits(path: str, block: str) -> tuple[int, int] | None:
    """The least and greatest block, by the statistics of row groups."""
    found = []
    for fragment in _files(path).get_fragments():
        for group in fragment.row_groups:
            if group.statistics and block in group.statistics:
                found.append((group.statistics[block]["min"], group.statistics[block]["max"]))
    return (min(a for a, _ in found), max(b for _, b in found)) if found else None


def _ranges(first: int, last: int, size: int) -> list[Blocks]:
    return [Blocks(a, min(a + size - 1, last)) for a in range(first, last + 1, size)]


def _rows(path: str, block: str, part: Blocks | None, names: list[str]) -> Iterator[pa.RecordBatch]:
    if part is None:  # where there are no ranges at all
        return
    inside = (ds.field(block) >= part.first) & (ds.field(block) <= part.last)
    yield from (b for b in _files(path).to_batches(columns=names, filter=inside) if b.num_rows)


class BlockReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, block: str, size: int):
        self.names, self.path, self.block, self.size = schema.names, path, block, size
        self.first, self.last = None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != (self.block,) or not isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                yield f
                continue
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                least = f.value + isinstance(f, GreaterThan)
                self.first = least if self.first is None else max(self.first, least)
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                most = f.value - isinstance(f, LessThan)
                self.last = most if self.last is None else min(self.last, most)

    def partitions(self) -> list[Blocks]:
        held = _limits(self.path, self.block)
        if held is None:
            return []
        first, last = (held[0] if self.first is None else max(held[0], self.first)), (held[1] if self.last is None else min(held[1], self.last))
        return _ranges(first, last, self.size)

    def read(self, partition: Blocks | None) -> Iterator[pa.RecordBatch]:
        return _rows(self.path, self.block, partition, self.names)


class BlockStream(DataSourceStreamReader):
    """Offsets are the first block not read yet; a batch has the blocks between two of them. Files that come later must hold later blocks."""

    def __init__(self, schema: StructType, path: str, block: str, size: int):
        self.names, self.path, self.block, self.size = schema.names, path, block, size

    def initialOffset(self) -> dict:
        held = _limits(self.path, self.block)
        return {"block": held[0] if held else 0}

    def latestOffset(self) -> dict:
        held = _limits(self.path, self.block)
        return {"block": held[1] + 1 if held else 0}

    def partitions(self, start: dict, end: dict) -> list[Blocks]:
        return _ranges(start["block"], end["block"] - 1, self.size)

    def read(self, partition: Blocks | None) -> Iterator[pa.RecordBatch]:
        return _rows(self.path, self.block, partition, self.names)


class BlockSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blocks"

    def schema(self) -> StructType:
        return from_arrow_schema(_files(self.options["path"]).schema)

    def _parts(self) -> tuple[str, str, int]:
        return self.options["path"], self.options.get("block", "block_number"), int(self.options.get("per_partition", 10_000))

    def reader(self, schema: StructType) -> BlockReader:
        return BlockReader(schema, *self._parts())

    def streamReader(self, schema: StructType) -> BlockStream:
        return BlockStream(schema, *self._parts())


def register(spark) -> None:
    """Make the format known to the session and let its readers take filters over."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BlockSource)
