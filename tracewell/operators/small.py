"""What is left of a graph once it has few edges: finished by one task, in place of many joins of small tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Edges up to which one task takes over; some 10 MB of its memory.
ONE_TASK = 100_000


def _finished(edges: DataFrame, names: tuple[str, str], label) -> DataFrame:
    """(node, label) that ``label`` gives for a dictionary of each node's targets."""
    kind = edges.schema["a"].dataType
    schema = T.StructType().add(names[0], kind).add(names[1], kind)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict = {}
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out.setdefault(a, []).append(b)
                out.setdefault(b, [])
        found = label(out)
        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in found], schema=arrow)

    arrow = pa.schema([(n, pa.int64() if isinstance(kind, T.LongType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.string()) for n in names])
    return edges.select("a", "b").coalesce(1).mapInArrow(kernel, schema)


def _components(targets: dict) -> list[tuple]:
    root = {x: x for x in targets}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, own in targets.items():
        for b in own:
            a_root, b_root = find(a), find(b)
            root[max(a_root, b_root)] = min(a_root, b_root)
    return [(x, find(x)) for x in targets]


def _strong(targets: dict) -> list[tuple]:
    """Nodes in the order in which a walk leaves them, then walks against the edges from the last left on."""
    order, seen, sources = [], set(), {x: [] for x in targets}
    for a, own in targets.items():
        for b in own:
            sources[b].append(a)
    for start in targets:
        stack = [] if start in seen else [(start, iter(targets[start]))]
        seen.add(start)
        while stack:
            node, rest = stack[-1]
            if (b := next((b for b in rest if b not in seen), None)) is None:
                order.append(node)
                stack.pop()
            else:
                seen.add(b)
                stack.append((b, iter(targets[b])))
    out, seen = [], set()
    for start in reversed(order):
        group, stack = [], [] if start in seen else [start]
        seen.add(start)
        while stack:
            group.append(node := stack.pop())
            stack += [b for b in sources[node] if b not in seen]
            seen.update(sources[node])
        if len(group) > 1:
            least = min(group)
            out += [(x, least) for x in group]
    return out


def finish_components(edges: DataFrame) -> DataFrame:
    """(node, root) of undirected ``edges``."""
    return _finished(edges, ("node", "root"), _components)


def finish_strong(edges: DataFrame) -> DataFrame:
    """(node, component) of directed ``edges``, of nodes on a cycle."""
    return _finished(edges, ("node", "component"), _strong)
