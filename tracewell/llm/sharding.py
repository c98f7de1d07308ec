"""Shards in the order of a Hilbert curve over several columns, in DataFrame operations only.

Each column is quantised to cells of about equal counts, by a histogram of all rows. The cells of a row are a point of a
cube, and its index on the cube's Hilbert curve orders the rows: near rows of the curve are near in every column, so that a
stretch of them has narrow ranges in all columns and a reader's filter on any of them skips most files. The sorted rows are
numbered without a global window, by the row counts of the sorted partitions, and cut into shards.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.storage import fresh_path, materialise

#: Columns of ``documents`` that the curve runs over; bits a column.
COLUMNS, BITS = ("source", "lang", "n_chars", "doc_id"), 5
LAWS = ("rows", "bytes")


@cache
def curve_table(dims: int) -> tuple[int, list[int]]:
    """(s, table): ``table[(state << dims) + point]`` is ``(digit << s) + next state`` of the curve in ``dims`` dimensions.

    A state is the corner at which the curve enters a cube and the axis along which it leaves it. A digit counts the sub-cubes
    in the order of the Gray code, turned to that corner and axis.
    """
    full = (1 << dims) - 1

    def turned(x: int, by: int) -> int:
        by %= dims
        return (x << by | x >> (dims - by)) & full

    def gray(i: int) -> int:
        return i ^ i >> 1

    place = {gray(i): i for i in range(1 << dims)}
    enters = [0, *(gray((i - 1) // 2 * 2) for i in range(1, 1 << dims))]
    #: the axis that a sub-cube's own curve runs along: the lowest zero bit of i or of its predecessor
    ones = lambda i: (~i & i + 1).bit_length() - 1
    along = [0, *(ones(i if i % 2 else i - 1) % dims for i in range(1, 1 << dims))]
    s = (dims * (1 << dims) - 1).bit_length()
    table = [0] * (1 << s + dims)
    for corner in range(1 << dims):
        for axis in range(dims):
            for point in range(1 << dims):
                i = place[turned(point ^ corner, -(axis + 1))]
                state = (corner ^ turned(enters[i], axis + 1)) * dims + (axis + along[i] + 1) % dims
                table[(corner * dims + axis << dims) + point] = (i << s) + state
    return s, table


def curve_index(cells: list[Column], bits: int) -> Column:
    """The index on the Hilbert curve of the point ``cells``, each from 0 to 2**bits - 1."""
    dims = len(cells)
    s, table = curve_table(dims)
    if bits * dims + s > 62:
        raise ValueError("a curve index has at most 62 bits, with those of a state")
    right, left = (lambda x, k: F.call_function("shiftright", x, k)), F.shiftleft

    def step(acc: Column, k: Column) -> Column:
        point = sum((left(right(c, k).bitwiseAND(F.lit(1)), i) for i, c in enumerate(cells)), F.lit(0))
        return left(F.shiftright(acc, s), dims + s) + F.get(F.lit(table), left(acc.bitwiseAND(F.lit((1 << s) - 1)), dims).cast("int") + point)

    return F.shiftright(F.aggregate(F.lit([*range(bits - 1, -1, -1)]), F.lit(0).cast("long"), step), s)


def _div(a: Column, b: Column) -> Column:
    """The quotient of whole numbers of one sign, without its fraction."""
    return F.call_function("div", a, b)


def _number_bin(x: Column) -> Column:
    """An integer that grows with the whole number ``x``: 64 steps an octave."""
    size = F.abs(F.greatest(x, F.lit(-(2**63) + 1)))
    bits = F.length(F.bin(size))
    head = F.when(bits > 7, F.call_function("shiftright", size, bits - 7)).otherwise(F.call_function("shiftleft", size, 7 - bits))
    return (F.signum(x) * ((bits - 1) * 64 + head + 1)).cast("int")


def _bins(docs: DataFrame, columns: list[str]) -> list[Column]:
    """An integer for each column that grows with its value, with a bounded number of different ones; nulls come first.

    Numbers have 64 steps an octave. Words are told apart by the two bytes after what all values of the column begin with; those alike there share a bin, and so a cell.
    """
    kinds = {c: docs.schema[c].dataType for c in columns}
    words = [c for c in columns if not isinstance(kinds[c], T.NumericType)]
    own = {c: F.col(f"`{c}`").cast("string").cast("binary") for c in words}
    ends = docs.agg(*[f(own[c]).alias(f"{n}{i}") for i, c in enumerate(words) for n, f in (("a", F.min), ("b", F.max))]).first() if words else None
    out = []
    for c in columns:
        if c not in own:
            out.append(_number_bin(F.col(f"`{c}`").try_cast("long")))
            continue
        a, b = (bytes(ends[f"{n}{words.index(c)}"] or b"") for n in "ab")
        # two bytes after what all values begin with
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        out.append(F.conv(F.rpad(F.hex(F.substring(own[c], same + 1, 2)), 4, "0"), 16, 10).cast("int"))
    return [F.coalesce(x, F.lit(-(2**31))) for x in out]


def cell_columns(docs: DataFrame, columns: list[str], bits: int) -> list[Column]:
    """For each column the cell, 0 to 2**bits - 1, of a row's value: the share of all rows with a lesser bin, in steps.

    The histogram counts all rows and has a bounded number of bins; at most 2**bits limits a column come to the driver.
    """
    bins = _bins(docs, columns)
    pairs = docs.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), b.alias("bin")) for i, b in enumerate(bins)])).alias("x"))
    counts = pairs.groupBy("x.i", "x.bin").agg(F.count("*").alias("n"))
    each = Window.partitionBy("i")
    before = counts.withColumn("before", F.sum("n").over(each.orderBy("bin")) - F.col("n")).withColumn("all", F.sum("n").over(each))
    limits = before.groupBy("i", _div(F.col("before") * (1 << bits), F.col("all")).alias("cell")).agg(F.min("bin").alias("least")).collect()
    out = []
    for i, b in enumerate(bins):
        cell = None
        for r in sorted((r for r in limits if r["i"] == i and r["cell"]), key=lambda r: -r["cell"]):
            cell = F.when(b >= r["least"], r["cell"]) if cell is None else cell.when(b >= r["least"], r["cell"])
        out.append(F.lit(0) if cell is None else cell.otherwise(0))
    return out


def _free(name: str, docs: DataFrame) -> str:
    """``name``, with underscores as long as ``docs`` has such a column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def write_shards(docs: DataFrame, shards: int = 8, law: str = "rows", columns: tuple[str, ...] = COLUMNS, bits: int = BITS, path: str | None = None) -> tuple[DataFrame, str, str]:
    """Write ``docs`` as Parquet folders ``shard=0`` and so on in ``path`` (a new shared folder by default); (the table read back, name of its shard column, of its slot column).

    Law ``rows``: counts of shards differ by one at most. Law ``bytes``: shards are cut where the running size (UTF-8 bytes of text plus 1) passes a
    multiple of the mean, so that a shard differs from it by at most its largest text. Shards are successive stretches of the curve, and the files of
    a shard successive stretches of the shard. Rows of one cell come by doc_id, CRC-32 and size of the text, null ids first; rows equal in these
    stay in one stretch, in any order. Nulls have a cell of their own before others, null texts size 1; very long texts are moved whole; repeated rows are
    rows; an empty table gives no rows. Columns of ``docs`` with the names ``shard`` or ``slot`` keep them: an underscore is added to the new ones. A hot
    value fills cells of its own, which are ordered by the other columns and by doc_id, and so dealt to any number of partitions.
    """
    if law not in LAWS:
        raise ValueError(f"law must be one of {LAWS}")
    shard, slot, at, size = (_free(n, docs) for n in ("shard", "slot", "curve_at", "curve_size"))
    text = F.col("text").cast("string")
    index = curve_index(cell_columns(docs, list(columns), bits), bits)
    keyed = docs.select("*", index.alias(at), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias(size))
    keys = [F.col(at), F.col("doc_id").asc_nulls_first(), F.col(size), _size(text)]
    ordered = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # the number of the sorted partition, and above 0 the place in it
    runs = materialise(ordered.withColumn(at, F.monotonically_increasing_id()).withColumn(size, _size(text)), "curve-runs")
    run, place = F.shiftright(at, 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    counts = materialise(runs.groupBy(run.alias("run")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")), "run-counts")
    n, total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    # one row a partition of the sort
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("run").alias("o_run"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o_rows"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("o_bytes"))
    met = runs.join(F.broadcast(starts), run == F.col("o_run")).withColumn("o_rank", F.col("o_rows") + place)
    if law == "rows":
        met = met.withColumn("o_shard", _div(F.col("o_rank") * shards, F.lit(max(n, 1)))).withColumn("o_first", _div(F.col("o_shard") * n + shards - 1, F.lit(shards)))
    else:
        within = Window.partitionBy("o_run").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        met = met.withColumn("o_begin", F.col("o_bytes") + F.coalesce(F.sum(size).over(within), F.lit(0)))
        met = materialise(met.withColumn("o_shard", F.least(_div(F.col("o_begin") * shards, F.lit(max(total, 1))), F.lit(shards - 1))), "curve-bytes")
        met = met.join(F.broadcast(met.groupBy("o_shard").agg(F.min("o_rank").alias("o_first"))), "o_shard")
    out = met.select(*[F.col(f"`{c}`") for c in docs.columns], (F.col("o_rank") - F.col("o_first")).cast("long").alias(slot), F.col("o_shard").cast("int").alias(shard))
    path = path or fresh_path(docs.sparkSession, "shards")
    out.sortWithinPartitions(shard, slot).write.option("compression", "zstd").partitionBy(shard).parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path), shard, slot


def shard_digests(docs: DataFrame, shards: int = 8, law: str = "rows", columns: tuple[str, ...] = COLUMNS, bits: int = BITS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row of the shards that ``write_shards`` writes; all cases as there."""
    table, shard, slot = write_shards(docs, shards, law, columns, bits)
    text = F.col("text").cast("string")
    return table.select(
        F.col("doc_id").cast("long").alias("doc_id"), _size(text).alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"), F.lit(law).alias("law"),
        F.col(shard).alias("shard"), F.col(slot).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _sql(columns: tuple[str, ...] = COLUMNS, bits: int = BITS, words: tuple[str, ...] = ("source", "lang")) -> str:
    """The statement of ``shard_digests`` for law ``rows`` and 8 shards."""
    dims, (s, table) = len(columns), curve_table(len(columns))
    bins = {c: f"CASE WHEN {c} IS NULL THEN -2147483648 ELSE sign({c}) * ((len(bin(abs({c}))) - 1) * 64 + CASE WHEN len(bin(abs({c}))) > 7 THEN abs({c}) >> (len(bin(abs({c}))) - 7) ELSE abs({c}) << (7 - len(bin(abs({c})))) END + 1) END" for c in columns}
    bins |= {c: f"CASE WHEN {c} IS NULL THEN -2147483648 ELSE ('0x' || rpad(substr(hex(encode({c})), 1 + 2 * (SELECT same FROM alike WHERE c = '{c}'), 4), 4, '0'))::BIGINT END" for c in words}
    alike = " UNION ALL ".join(f"SELECT '{c}' AS c, (SELECT max(k) FROM range(0, 200) r(k) WHERE 2 * k <= least(len(a), len(b)) AND substr(a, 1, 2 * k) = substr(b, 1, 2 * k)) AS same FROM (SELECT hex(encode(min({c}))) AS a, hex(encode(max({c}))) AS b FROM documents)" for c in words)
    counted = " UNION ALL ".join(f"SELECT {i} AS i, b{i} AS bin, count(*) AS n FROM own GROUP BY ALL" for i in range(dims))
    cells = " ".join(f"ASOF LEFT JOIN (SELECT bin AS at{i}, cell AS c{i} FROM cells WHERE i = {i}) x{i} ON own.b{i} >= x{i}.at{i}" for i in range(dims))
    point = lambda k: " + ".join(f"(((c{i} >> {k}) & 1) << {i})" for i in range(dims))
    walk = "0::BIGINT"
    steps = []
    for k in range(bits - 1, -1, -1):
        steps.append(f"w{k} AS (SELECT *, ((({walk}) >> {s}) << {dims + s}) + t[((({walk}) & {(1 << s) - 1}) << {dims}) + {point(k)} + 1] AS a{k} FROM {f'w{k + 1}' if steps else 'placed, curve'})")
        walk = f"a{k}"
    return f"""
WITH RECURSIVE alike AS ({alike}),
own AS (SELECT doc_id, text, {", ".join(f"{bins[c]} AS b{i}" for i, c in enumerate(columns))} FROM documents),
counted AS ({counted}),
cells AS (SELECT i, bin, (before * {1 << bits} // total)::BIGINT AS cell FROM (SELECT i, bin, sum(n) OVER (PARTITION BY i ORDER BY bin) - n AS before, sum(n) OVER (PARTITION BY i) AS total FROM counted)),
limits AS (SELECT i, cell, min(bin) AS bin FROM cells GROUP BY ALL),
placed AS (SELECT own.*, {", ".join(f"c{i}" for i in range(dims))} FROM own {cells.replace("FROM cells", "FROM limits")}),
curve AS (SELECT {table} AS t),
{", ".join(steps)},
crc_steps AS (SELECT b, 0 AS k, b AS c FROM range(0, 256) r(b) UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS u FROM crc_steps WHERE k = 8),
hashed AS (SELECT doc_id, a0 >> {s} AS h, strlen(coalesce(text, ''))::BIGINT + 1 AS size,
                  xor(4294967295, list_reduce([('0x' || y)::BIGINT FOR y IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')], lambda c, b: xor(c >> 8, u[(xor(c, b) & 255) + 1]), 4294967295)) AS text_crc32
           FROM w0, crc),
ranked AS (SELECT *, row_number() OVER (ORDER BY h, doc_id NULLS FIRST, text_crc32, size) - 1 AS r, count(*) OVER () AS n FROM hashed)
SELECT doc_id, size, text_crc32, 'rows' AS law, (r * 8 // n)::INT AS shard, (r - ((r * 8 // n) * n + 7) // 8)::BIGINT AS slot, NULL::INT AS grown_shard FROM ranked
"""


SQL = _sql()
