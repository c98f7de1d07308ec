"""Joins that Spark has no operator for, from equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, width: float, how: str = "inner", also: Column | None = None) -> DataFrame:
    """Rows of equal ``keys`` with left_ts <= right_ts <= left_ts + width, as an equi-join on time buckets of that width.

    The columns of both sides, but for ``keys``, must differ. A left row meets its own bucket and the next.
    """
    a = left.withColumn("_b", F.floor(F.col(left_ts) / width)).withColumn("_b", F.explode(F.array("_b", F.col("_b") + 1)))
    b = right.withColumn("_b", F.floor(F.col(right_ts) / width))
    near = (F.col(right_ts) >= F.col(left_ts)) & (F.col(right_ts) <= F.col(left_ts) + width)
    on = [a[k] == b[k] for k in [*keys, "_b"]] + [near] + ([also] if also is not None else [])
    joined = a.join(b, on, how)
    return joined.drop(a["_b"]) if how == "left_semi" else joined.drop(a["_b"], b["_b"], *[b[k] for k in keys])


def pairs_within(groups: DataFrame, key: list[str], member: str, least: int = 2, most: int | None = None) -> DataFrame:
    """Distinct (a, b), a < b, of ``member`` values that share a ``key`` whose group has ``least`` to ``most`` members.

    Group sizes are counted first, so groups over the cap never meet the self-join.
    """
    own = groups.select(*key, F.col(member).alias("_m")).distinct()
    size = own.groupBy(*key).agg(F.count("*").alias("_n"))
    fits = (F.col("_n") >= least) & (F.lit(True) if most is None else F.col("_n") <= most)
    own = own.join(size.where(fits).select(*key), key, "left_semi")
    other = own.withColumnRenamed("_m", "b")
    return own.withColumnRenamed("_m", "a").join(other, key).where("a < b").select("a", "b").distinct()


def similar(a: Column, b: Column, ratio: float, tolerance: float = 0.0) -> Column:
    """Amounts alike: both not negative and apart by at most the tolerance or a share of the larger."""
    return (a >= 0) & (b >= 0) & (F.abs(a - b) <= F.greatest(F.lit(tolerance), F.greatest(a, b, F.lit(1e-9)) * ratio))
