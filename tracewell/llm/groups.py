"""Groups of alike items that meet in buckets, without comparing all pairs of a large bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.components import connected_components
from tracewell.llm.storage import materialise

#: Rounds of one item a bucket against its others; pairs an item up to which all are compared at once; members a block of a bucket.
STARS, FEW, BLOCK = 4, 2, 256
#: Parts into which the pairs of one item are dealt.
PAIR_SALTS = 64


def judged_pairs(pairs: DataFrame, items: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``kernel`` over rows (a, b, item_a, item_b) of the distinct ``pairs`` (a, b), with the items (cid, item) of both; rows of one ``a`` come together."""
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(PAIR_SALTS)).alias("salt"))
    left = salted.select("a", "salt").distinct().join(items.select(F.col("cid").alias("a"), F.col("item").alias("item_a")), "a")
    right = salted.join(items.select(F.col("cid").alias("b"), F.col("item").alias("item_b")), "b")
    # the side with one row a key comes second, as that is the side a sort-merge join holds in memory
    return right.join(left, ["a", "salt"]).select("a", "b", "item_a", "item_b").mapInArrow(kernel, schema)


def _may_meet(allowed: Callable[[str, str], Column]) -> Column:
    return (F.col("a_asks") | F.col("b_asks")) & (F.col("a_root") != F.col("b_root")) & allowed("a_size", "b_size")


def _as(side: str, *names: str) -> list[Column]:
    return [F.col(c).alias(f"{side}_{c}") for c in names]


MEMBER = ("cid", "size", "asks", "root")


def bucket_pairs(members: DataFrame, allowed: Callable[[str, str], Column], block: int = BLOCK) -> DataFrame:
    """Distinct pairs (a, b) of the ``members`` (key, cid, size, asks, root) of each bucket that may meet.

    Buckets of over ``block`` members are cut into blocks, and every two blocks of a bucket meet as a group of their own.
    """
    parts = members.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    cut = members.join(parts, "key").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    met = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    first = met.where("own <= other").select("key", F.col("own").alias("x"), F.col("other").alias("y"), *_as("a", *MEMBER))
    second = met.where("other <= own").select("key", F.col("other").alias("x"), F.col("own").alias("y"), *_as("b", *MEMBER))
    pairs = first.join(second, ["key", "x", "y"]).where(((F.col("x") < F.col("y")) | (F.col("a_cid") < F.col("b_cid"))) & _may_meet(allowed))
    return pairs.select(F.least("a_cid", "b_cid").alias("a"), F.greatest("a_cid", "b_cid").alias("b")).distinct()


def group_links(
    shared: DataFrame, judge: Callable[[DataFrame], DataFrame], allowed: Callable[[str, str], Column], rest: Callable[[DataFrame], DataFrame] | None = None, stars: int = STARS, few: int = FEW, block: int = BLOCK, known: DataFrame | None = None
) -> DataFrame:
    """Edges (a, b) that connect just the groups which the alike pairs among the members of each bucket make.

    ``shared``: (key, cid long, size, asks boolean) of the buckets with more than one member; two members meet if one of
    them asks and ``allowed`` holds for their sizes. ``judge`` keeps the alike ones of distinct pairs (a, b). In each round every
    bucket compares the asking member that shares most buckets with its others and leaves it out; what is in one group by now
    needs no comparison, so a bucket of one group is done after one row a member. When the buckets not
    done have at most ``few`` pairs a member, or after ``stars`` rounds, all their pairs of different groups
    are compared, whatever the number; after ``stars`` rounds, only those that ``rest`` makes of the members (cid, size, root)
    if it is given, which must be all that can be alike. ``known``: alike pairs (a, b) found before, whose groups hold from the first round.
    """
    links, judged = known, None
    roots = None if known is None else connected_components(known)
    # what others are copies of shares most buckets with them
    left = shared.join(shared.groupBy("cid").agg(F.count("*").alias("weight")), "cid")
    for turn in range(stars + 1):
        named = left.withColumn("root", F.col("cid")) if roots is None else left.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", "size", "asks", "weight", F.coalesce("root", "cid").alias("root"))
        ask = F.count(F.when(F.col("asks"), 1))
        open_ = named.groupBy("key").agg(F.count("*").alias("n"), ask.alias("q"), F.min("root").alias("low"), F.max("root").alias("high"), F.max_by("cid", F.when(F.col("asks"), F.struct("weight", "cid"))).alias("hub"))
        open_ = materialise(open_.where("low <> high and q > 0").select("key", "n", "q", "hub"), "open-buckets")
        n, most = open_.agg(F.sum("n"), F.sum(F.col("q") * F.col("n") - F.col("q") * (F.col("q") + 1) / 2)).first()
        if not n:
            break
        members = materialise(named.join(open_.select("key", "hub"), "key"), "open-members")
        last = turn == stars or most <= few * n
        if last and rest and most > few * n:
            pairs = rest(members.select("cid", "size", "root").distinct())
        elif last:
            pairs = bucket_pairs(members.select("key", *MEMBER), allowed, block)
        else:
            hubs = members.where("cid = hub").select("key", *_as("b", *MEMBER))
            met = members.where("cid <> hub").select("key", "hub", *_as("a", *MEMBER)).join(hubs, "key")
            pairs = met.where(_may_meet(allowed)).select(F.least("hub", "a_cid").alias("a"), F.greatest("hub", "a_cid").alias("b")).distinct()
            left = members.where("cid <> hub").select("key", "cid", "size", "asks", "weight")
        if judged is not None:
            pairs = pairs.join(judged, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        found = materialise(judge(pairs), "links")
        links = found if links is None else links.unionByName(found)
        judged = pairs if judged is None else judged.unionByName(pairs)
        if last:
            break
        roots = connected_components(links)
    return judge(shared.select(F.col("cid").alias("a"), F.col("cid").alias("b")).where("false")) if links is None else links
