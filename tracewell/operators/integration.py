"""Integration signals of addresses: where funds end, rest, gather and come together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.config import EngineConfig
from tracewell.functions.scalar import clamp, exact_sum

#: Address prefixes of known exits, lower case.
EXITS = ("0xd551234", "0xa9d1e08", "0x3f5ce5f", "0xbe0eb53", "0x564286", "0x4e9ce36")


def _four(x) -> F.Column:
    return F.round(x, 4)


def convergence(transfers: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Many distinct senders."""
    own = transfers.groupBy(F.col("to_address").alias("address")).agg(F.countDistinct("from_address").alias("n"), exact_sum("value").alias("total")).where(F.col("n") >= cfg.convergence_senders)
    score = 0.6 * clamp(F.col("n") / 15.0) + 0.4 * clamp(F.col("total") / 50.0)
    return own.select("address", F.lit("convergence").alias("signal"), _four(score).alias("score")).where("score >= 0.3")


def dormancy(transfers: DataFrame, cfg: EngineConfig) -> DataFrame:
    """A long silence before outgoing transfers, then activity: the first longest gap counts."""
    seen = transfers.groupBy(F.col("to_address").alias("address")).agg(F.min("ts").alias("t")).unionByName(transfers.groupBy(F.col("from_address").alias("address")).agg(F.min("ts").alias("t")))
    seen = seen.groupBy("address").agg(F.min("t").alias("first_seen"))
    w = Window.partitionBy("address").orderBy("ts", "tx_hash")
    out = transfers.select(F.col("from_address").alias("address"), "ts", "tx_hash", "value").join(seen, "address")
    out = out.withColumn("gap", F.col("ts") - F.coalesce(F.lag("ts").over(w), F.col("first_seen"))).withColumn("k", F.row_number().over(w))
    top = out.withColumn("r", F.row_number().over(Window.partitionBy("address").orderBy(F.desc("gap"), "k"))).where("r = 1").where(F.col("gap") >= cfg.dormancy_seconds)
    after = out.select("address", "k", "value").join(top.select("address", F.col("k").alias("k0"), "gap"), "address").where("k >= k0 and k < k0 + 3")
    woken = after.groupBy("address").agg(F.max("gap").alias("gap"), exact_sum("value").alias("v")).where(F.col("v") >= cfg.activation_value)
    score = 0.55 * clamp(F.col("gap") / 86400 / 90) + 0.45 * clamp(F.col("v") / 10)
    return woken.select("address", F.lit("dormancy").alias("signal"), _four(score).alias("score")).where("score >= 0.3")


def terminal_node(transfers: DataFrame, cfg: EngineConfig, exits: tuple[str, ...] = EXITS) -> DataFrame:
    """Receives and never sends; addresses that begin with one of ``exits`` score more."""
    into = transfers.groupBy(F.col("to_address").alias("address")).agg(exact_sum("value").alias("total")).where("total >= 0.01")
    ends = into.join(transfers.where("value > 0").select(F.col("from_address").alias("address")).distinct(), "address", "left_anti")
    known = F.lower(F.trim("address")).rlike("^(" + "|".join(exits) + ")")
    score = 0.7 * F.when(known, 0.85).otherwise(0.5) + 0.3 * clamp(F.col("total") / 20)
    return ends.select("address", F.lit("terminal_node").alias("signal"), _four(score).alias("score")).where("score >= 0.35")


def reaggregation(transfers: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Many inputs that leave as fewer, larger outputs."""
    positive = F.avg(F.when(F.col("value") > 0, F.col("value").cast("decimal(18,2)"))).cast("double")
    into = transfers.groupBy(F.col("to_address").alias("address")).agg(F.count("*").alias("n"), exact_sum("value").alias("total_in"), positive.alias("avg_in"))
    out = transfers.groupBy(F.col("from_address").alias("address")).agg(exact_sum("value").alias("total_out"), positive.alias("avg_out"))
    both = into.join(out, "address").withColumn("ratio", F.col("total_out") / F.greatest("total_in", F.lit(1e-9)))
    both = both.where((F.col("n") >= cfg.reaggregation_inputs) & (F.col("total_in") >= 0.1) & (F.col("total_out") >= 0.1) & (F.col("ratio") >= cfg.reaggregation_ratio) & (F.col("avg_out") > F.col("avg_in")))
    growth = (F.col("avg_out") - F.col("avg_in")) / F.greatest("avg_in", F.lit(0.001)) / 10
    score = 0.35 * clamp(F.col("n") / 16.0) + 0.40 * clamp((F.col("ratio") - 0.7) / 0.3) + 0.25 * clamp(growth)
    return both.select("address", F.lit("reaggregation").alias("signal"), _four(score).alias("score")).where("score >= 0.3")


SIGNALS = (convergence, dormancy, terminal_node, reaggregation)


def alerts(transfers: DataFrame, cfg: EngineConfig, upstream: DataFrame | None = None) -> DataFrame:
    """(address, score, confidence, n_signals, signals) from all signals; ``upstream``: (address, layering, placement) scores."""
    fired = reduce(DataFrame.unionByName, [f(transfers, cfg) for f in SIGNALS])
    own = fired.groupBy("address").agg(F.avg("score").alias("mean"), F.max("score").alias("confidence"), F.count("*").alias("k"), F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("signals"))
    bonus = F.lit(0.0)
    if upstream is not None:
        own = own.join(upstream, "address", "left")
        bonus = F.when(F.col("layering") > 0.5, 0.10).otherwise(0.0) + F.when(F.col("placement") > 0.5, 0.05).otherwise(0.0)
    score = _four(clamp(F.col("mean") + F.least(F.lit(0.30), 0.15 * (F.col("k") - 1)) + bonus))
    return own.select("address", score.alias("score"), "confidence", F.col("k").alias("n_signals"), "signals").where("score >= 0.35")
