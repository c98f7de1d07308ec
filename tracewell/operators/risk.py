"""Six-factor risk of clusters, persons of interest with hysteresis, screening and simulation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.scalar import clamp

#: Weights of label categories, behaviours, integration signals and factors; scores at which a person of interest enters and leaves.
LABELS = {
    "sanctioned": 1.00, "sanction": 1.00, "scam": 0.95, "fraud": 0.92, "mixer": 0.90, "mixing": 0.90, "darknet": 0.88, "ransomware": 0.88,
    "hack": 0.82, "exploit": 0.82, "high_risk": 0.75, "watchlist": 0.55, "exchange": 0.15, "merchant": 0.05, "unknown": 0.00,
}
BEHAVIOURS = {
    "loop_detection": 0.40, "coordinated_cashout": 0.40, "mixing_interaction": 0.35, "shell_wallet_network": 0.35, "bridge_hopping": 0.30, "peeling_chain": 0.30,
    "smurfing": 0.25, "structuring": 0.25, "high_depth_transaction_chaining": 0.25, "micro_funding": 0.15, "immediate_utilization": 0.10, "funneling": 0.10,
}
INTEGRATION = {"terminal_node": 0.30, "convergence": 0.25, "value_reaggregation": 0.20, "dormancy": 0.15, "asset_transformation": 0.10}
FACTORS = {"label": 0.25, "behavior": 0.20, "propagation": 0.15, "temporal": 0.10, "exposure": 0.10, "integration": 0.20}
ENTER, LEAVE, STRONG = 0.80, 0.70, 0.40


def weight_of(name: Column, weights: dict[str, float], other: Column | None = None) -> Column:
    """The weight of a name; of ``other`` if the name is unknown; else 0."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(table[name], *([table[other]] if other is not None else []), F.lit(0.0))


def label_score(labels: DataFrame) -> DataFrame:
    """(entity, label): the greatest weight of its labels (entity, category, and entity_type, which serves where the category is unknown)."""
    category = F.lower(F.coalesce("category", F.lit("")))
    other = F.lower(F.coalesce("entity_type", F.lit(""))) if "entity_type" in labels.columns else None
    return labels.groupBy("entity").agg(clamp(F.max(weight_of(category, LABELS, other))).alias("label"))


def behavior_score(found: DataFrame) -> DataFrame:
    """(entity, behavior): 1 - exp(-sum of weights), repeats counted."""
    total = F.sum(weight_of(F.col("behavior"), BEHAVIOURS).cast("decimal(9,4)")).cast("double")
    return found.groupBy("entity").agg(F.round(1 - F.exp(-total), 6).alias("behavior"))


def temporal_score(stats: DataFrame) -> DataFrame:
    """(entity, temporal) from (entity, tx_count, total, first_ts, last_ts): bursts by count and by value, the first match of each."""
    n, v, d = F.col("tx_count"), F.col("total"), F.col("last_ts") - F.col("first_ts")
    burst = F.when((n > 50) & (d < 3600), 0.25).when((n > 20) & (d < 1800), 0.15).when((n > 10) & (d < 3600), 0.10).otherwise(0.0)
    big = F.when((v > 10) & (d < 3600), 0.25).when((v > 5) & (d < 7200), 0.15).when((v > 1) & (d < 14400), 0.05).otherwise(0.0)
    return stats.select("entity", (burst + big).alias("temporal"))


def integration_score(signals: DataFrame, alias: bool = False) -> DataFrame:
    """(entity, integration) from (entity, signal, score). The detector's name ``reaggregation`` has no weight unless ``alias`` counts it as value_reaggregation."""
    name = F.when(F.lit(alias) & (F.col("signal") == "reaggregation"), "value_reaggregation").otherwise(F.col("signal"))
    part = (weight_of(name, INTEGRATION) * clamp(F.col("score"))).cast("decimal(12,6)")
    return signals.groupBy("entity").agg(clamp(F.sum(part).cast("double")).alias("integration"))


def total_risk(factors: DataFrame, weights: dict[str, float] = FACTORS) -> Column:
    return F.round(clamp(sum((F.coalesce(F.col(f), F.lit(0.0)) * w for f, w in weights.items()), F.lit(0.0))), 6)


def risk_scores(entities: DataFrame, *parts: DataFrame) -> DataFrame:
    """(entity, six factors, risk): a factor that no part gives is 0."""
    out = entities.select("entity").distinct()
    for p in parts:
        out = out.join(p, "entity", "left")
    own = {f: F.coalesce(F.col(f), F.lit(0.0)) if f in out.columns else F.lit(0.0) for f in FACTORS}
    out = out.select("entity", *[c.alias(f) for f, c in own.items()])
    return out.withColumn("risk", total_risk(out))


def poi_status(scored: DataFrame, prior: DataFrame) -> DataFrame:
    """(entity, risk, is_poi): enters at ENTER, stays to LEAVE, and needs two strong factors; ``prior``: (entity, was_poi)."""
    strong = sum(((F.col(f) >= STRONG).cast("int") for f in FACTORS), F.lit(0))
    kept = F.coalesce("was_poi", F.lit(False))
    on = F.when(F.col("risk") >= ENTER, True).when(F.col("risk") < LEAVE, False).otherwise(kept)
    return scored.join(prior, "entity", "left").select("entity", "risk", (on & (strong >= 2)).alias("is_poi"))


def poi_reason(scored: DataFrame) -> DataFrame:
    """(entity, reason): up to three factors over 0.10, the greatest first."""
    each = F.array(*[F.struct(F.col(f).alias("v"), F.lit(f).alias("name")) for f in FACTORS])
    top = F.slice(F.sort_array(F.filter(each, lambda x: x["v"] > 0.10), asc=False), 1, 3)
    return scored.select("entity", F.array_join(F.transform(top, lambda x: F.concat(x["name"], F.lit("="), F.format_number(x["v"], 2))), ", ").alias("reason"))


def simulate(scored: DataFrame, add_label: str | None = None, remove_label: bool = False, toggle_behavior: str | None = None, add_integration: str | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """(entity, risk, new_risk, difference, six factors anew, changed, would_be_poi, strong): what risks would be, with nothing stored.

    ``add_label`` raises the label factor to the label's weight, ``remove_label`` sets it to 0. ``toggle_behavior`` adds a behaviour's weight to the sum that the
    behaviour factor stands for, 1 - exp(-sum), turned round; a factor of 1 counts as a sum of 3. ``add_integration`` adds a signal's weight, 0.10 for an unknown one.
    ``weights`` replace those of FACTORS. changed maps factors to their change where it exceeds 0.001; would_be_poi needs ENTER and two strong factors.
    """
    new = {f: F.coalesce(F.col(f), F.lit(0.0)) for f in FACTORS}
    old = dict(new)
    if add_label:
        new["label"] = F.greatest(new["label"], F.lit(LABELS.get(add_label.lower(), 0.0)))
    if remove_label:
        new["label"] = F.lit(0.0)
    if toggle_behavior:
        held = F.when(old["behavior"] < 1.0, -F.log(F.greatest(1.0 - old["behavior"], F.lit(1e-9)))).otherwise(3.0)
        new["behavior"] = clamp(1.0 - F.exp(-(held + BEHAVIOURS.get(toggle_behavior, 0.0))))
    if add_integration:
        new["integration"] = clamp(old["integration"] + INTEGRATION.get(add_integration, 0.10))
    own = scored.select("entity", "risk", *[c.alias(f"new_{f}") for f, c in new.items()], *[c.alias(f"old_{f}") for f, c in old.items()])
    weight = {**FACTORS, **(weights or {})}
    total = clamp(sum((F.col(f"new_{f}") * weight[f] for f in FACTORS), F.lit(0.0)))
    strong = sum(((F.col(f"new_{f}") >= STRONG).cast("int") for f in FACTORS), F.lit(0))
    gap = {f: F.col(f"new_{f}") - F.col(f"old_{f}") for f in FACTORS}
    changed = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(f).alias("factor"), F.round(g, 4).alias("by")) for f, g in sorted(gap.items())]), lambda x: F.abs(x["by"]) > 0.001))
    new_risk = F.round(total, 4)
    return own.select(
        "entity", "risk", new_risk.alias("new_risk"), F.round(new_risk - F.col("risk"), 4).alias("difference"), *[F.round(f"new_{f}", 4).alias(f) for f in FACTORS], changed.alias("changed"), ((total >= ENTER) & (strong >= 2)).alias("would_be_poi"), strong.alias("strong")
    )


def audit_rows(simulated: DataFrame, override: str, user: str, at: Column) -> DataFrame:
    """(entity, action, override, current, simulated, user, at): the log entries of a simulation."""
    return simulated.select("entity", F.lit("simulate_risk").alias("action"), F.lit(override).alias("override"), F.round("risk", 4).alias("current"), F.col("new_risk").alias("simulated"), F.lit(user).alias("user"), at.alias("at"))


def audit_tail(log: DataFrame, most: int = 50) -> DataFrame:
    """The last ``most`` entries (at, ties: entity), numbered from the oldest of them on."""
    last = log.orderBy(F.desc("at"), F.desc("entity")).limit(most)
    return last.withColumn("place", F.row_number().over(Window.orderBy("at", "entity")))


def poi_history(scored: DataFrame) -> DataFrame:
    """(entity, at, risk, is_poi) after each of an entity's scores (entity, at, six factors, risk), in order of time.

    A score of ENTER or more with two strong factors makes a person of interest, one under LEAVE or without them ends that, one between keeps what was: the last score that
    decided. The window reads an entity's own scores only.
    """
    strong = sum(((F.col(f) >= STRONG).cast("int") for f in FACTORS), F.lit(0))
    decided = F.when((F.col("risk") < LEAVE) | (strong < 2), False).when(F.col("risk") >= ENTER, True)
    own = scored.withColumn("decided", decided)
    order = Window.partitionBy("entity").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return own.select("entity", "at", "risk", F.coalesce(F.last("decided", ignorenulls=True).over(order), F.lit(False)).alias("is_poi"))


def screen_over_time(transfers: DataFrame, entries: DataFrame) -> DataFrame:
    """(tx_hash, address, side) of transfers with an end on the watchlist when they happened: ``entries`` (address, added_at, expires_at), the last one added by then deciding.

    An entry of the same moment counts; one that has expired at the transfer's time gives no alert, nor does an older one that it replaced.
    """
    sides = [transfers.select("tx_hash", F.col(f"{s}_address").alias("address"), F.lit(s).alias("side"), F.col("ts").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("until")) for s in ("from", "to")]
    known = entries.select(F.lit(None).cast("string").alias("tx_hash"), "address", F.lit(None).cast("string").alias("side"), F.col("added_at").alias("at"), F.lit(0).alias("kind"), F.col("expires_at").alias("until"))
    order = Window.partitionBy("address").orderBy("at", "kind", "until").rowsBetween(Window.unboundedPreceding, 0)
    rows = sides[0].unionByName(sides[1]).unionByName(known).withColumn("until", F.last("until", ignorenulls=True).over(order))
    return rows.where("kind = 1 and until > at").select("tx_hash", "address", "side")


def screen(transfers: DataFrame, watchlist: DataFrame, now: float) -> DataFrame:
    """(tx_hash, address, side): up to two alerts a transfer, for entries (address, expires_at) still valid."""
    valid = watchlist.where(F.col("expires_at") > now).select("address").distinct()
    sides = [transfers.select("tx_hash", F.col(f"{s}_address").alias("address"), F.lit(s).alias("side")).join(valid, "address", "left_semi") for s in ("from", "to")]
    return sides[0].unionByName(sides[1]).select("tx_hash", "address", "side")


def feedback(placements: DataFrame, integration: DataFrame) -> DataFrame:
    """(entity, score, boost): strong integration scores raise a placement score by up to 0.15."""
    strong = integration.where("integration >= 0.6").select("entity", F.round(F.least(F.lit(0.15), 0.15 * F.col("integration")), 4).alias("boost"))
    return placements.join(strong, "entity").select("entity", F.round(F.least(F.lit(1.0), F.col("score") + F.col("boost")), 4).alias("score"), "boost")
