"""Public lists of flagged addresses, merged into one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The position that a sanction list's remarks begin at; columns that are read at most.
REMARKS, WIDTH = 11, 64
#: Points of an address on a sanction list; confidence in a report that states none.
SANCTION_SCORE, REPORT_CONFIDENCE = 95, 0.6
FLAGGED = ["chain", "address", "category", "source", "score", "label"]
EVM, COIN = "(0x[a-fA-F0-9]{40})", r"\b((?:bc1|[13])[a-zA-HJ-NP-Z0-9]{20,90})\b"


def read_sanctions(spark: SparkSession, path: str) -> DataFrame:
    """(name, program, remarks, addresses) of a CSV list without header: remarks are the cells from REMARKS on that aren't empty; rows of fewer than four cells go."""
    schema = ", ".join(f"c{k} string" for k in range(WIDTH))
    rows = spark.read.schema(schema).option("multiLine", True).option("escape", '"').csv(path)
    cells = F.filter(F.array(*[f"c{k}" for k in range(REMARKS, WIDTH)]), lambda c: F.coalesce(c, F.lit("")) != "")
    remarks = F.array_join(cells, " | ")
    found = F.array_distinct(F.concat(F.regexp_extract_all(remarks, F.lit(EVM)), F.regexp_extract_all(remarks, F.lit(COIN))))
    return rows.where("c3 is not null").select(F.col("c1").alias("name"), F.col("c3").alias("program"), remarks.alias("remarks"), found.alias("addresses"))


def flagged_table(sanctions: DataFrame, listed: DataFrame, reports: DataFrame) -> DataFrame:
    """The columns of FLAGGED, of sanctioned entries, ``listed`` ones (chain, address, category, source, score, label) and ``reports`` (address, category, source, confidence).

    A sanctioned address's chain goes by how it begins, a listed one without a chain holds for all of them, reports are of bitcoin. An address stands once for each
    entry that names it; its points add up where risk is counted.
    """
    address = F.col("address")
    chain = F.when(address.startswith("0x"), "ethereum").when(address.rlike("^(bc1|1|3)"), "bitcoin").otherwise("global")
    named = sanctions.select(F.explode("addresses").alias("address"), F.coalesce("name", F.lit("Unknown")).alias("label"))
    named = named.select(chain.alias("chain"), "address", F.lit("sanctioned").alias("category"), F.lit("OFAC").alias("source"), F.lit(SANCTION_SCORE).alias("score"), "label")
    known = listed.select(F.coalesce("chain", F.lit("global")).alias("chain"), "address", "category", "source", F.col("score").cast("int").alias("score"), "label")
    points = (F.coalesce("confidence", F.lit(REPORT_CONFIDENCE)) * 100).cast("int")
    told = reports.select(F.lit("bitcoin").alias("chain"), "address", "category", "source", points.alias("score"), F.lit(None).cast("string").alias("label"))
    return known.unionByName(named).unionByName(told)
