"""Which addresses and methods belong to services: from profiles and from what owner lists say."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalar import KEYWORDS

#: Profiles as nested JSON: category -> addresses, category -> method ids, category -> more keywords.
PROFILE = "addresses map<string, array<string>>, methods map<string, array<string>>, keywords map<string, array<string>>"
#: What of an owner is searched for keywords.
OWNER_TEXT = ("full_name", "entity_type", "list_category", "specifics", "source_reference", "notes")


def _folded(x: Column) -> Column:
    return F.lower(F.trim(x))


def profile_entries(profiles: DataFrame, part: str, name: str) -> DataFrame:
    """(``name``, category) of one part of PROFILE rows, lower-cased and trimmed, without empty and null ones."""
    listed = profiles.select(F.explode(part).alias("category", "entries")).select("category", F.explode("entries").alias("entry"))
    return listed.select(_folded(F.col("entry")).alias(name), "category").where(F.coalesce(name, F.lit("")) != "").distinct()


def service_keywords(profiles: DataFrame) -> DataFrame:
    """(keyword, category): the fixed ones and those of the profiles; a profile may bring a new category."""
    fixed = [(w, c) for c, words in KEYWORDS.items() for w in words]
    return profiles.sparkSession.createDataFrame(fixed, "keyword string, category string").unionByName(profile_entries(profiles, "keywords", "keyword")).distinct()


def classified_owners(owners: DataFrame, keywords: DataFrame) -> DataFrame:
    """(address, category) of owners (address, and those of OWNER_TEXT that there are) whose texts contain a keyword.

    The keywords are a profile's, a short list of its author's, and make one array a category; each owner's text is searched once.
    """
    text = F.lower(F.concat_ws(" ", *[F.col(c) for c in OWNER_TEXT if c in owners.columns]))
    lists = keywords.groupBy("category").agg(F.collect_set("keyword").alias("words")).agg(F.collect_list(F.struct("category", "words")).alias("lists"))
    own = owners.select(_folded(F.col("address")).alias("address"), text.alias("text")).where(F.coalesce("address", F.lit("")) != "")
    hit = F.filter("lists", lambda x: F.exists(x["words"], lambda w: F.col("text").contains(w)))
    return own.crossJoin(F.broadcast(lists)).select("address", F.explode(F.transform(hit, lambda x: x["category"])).alias("category")).distinct()


def service_registry(profiles: DataFrame, owners: DataFrame, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((address, category), (method_id, category)) of all services.

    Addresses are those of the profiles and those of owners whose texts hold a keyword. ``overrides`` (address, category) take the place of both for the addresses they
    name; a null category takes an address out.
    """
    addresses = profile_entries(profiles, "addresses", "address").unionByName(classified_owners(owners, service_keywords(profiles))).distinct()
    if overrides is not None:
        said = overrides.select(_folded(F.col("address")).alias("address"), "category")
        addresses = addresses.join(said.select("address").distinct(), "address", "left_anti").unionByName(said.where("category is not null").distinct())
    return addresses, profile_entries(profiles, "methods", "method_id")


def read_profiles(spark, path: str) -> DataFrame:
    """PROFILE rows of one or several JSON files, each a whole document; broken files give none."""
    return spark.read.schema(PROFILE).option("multiLine", True).json(path).where(reduce(Column.__or__, [F.col(c).isNotNull() for c in ("addresses", "methods", "keywords")]))


def service_transfers(transfers: DataFrame, addresses: DataFrame, methods: DataFrame) -> DataFrame:
    """(tx_hash, category, via): transfers to or from a service address, or with a method of a service."""
    side = lambda c, via: transfers.select("tx_hash", F.lower(c).alias("address")).join(addresses, "address").select("tx_hash", "category", F.lit(via).alias("via"))
    by_method = transfers.select("tx_hash", F.lower("method_id").alias("method_id")).join(methods, "method_id").select("tx_hash", "category", F.lit("method").alias("via"))
    return side("from_address", "from").unionByName(side("to_address", "to")).unionByName(by_method).distinct()
