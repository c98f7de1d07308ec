"""Scalar functions on columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def exact_sum(value: str | Column, scale: int = 2) -> Column:
    """A sum that does not depend on the order of rows."""
    value = F.col(value) if isinstance(value, str) else value
    return F.sum(value.cast(f"decimal(18,{scale})")).cast("double")


def stable_id(prefix: str, parts: Column) -> Column:
    """Prefix and the first twelve hex digits, upper case, of the SHA-1 of the sorted parts joined by ``|``."""
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha1(F.array_join(F.array_sort(parts), "|")), 1, 12)))


def risk_score(value: Column, threshold: float) -> Column:
    """0 for nothing, 75 at the threshold, 100 from twice the threshold on; one decimal."""
    ratio = value / threshold
    exact = lambda x: F.round(x.cast("decimal(18,6)"), 1).cast("double")
    return F.when(value <= 0, 0.0).when(ratio >= 2, 100.0).when(ratio >= 1, exact(75 + 25 * (ratio - 1))).otherwise(exact(75 * ratio))


def risk_label(score: Column) -> Column:
    return F.when(score > 75, "High").when(score > 40, "Medium").otherwise("Low")


def hex_to_long(x: Column) -> Column:
    """Hex or decimal text as a long; anything else is 0."""
    text = F.lower(F.trim(x))
    return F.coalesce(F.when(text.rlike("^0x[0-9a-f]{1,15}$"), F.conv(F.substring(text, 3, 16), 16, 10).cast("long")).otherwise(F.expr("null")), text.try_cast("long"), F.lit(0).cast("long"))


def wei_to_eth(wei: Column) -> Column:
    """Exact to 18 places, for amounts of up to 38 digits of wei text."""
    return (wei.try_cast("decimal(38,0)") * F.lit("0.000000000000000001").cast("decimal(18,18)")).cast("decimal(38,18)")


def is_address(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x)).rlike("^0x[0-9a-f]{40}$"), F.lit(False))


def chain_of(address: Column) -> Column:
    """Chain by the shape of an address."""
    return F.when(address.rlike("^0x[0-9a-fA-F]{40}$"), "ethereum").when(address.rlike("^(bc1|[13])[a-zA-HJ-NP-Z0-9]{25,59}$"), "bitcoin").when(address.rlike("^T[1-9A-HJ-NP-Za-km-z]{33}$"), "tron").when(address.rlike("^[1-9A-HJ-NP-Za-km-z]{32,44}$"), "solana").otherwise("unknown")


#: Words in a service's name or description that tell its category.
KEYWORDS = {
    "mixer": ["mixer", "mixing", "tornado", "privacy", "anonymity", "shielded", "stealth"],
    "bridge": ["bridge", "bridging", "portal", "router", "wormhole", "stargate", "across", "hop"],
    "exchange": ["exchange", "binance", "coinbase", "kraken", "okx", "bybit", "kucoin", "gate", "bitfinex", "huobi"],
}


def keyword_categories(text: Column) -> Column:
    """Sorted categories whose keywords a text contains."""
    low = F.lower(text)
    hit = {c: F.when(low.rlike("|".join(words)), F.lit(c)) for c, words in sorted(KEYWORDS.items())}
    return F.array_compact(F.array(*hit.values()))


#: Typographic characters and their ASCII forms.
ASCII = {"→": "->", "←": "<-", "—": "-", "–": "-", "…": "...", "“": '"', "”": '"', "‘": "'", "’": "'", " ": " "}


def _folded(c: str) -> str:
    return unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()


#: Characters whose compatibility decomposition has one ASCII character, or several.
ONE = [c for c in map(chr, range(0x80, 0x3400)) if len(_folded(c)) == 1]
SEVERAL = [c for c in map(chr, [*range(0x80, 0x2200), *range(0xFB00, 0xFB07)]) if len(_folded(c)) > 1]


def ascii_text(text: Column) -> Column:
    """Typographic characters replaced, others decomposed to their ASCII base (é to e, ﬁ to fi), the rest of non-ASCII dropped, spaces collapsed."""
    for a, b in ASCII.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    # few texts hold any of these
    spelled = text
    for c in SEVERAL:
        spelled = F.replace(spelled, F.lit(c), F.lit(_folded(c)))
    text = F.when(text.rlike("[" + "".join(SEVERAL) + "]"), spelled).otherwise(text)
    text = F.translate(text, "".join(ONE), "".join(map(_folded, ONE)))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\x00-\x7f]", ""), r"[ \t\n\r]+", " "))


def hex_id(x: Column) -> Column:
    """Lower-case hex text with 0x in front; null for anything that is no hex."""
    bare = F.regexp_replace(F.lower(F.trim(x)), "^0x", "")
    return F.when(bare.rlike("^[0-9a-f]+$"), F.concat(F.lit("0x"), bare))


def any_timestamp(x: Column) -> Column:
    """A time in UTC of epoch seconds, hex or decimal, or ISO text; null for anything else."""
    text = F.trim(x)
    number = F.when(text.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(text, 3, 15), 16, 10).cast("double")).when(text.rlike(r"^[0-9]{1,15}(\.[0-9]*)?$"), text.try_cast("double"))
    return F.coalesce(F.timestamp_seconds(number), F.try_to_timestamp(text))


#: Behaviours that reports leave out.
BANNED = ("funneling", "funnel", "immediate_utilization", "immediate-utilization", "immediate utilization")


def is_banned(behavior: Column) -> Column:
    return F.lower(F.trim(behavior)).isin(*BANNED)


def owner_addresses(addresses: Column) -> Column:
    """Lower-cased, trimmed, distinct addresses of an array in their order; an error for anything that is no address."""
    clean = F.array_distinct(F.filter(F.transform(addresses, lambda a: F.lower(F.trim(a))), lambda a: a != ""))
    bad = F.filter(clean, lambda a: ~a.rlike("^0x[0-9a-f]{40}$"))
    return F.when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("not an address: "), F.element_at(bad, 1)))).otherwise(clean)


def addresses_in(text: Column) -> Column:
    """Distinct addresses that a free text (or a list split by commas, spaces or line breaks) holds, lower-cased, in their order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\b(0x[0-9a-fA-F]{40})\b")), lambda a: F.lower(a)))


def iso_time(ts: Column) -> Column:
    """ISO text in UTC, to the second, of epoch seconds (the session's time zone is UTC); null for 0, less, or none."""
    return F.when(ts > 0, F.date_format(F.timestamp_seconds(F.floor(ts)), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))


def plain_amount(x: Column) -> Column:
    """A decimal as plain text, without exponent and trailing zeros."""
    text = F.regexp_replace(F.format_number(x, 18), ",", "")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


#: Chains whose addresses look like Ethereum's, and one address that tells its own.
EVM_CHAINS = ("ethereum", "bsc", "polygon", "avalanche", "fantom", "arbitrum", "optimism", "base", "celo", "gnosis", "cronos", "moonbeam", "metis", "kava", "sepolia")
GNOSIS_ADDRESS = "0x88ad09518695c6c3712ac10a214be5109a655671"


def detect_chain(address: Column, current: Column) -> Column:
    """The chain to look an address up on: Bitcoin by its form; of EVM form the current one if that is such a chain, else Ethereum; otherwise the current one."""
    a = F.trim(address)
    evm = F.when(F.lower(a) == GNOSIS_ADDRESS, "gnosis").when(current.isin(*EVM_CHAINS), current).otherwise("ethereum")
    return F.when(a.rlike("^(?:[13][a-km-zA-HJ-NP-Z1-9]{25,34}|bc1[ac-hj-np-z02-9]{11,71})$"), "bitcoin").when(a.rlike("^0x[a-fA-F0-9]{40}$"), evm).otherwise(current)
