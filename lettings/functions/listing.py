"""Prices, dates, places and text of listings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper ends and labels of price buckets; a month's rent in weeks; bounds of a sound row.
PRICE_BUCKETS = ((2000, "< £2,000"), (3000, "£2,000-3,000"), (5000, "£3,000-5,000"), (7500, "£5,000-7,500"), (10000, "£7,500-10,000"), (15000, "£10,000-15,000"), (25000, "£15,000-25,000"))
TIERS = ((2000, "<£2k"), (3000, "£2-3k"), (5000, "£3-5k"), (10000, "£5-10k"))
PPSF_MIN, PPSF_MAX, RENT_MIN, RENT_MAX, SQFT_MIN, SQFT_MAX, SQFT_PER_BED = 3, 30, 500, 100000, 150, 10000, 70


def ppsf(price: Column, sqft: Column) -> Column:
    """Price per square foot; null where there is no size."""
    return price.cast("double") / F.nullif(sqft, F.lit(0))


def ladder(x: Column, steps: tuple[tuple[float, str], ...], top: str) -> Column:
    """The label of the first step that x lies under, else the top one."""
    out = F.when(x < steps[0][0], steps[0][1])
    for end, label in steps[1:]:
        out = out.when(x < end, label)
    return out.otherwise(top)


def price_bucket(price: Column) -> Column:
    return F.when(price.isNull() | (price <= 0), "Unknown").otherwise(ladder(price, PRICE_BUCKETS, "£25,000+"))


def tier(price: Column) -> Column:
    return ladder(price, TIERS, "£10k+")


def bedroom_label(beds: Column) -> Column:
    return F.when(beds == 0, "Studio").when(beds.between(1, 4), F.concat(beds.cast("string"), F.lit(" Bed"))).otherwise("5+ Bed")


def cut_right(x: Column, ends: tuple[float, ...]) -> Column:
    """Number of the bin (a, b] that x lies in; null outside."""
    out = F.when((x <= ends[0]), None)
    for i, end in enumerate(ends[1:]):
        out = out.when(x <= end, i)
    return out


def event_type(added: Column) -> Column:
    low = F.lower(added)
    return F.when(added.isNull(), None).when(F.contains(low, F.lit("reduced")), "reduced").when(F.contains(low, F.lit("added")), "added").otherwise("unknown")


def parse_added(added: Column, now: Column) -> Column:
    """The day that the text names: yesterday, today, or d/m/y; null if it names none."""
    low = F.lower(added)
    day = F.try_to_timestamp(F.nullif(F.regexp_extract(added, r"(\d{1,2}/\d{1,2}/\d{4})", 1), F.lit("")), F.lit("d/M/yyyy")).cast("date")
    return F.when(F.contains(low, F.lit("yesterday")), F.date_sub(now.cast("date"), 1)).when(F.contains(low, F.lit("today")), now.cast("date")).otherwise(day)


def days_on_market(since: Column, now: Column) -> Column:
    """Whole periods of 24 hours, 0 at least; null where the start isn't known."""
    passed = F.floor(F.timestamp_diff("SECOND", since, now) / 86400).cast("int")
    return F.when(passed.isNotNull(), F.greatest(F.lit(0), passed))


def weekly(pcm: Column) -> Column:
    return (pcm * 12 / 52).cast("int")


def monthly(pw: Column) -> Column:
    return (pw * 52 / 12).cast("int")


def clean_text(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def clean_price(x: Column) -> Column:
    return F.regexp_replace(x, r"[£,\s]", "").try_cast("int")


def haversine_m(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat) / 2) ** 2 + F.cos(F.radians(lat)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon) / 2) ** 2
    return F.atan2(F.sqrt(a), F.sqrt(1 - a)) * (2 * 6371000)


def let_type(x: Column) -> Column:
    low = F.lower(x)
    return F.when(F.contains(low, F.lit("short")), "short").when(F.contains(low, F.lit("long")), "long").otherwise("unknown")


def amenity_flags(x: Column) -> dict[str, Column]:
    low = F.lower(F.coalesce(x, F.lit("")))
    flag = lambda word: F.contains(low, F.lit(word)).cast("int")
    return {f"has_{w.replace(' ', '_')}": flag(w) for w in ("balcony", "garden", "lift", "porter", "parking", "roof terrace")}


#: Issues for which a listing is dropped even where others are let pass.
CRITICAL = ("missing source", "missing property_id", "missing url")


def issues(row: dict[str, Column]) -> Column:
    """What is wrong with a listing, as a list in the order of the rules; empty if nothing."""
    none = lambda c: F.coalesce(row[c], F.lit("")) == ""
    say = lambda before, c, after=")": F.concat(F.lit(before), row[c].cast("string"), F.lit(after))
    price, sqft = row["price_pcm"], row["size_sqft"]
    found = [
        F.when(none("source"), "missing source"),
        F.when(none("property_id"), "missing property_id"),
        F.when(F.coalesce(price, F.lit(0)) <= 0, F.lit("missing/invalid price_pcm")).when(price < 100, say("price_pcm too low (", "price_pcm")).when(price > 500000, say("price_pcm suspiciously high (", "price_pcm")),
        F.when(F.length(F.coalesce(row["address"], F.lit(""))) < 5, "missing/invalid address"),
        F.when(none("url"), F.lit("missing url")).when(~F.startswith(row["url"], F.lit("http")), F.concat(F.lit("invalid url format ("), F.substring(row["url"], 1, 30), F.lit("...)"))),
        F.when((row["bedrooms"] < 0) | (row["bedrooms"] > 20), say("invalid bedrooms (", "bedrooms")),
        F.when(sqft < 50, say("sqft too small (", "size_sqft")).when(sqft > 50000, say("sqft too large (", "size_sqft")),
    ]
    return F.array_compact(F.array(*found))


def acceptable(found: Column, strict: bool = False) -> Column:
    """Whether a listing with these issues is kept: without any, or, if not strict, without critical ones."""
    return F.size(found) == 0 if strict else ~F.arrays_overlap(found, F.array(*map(F.lit, CRITICAL)))


def sound(row: dict[str, Column]) -> Column:
    """Not masked by any of the seven quality rules."""
    rate = ppsf(row["price_pcm"], row["size_sqft"])
    beds = F.when(row["bedrooms"] == 0, 0.5).otherwise(row["bedrooms"])
    return row["size_sqft"].between(SQFT_MIN, SQFT_MAX) & (row["size_sqft"] / beds >= SQFT_PER_BED) & row["price_pcm"].between(RENT_MIN, RENT_MAX) & rate.between(PPSF_MIN, PPSF_MAX)
