"""What the texts of listings say: amenities, floors, furnishing, prices, sizes; and agents' and types' common names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A pattern for each amenity; names of agencies with the words that tell them; brands; types of property; districts of areas.
AMENITIES = {
    "has_balcony": r"\bbalcon",
    "has_terrace": r"\bterrace\b",
    "has_roof_terrace": r"roof\s*terrace",
    "has_garden": r"\bgarden\b",
    "has_ac": r"air[\s-]*condition|a/c\b|\bac\b|aircon|air con",
    "has_underfloor_heating": r"underfloor\s*heat",
    "has_high_ceilings": r"high\s*ceiling|double[\s-]*height|lofty\s*ceiling|tall\s*ceiling",
    "has_floor_to_ceiling": r"floor[\s-]*to[\s-]*ceiling|full[\s-]*height\s*window",
    "has_lift": r"\blift\b|\belevator\b|\bwith lift\b",
    "has_porter": r"\bporter|concierge|24[\s-]*hour|24hr\s*security",
    "has_gym": r"\bgym\b|fitness|leisure\s*suite",
    "has_pool": r"\bpool\b|swimming",
    "has_parking": r"\bparking\b|\bgarage\b|car\s*space",
    "is_luxury": r"\bluxur|premium|exclusive|prestigious|stunning|magnificent",
    "is_refurbished": r"refurbish|renovate|newly\s*decorated|recently\s*refurb",
    "is_period": r"period\s*(property|build|feature)",
    "is_modern": r"\bmodern\b",
}
OUTDOOR = ("has_balcony", "has_terrace", "has_roof_terrace", "has_garden")
AGENCIES = (
    ("Foxtons", ("foxtons",)), ("Chestertons", ("chestertons",)), ("Knight Frank", ("knight frank",)), ("Savills", ("savills",)), ("Hamptons", ("hamptons",)),
    ("Marsh & Parsons", ("marsh & parsons", "marsh and parsons")), ("Dexters", ("dexters",)), ("John D Wood", ("john d wood",)), ("Winkworth", ("winkworth",)),
    ("Strutt & Parker", ("strutt & parker", "strutt and parker")), ("Carter Jonas", ("carter jonas",)), ("JLL", ("jll",)), ("CBRE", ("cbre",)), ("Cluttons", ("cluttons",)),
    ("Harrods Estates", ("harrods estates",)), ("Sothebys", ("sotheby",)), ("KFH", ("kfh",)), ("Domus Nova", ("domus nova",)), ("OpenRent", ("openrent",)), ("Hunters", ("hunters",)),
    ("Connells", ("connells",)), ("Barnard Marcus", ("barnard marcus",)), ("Felicity J Lord", ("felicity j lord",)), ("Benham & Reeves", ("benham & reeves", "benham and reeves")),
    ("Chancellors", ("chancellors",)), ("Portico", ("portico",)), ("Lurot Brand", ("lurot brand",)), ("Russell Simpson", ("russell simpson",)), ("Aylesford", ("aylesford",)),
    ("Arlington Residential", ("arlington residential",)), ("Aston Chase", ("aston chase",)), ("Beauchamp Estates", ("beauchamp",)), ("W.A. Ellis", ("w.a. ellis", "wa ellis")), ("GPE", ("gpe",)),
    ("Landlord Sales Agency", ("landlord sales",)), ("RR Properties", ("rr properties",)), ("City Relay", ("city relay",)), ("Landstones", ("landstones",)), ("Eson2", ("eson2",)),
)
COMPETITORS = (
    ("Chestertons", ("chestertons",)), ("Foxtons", ("foxtons",)), ("Knight Frank", ("knight frank",)), ("Savills", ("savills",)), ("Hamptons", ("hamptons",)), ("Marsh & Parsons", ("marsh & parsons",)),
    ("Dexters", ("dexters",)), ("John D Wood", ("john d wood",)), ("Winkworth", ("winkworth",)), ("KFH", ("kfh",)), ("JLL", ("jll",)), ("Strutt & Parker", ("strutt & parker",)),
    ("Sothebys", ("sotheby",)), ("Domus Nova", ("domus nova",)), ("OpenRent", ("openrent",)), ("Carter Jonas", ("carter jonas",)),
)
BRANDS = (
    "Knight Frank", "Chestertons", "Foxtons", "Savills", "Hamptons", "Dexters", "Marsh & Parsons", "John D Wood", "Harrods Estates", "JLL", "Carter Jonas", "Domus Nova", "Sotheby", "OpenRent",
    "Winkworth", "Strutt & Parker", "Kinleigh Folkard & Hayward", "KFH", "Draker", "Lurot Brand", "Beauchamp Estates",
)
TYPES = {
    "flat": ("flat", "apartment", "ground flat", "flat share", "long let", "short let", "", "not specified"),
    "studio": ("studio",),
    "house": ("house", "terraced", "end of terrace", "detached", "semi-detached", "town house", "mews", "link detached house", "barn conversion", "house share"),
    "maisonette": ("maisonette", "duplex"),
    "penthouse": ("penthouse",),
    "serviced": ("serviced apartments",),
}
DISTRICTS = {
    "Belgravia": "SW1", "Chelsea": "SW3", "Earls Court": "SW5", "South Kensington": "SW7", "Knightsbridge": "SW1X", "Kensington": "W8",
    "Notting Hill": "W11", "Bayswater": "W2", "St Johns Wood": "NW8", "Hampstead": "NW3", "Mayfair": "W1",
}
TOP_FLOOR = 99


def amenities(text: Column) -> dict[str, Column]:
    """A boolean for each amenity, false where there is no text; outdoor space is any of the four outdoor ones."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = {name: low.rlike(pattern) for name, pattern in AMENITIES.items()}
    space = out[OUTDOOR[0]]
    for name in OUTDOOR[1:]:
        space = space | out[name]
    return out | {"has_outdoor_space": space}


def floor_level(text: Column) -> Column:
    """A numbered floor first, then ground 0, basement -1, top 99; else null."""
    low = F.lower(text)
    number = F.nullif(F.regexp_extract(low, r"(\d+)(?:st|nd|rd|th)\s*floor", 1), F.lit("")).try_cast("int")
    named = F.when(F.contains(low, F.lit("ground floor")), 0).when(low.rlike(r"basement|lower\s*ground"), -1).when(low.rlike(r"penthouse|top\s*floor"), TOP_FLOOR)
    return F.coalesce(number, named)


def furnished(text: Column) -> Column:
    """unfurnished, furnished, or null. A part furnished home has the word furnished and counts as that."""
    low = F.lower(text)
    return F.when(F.contains(low, F.lit("unfurnished")), "unfurnished").when(low.rlike(r"\bfurnished\b"), "furnished")


def first_told(text: Column, names: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """The first of the names of which a word is in the text, else null."""
    low = F.lower(F.trim(text))
    return F.coalesce(*[F.when(low.rlike("|".join(rf"\Q{w}\E" for w in words)), F.lit(name)) for name, words in names])


def agency(agent: Column) -> Column:
    """The agency's common name, else what stands before a comma, else the first 30 characters; Unknown if none."""
    own = F.when(F.contains(agent, F.lit(",")), F.trim(F.substring_index(agent, ",", 1))).otherwise(F.substring(agent, 1, 30))
    return F.when(F.coalesce(agent, F.lit("")) == "", "Unknown").otherwise(F.coalesce(first_told(agent, AGENCIES), own))


def competitor(agent: Column) -> Column:
    return F.coalesce(first_told(agent, COMPETITORS), F.lit("Other"))


def brand(agent: Column) -> Column:
    """The first known brand in the name, else what stands before a comma, else the name; unknown if none."""
    own = F.when(F.contains(agent, F.lit(",")), F.trim(F.substring_index(agent, ",", 1))).otherwise(agent)
    return F.when(F.coalesce(agent, F.lit("")) == "", "unknown").otherwise(F.coalesce(first_told(agent, tuple((b, (b.lower(),)) for b in BRANDS)), own))


def standard_type(kind: Column) -> Column:
    """One of six classes, or other; what tells no class is a flat."""
    low = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    out = F.lit("other")
    for name, words in TYPES.items():
        out = F.when(low.isin(*words), name).otherwise(out)
    return out


def district_of_area(area: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in DISTRICTS.items() for x in pair]), area)


def price_in_text(text: Column) -> Column:
    """``amount`` and ``period`` (pcm or pw) of the first price; without a word for it a price is for a month. Null amount if there is none."""
    pattern = r"(?i)£\s*([\d,]+)\s*(pcm|pw|per month|per week)?"
    amount = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "").try_cast("int")
    week = F.lower(F.regexp_extract(text, pattern, 2)).isin("pw", "per week")
    return F.struct(amount.alias("amount"), F.when(amount.isNotNull(), F.when(week, "pw").otherwise("pcm")).alias("period"))


def sqft_in_text(text: Column) -> Column:
    """The number before square feet, in any of their spellings."""
    found = F.regexp_extract(text, r"(?i)([\d,]+)\s*(?:sq\.?\s*ft|sqft|square\s*feet|ft²)", 1)
    return F.regexp_replace(found, ",", "").try_cast("int")


def id_by_hash(prefix: str, text: Column) -> Column:
    """An id for a row that has none: the prefix and 16 hex digits."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, 16))
