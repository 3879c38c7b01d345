"""What the text of a floorplan says: areas, rooms, floors, outdoor spaces, features, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings to mend; words of lines that are left out; patterns of floors, rooms and outdoor spaces, features.
TYPOS = ((r"\bflocr\b", "floor"), (r"\bfioor\b", "floor"), (r"\bFloor\s*Flan\b", "Floor Plan"), (r"\b2nth\b", "2nd"))
EXCLUDED = r"excluding|exclude|not\s+included|reduced\s+headroom"
NTH = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth")
LOW_FLOORS = {"Basement": r"basement|cellar", "Lower Ground": r"lower\s*ground|lgf|lower\s*level", "Ground Floor": r"ground|gf\b|street\s*level", "Mezzanine": r"mezzanine|mezz\b"}
HIGH_PLACES = {"Roof Terrace": r"roof\s*terrace|rooftop", "Roof": r"roof\b", "Penthouse": "penthouse"}
ROOMS = {
    "bedroom": r"(?:master\s+)?(?:principal\s+)?bedroom\s*\d*|bed\s*\d+",
    "bathroom": r"bath(?:room)?\s*\d*|en[\-\s]?suite|shower\s*room|wc|cloakroom",
    "kitchen": r"kitchen|breakfast\s+room|kitchen/breakfast",
    "reception": r"reception(?:\s+room)?|living\s*room|sitting\s*room|lounge|drawing\s*room",
    "dining": r"dining\s*(?:room)?|dining/reception",
    "study": r"study|office|home\s+office",
    "utility": r"utility(?:\s+room)?|laundry(?:\s+room)?",
    "hallway": r"hall(?:way)?|entrance\s+hall|landing",
    "storage": r"storage|cupboard|wardrobe|dressing\s*(?:room|area)?",
    "garage": r"garage",
    "cellar": r"cellar|wine\s+cellar|basement",
    "cinema": r"cinema(?:\s+room)?|tv\s+room|media\s+room",
    "gym": r"gym|fitness|exercise",
    "pool": r"pool|swimming|spa",
    "plant": r"plant\s+room",
    "staff": r"staff\s+(?:bedroom|quarters|room)",
}
#: The same types by what alone decides whether a line has one, as rooms' words before and after it don't.
SIGNS = {
    "bedroom": r"bedroom|bed\s*\d",
    "bathroom": r"bath|en[\-\s]?suite|shower\s*room|wc|cloakroom",
    "kitchen": r"kitchen|breakfast\s+room",
    "reception": r"reception|living\s*room|sitting\s*room|lounge|drawing\s*room",
    "dining": "dining",
    "study": "study|office",
    "utility": "utility|laundry",
    "hallway": "hall|landing",
    "storage": "storage|cupboard|wardrobe|dressing",
    "garage": "garage",
    "cellar": "cellar|basement",
    "cinema": r"cinema|tv\s+room|media\s+room",
    "gym": "gym|fitness|exercise",
    "pool": "pool|swimming|spa",
    "plant": r"plant\s+room",
    "staff": r"staff\s+bedroom|staff\s+quarters|staff\s+room",
}
OUTDOOR = {"terrace": r"terrace|roof\s+terrace", "garden": r"garden|rear\s+garden|front\s+garden", "balcony": "balcony", "patio": "patio|courtyard"}
FEATURES = ("swimming pool", "pool", "spa", "sauna", "steam room", "gym", "cinema", "media room", "wine cellar", "cellar", "lift", "elevator", "garage", "parking", "air conditioning", "a/c", "underfloor heating", "fireplace", "wood burning")
FEET = r"""(\d+)['’](\d+)?["″]?\s*[x×]\s*(\d+)['’](\d+)?["″]?"""
METRES = r"(\d+\.?\d*)\s*m?\s*[x×]\s*(\d+\.?\d*)\s*m?"
NUMBER, SQFT, SQM = r"(\d[\d,]*(?:\.\d+)?)", r"(?:sq\.?\s*ft|sqft)", r"(?:sq\.?\s*m|sqm)"
#: Patterns of a total, the surest first.
TOTAL_LINE = rf"(?im)(?:^|\n)\s*Total\s*=?\s*[\d,\.]+\s*{SQM}\s*/?\s*{NUMBER}\s*{SQFT}"
TOTALS = (
    rf"(?i)(?:total|gross\s*internal|approximate)\s*(?:gross\s*internal\s*)?(?:area)?\s*(?:=|:|-|of)?\s*{NUMBER}\s*{SQFT}",
    rf"(?i)(?:total|overall)\s*(?:area)?\s*(?:=|:)?\s*{NUMBER}\s*{SQFT}",
    rf"(?i){NUMBER}\s*{SQFT}\s*(?:total|overall|gross)",
)
ANY_SQFT, ANY_SQM = rf"(?i){NUMBER}\s*(?:sq\.?\s*ft|sqft|square\s*feet)", rf"(?i){NUMBER}\s*(?:sq\.?\s*m|sqm|square\s*m)"
#: Characters before and after a mention of an outdoor space where its size is looked for.
BEFORE, AFTER = 10, 50


def let(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of a value that is computed once, however often ``made`` names it: inside lambdas Spark shares no work by itself."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def said(low: Column, pattern: str) -> Column:
    """Whether one of the pattern's alternatives (none in brackets) is in the text; plain words are looked for as such, which is cheaper."""
    parts = pattern.split("|")
    words = [F.contains(low, F.lit(w)) for w in parts if w.replace(" ", "").isalnum()]
    rest = [w for w in parts if not w.replace(" ", "").isalnum()]
    found = words + ([low.rlike("|".join(rest))] if rest else [])
    out = found[0]
    for c in found[1:]:
        out = out | c
    return out


def mended(text: Column) -> Column:
    """The text with common misreadings put right."""
    for wrong, right in TYPOS:
        text = F.regexp_replace(text, f"(?i){wrong}", right)
    return text


def floor_patterns() -> dict[str, str]:
    """Pattern by shown name: words and figures. A figure is found inside a longer one too: 14th has 4th in it."""
    ending = lambda n: {1: "st", 2: "nd", 3: "rd"}.get(n, "th")
    return LOW_FLOORS | {f"{w.title()} Floor": f"{w}|{n}{ending(n)}" for n, w in enumerate(NTH, 1)} | HIGH_PLACES


def clean(text: Column) -> Column:
    """The mended text in lower case, without the lines that tell what is left out."""
    left = lambda x: F.array_join(F.filter(F.split(x, "\n"), lambda line: ~line.rlike(f"(?i){EXCLUDED}")), "\n")
    return F.lower(let(mended(F.coalesce(text, F.lit(""))), lambda x: F.when(x.rlike(f"(?i){EXCLUDED}"), left(x)).otherwise(x)))


def floor_facts(text: Column) -> Column:
    """``floors`` (shown names in order of the alphabet), flags, ``floor_count`` and ``property_levels``, as one struct.

    Lines that tell what is left out don't count. Roofs and penthouses are no floors of their own, and
    the flag for the fourth and above knows only the fourth to seventh and penthouses.
    """
    patterns, nth = floor_patterns(), [f"{w.title()} Floor" for w in NTH]
    found = let(clean(text), lambda low: F.struct(*[said(low, p).cast("int").alias(n) for n, p in patterns.items()]))
    count = lambda f: sum((f[n] for n in (*LOW_FLOORS, *nth)), F.lit(0))
    levels = lambda n: F.when(n <= 1, "single_floor").when(n == 2, "duplex").when(n == 3, "triplex").otherwise("multi_floor")

    def made(f: Column) -> Column:
        flag = lambda *names: F.greatest(*[f[n] for n in names], F.lit(0))
        facts = {
            "floors": F.array_compact(F.array(*[F.when(f[n] == 1, n) for n in sorted(patterns)])),
            "has_basement": flag("Basement"), "has_lower_ground": flag("Lower Ground"), "has_ground": flag("Ground Floor"), "has_mezzanine": flag("Mezzanine"), "has_first_floor": flag(nth[0]), "has_second_floor": flag(nth[1]),
            "has_third_floor": flag(nth[2]), "has_fourth_plus": flag(*nth[3:7], "Penthouse"), "has_roof_terrace": flag("Roof Terrace", "Roof"), "floor_count": count(f), "property_levels": let(count(f), levels),
        }
        return F.struct(*[c.alias(n) for n, c in facts.items()])

    return let(found, made)


#: Names of the facts of floors.
FACTS = ("floors", "has_basement", "has_lower_ground", "has_ground", "has_mezzanine", "has_first_floor", "has_second_floor", "has_third_floor", "has_fourth_plus", "has_roof_terrace", "floor_count", "property_levels")


def floors(text: Column) -> dict[str, Column]:
    """The facts of floors by name. Who takes several of them does better with ``floor_facts`` in a column."""
    facts = floor_facts(text)
    return {name: facts[name] for name in FACTS}


def names_floor(text: Column) -> Column:
    """Whether any floor is named."""
    return let(clean(text), lambda low: said(low, "|".join(floor_patterns().values())))


def figure(text: Column) -> Column:
    """A number with commas, its fraction cut off."""
    return F.floor(F.regexp_replace(text, ",", "").try_cast("double")).cast("long")


def largest(text: Column, pattern: str, least: int) -> Column:
    """The largest number of the pattern's first group between ``least`` and 100,000, both excluded; else null."""
    values = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda m: F.regexp_replace(m, ",", "").try_cast("double"))
    return F.floor(F.array_max(F.filter(values, lambda v: (v > least) & (v < 100_000)))).cast("long")


def total_sqft(text: Column) -> Column:
    """Square feet by the surest pattern that has a likely number: a line of the total, words for a total, the largest of all."""

    def read(x: Column) -> Column:
        line = let(figure(F.regexp_extract(x, TOTAL_LINE, 1)), lambda n: F.when((n > 100) & (n < 100_000), n))
        # A text without a word for feet has no number before it.
        return F.when(x.rlike(r"(?i)sq"), F.coalesce(line, *[largest(x, p, 100) for p in TOTALS], largest(x, ANY_SQFT, 200)))

    return let(F.coalesce(text, F.lit("")), read)


def total_area(text: Column) -> tuple[Column, Column]:
    """Square feet, and square metres, the first there are, if there are feet."""
    sqft = total_sqft(text)
    return sqft, F.when(sqft.isNotNull(), figure(F.regexp_extract(F.coalesce(text, F.lit("")), ANY_SQM, 1)))


def feet(text: Column) -> tuple[Column, Column]:
    """Dimensions in feet and inches as they are written, and their product in square feet, cut off."""
    part = lambda i: F.coalesce(F.regexp_extract(text, FEET, i).try_cast("int"), F.lit(0))
    there = text.rlike(FEET)
    return F.when(there, F.regexp_extract(text, FEET, 0)), F.when(there, F.floor((part(1) + part(2) / 12) * (part(3) + part(4) / 12)).cast("int"))


def kind(line: Column) -> Column:
    """The first type of room whose sign is in a line; null if there is none."""
    return let(F.trim(F.lower(line)), lambda low: F.coalesce(*[F.when(said(low, pattern), name) for name, pattern in SIGNS.items()]))


def room(line: Column) -> Column:
    """A room of a line, by the first type whose pattern is in it; null if there is none."""
    told = lambda w: w.rlike(r"^\p{Lu}") | F.lower(w).isin("and", "with", "room")
    # From the first told word to the one before the next that isn't.
    until = lambda rest: let(F.array_position(F.transform(rest, told), False), lambda end: F.array_join(F.when(end > 0, F.slice(rest, 1, F.greatest(end - 1, F.lit(0)).cast("int"))).otherwise(rest), " "))
    since = lambda words: let(F.array_position(F.transform(words, told), True), lambda first: F.when(first > 0, let(F.slice(words, F.greatest(first, F.lit(1)).cast("int"), F.size(words)), until)))
    name = let(F.filter(F.split(line, r"\s+"), lambda w: w != ""), since)
    imperial, sqft = feet(line)
    metric = line.rlike(METRES)
    side = lambda i: F.regexp_extract(line, METRES, i)
    height = F.nullif(F.regexp_extract(line, r"(?i)CH\s*(\d+\.?\d*)\s*m?", 1), F.lit(""))

    def made(kind: Column) -> Column:
        return F.struct(kind.alias("type"), F.coalesce(name, F.initcap(kind)).alias("name"), imperial.alias("imperial"), F.when(metric, F.concat(side(1), F.lit(" x "), side(2))).alias("metric"), sqft.alias("sqft"), F.when(metric, F.bround(side(1).try_cast("double") * side(2).try_cast("double"), 1)).alias("sqm"), F.concat(height, F.lit("m")).alias("ceiling"))

    return let(kind(line), lambda k: F.when(k.isNotNull(), made(k)))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def rooms(text: Column) -> Column:
    """The rooms of all lines, in their order."""
    return F.array_compact(F.transform(lines(text), room))


def room_kinds(text: Column) -> Column:
    """The rooms of all lines by their types alone."""
    return F.array_compact(F.transform(lines(text), kind))


def room_counts(found: Column) -> Column:
    """Number of rooms by type, without types that there are none of."""
    return kind_counts(F.transform(found, lambda r: r["type"]))


def kind_counts(kinds: Column) -> Column:
    """How often each type is there, types in the order of the patterns, without those that aren't."""
    one = lambda all_, k: F.struct(k.alias("key"), F.size(F.filter(all_, lambda x: x == k)).alias("value"))
    # Types that are there, in the order of the patterns, so that one without rooms costs no pass.
    there = lambda all_: F.array_intersect(F.array(*map(F.lit, ROOMS)), all_)
    return let(kinds, lambda all_: F.map_from_entries(F.transform(there(all_), lambda k: one(all_, k))))


def outdoor(text: Column) -> Column:
    """Every mention of an outdoor space, type by type, with a size that stands from 10 characters before to 50 after it."""
    text = F.coalesce(text, F.lit(""))
    every = []
    for kind, pattern in OUTDOOR.items():
        # The mention is looked for first, then what stands before it: the other way round, every character would have that read.
        around = F.lit(rf"(?is)(?={pattern})(?<=(^.{{0,{BEFORE - 1}}}|.{{{BEFORE}}}))({pattern})(?=(.{{0,{AFTER}}}))")
        parts = [F.regexp_extract_all(text, around, F.lit(i)) for i in (1, 2, 3)]
        contexts = F.zip_with(F.zip_with(*parts[:2], lambda a, b: F.concat(a, b)), parts[2], lambda a, b: F.concat(a, b))
        every.append(F.when(text.rlike(f"(?i){pattern}"), F.transform(contexts, _space(kind))).otherwise(F.transform(F.array().cast("array<string>"), _space(kind))))
    return F.when(text.rlike(f"(?i){'|'.join(OUTDOOR.values())}"), F.concat(*every)).otherwise(F.transform(F.array().cast("array<string>"), _space("")))


def _space(kind: str):
    def made(context: Column) -> Column:
        imperial, sqft = feet(context)
        return F.struct(F.lit(kind).alias("type"), imperial.alias("imperial"), sqft.alias("sqft"))

    return made


def special(text: Column) -> Column:
    """Features named in the text, in order of the alphabet."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.sort_array(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(f)), f) for f in FEATURES])))


def address_line(text: Column) -> Column:
    """The first of five lines with a full postcode or a word for a street."""
    lines = F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 5), lambda line: F.regexp_replace(line, r"^\s+|\s+$", ""))
    place = lambda line: line.rlike(r"[A-Z]{1,2}\d{1,2}[A-Z]?\s*\d[A-Z]{2}") | line.rlike("(?i)Street|Road|Avenue|Lane|Gardens|Square|Place|Terrace")
    return F.get(F.filter(lines, place), F.lit(0))


def score(sqft: Column, n: Column, sized: Column, named: Column) -> Column:
    """0.4 for an area, 0.3 for five rooms, 0.2 for their sizes, 0.1 for floors."""
    points = F.when(F.coalesce(sqft, F.lit(0)) > 0, 0.4).otherwise(0.0) + F.least(n / 5, F.lit(1.0)) * 0.3 + F.coalesce(F.try_divide(sized, n), F.lit(0.0)) * 0.2 + F.when(named, 0.1).otherwise(0.0)
    return F.bround(points, 2)


def confidence(sqft: Column, found: Column, named: Column) -> Column:
    """How much of a plan was read, from its area, rooms and floors."""
    sized = lambda rooms: F.size(F.filter(rooms, lambda r: r["imperial"].isNotNull() | r["metric"].isNotNull()))
    return let(found, lambda rooms: score(sqft, F.size(rooms), sized(rooms), F.size(named) > 0))


def plan_confidence(text: Column) -> Column:
    """How much of a plan was read, from the text: whether rooms have sizes is enough, not which."""
    any_room = "|".join(SIGNS.values())
    sized = F.array_compact(F.transform(lines(text), lambda line: F.when(let(F.trim(F.lower(line)), lambda low: said(low, any_room)), line.rlike(FEET) | line.rlike(METRES))))
    return let(sized, lambda rooms: score(total_sqft(text), F.size(rooms), F.size(F.filter(rooms, lambda x: x)), names_floor(text)))
