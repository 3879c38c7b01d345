"""Which floors a text names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the floors that a listing has flags for.
FLOORS = {
    "has_basement": r"basement|lower\s*ground",
    "has_ground": r"(?<!lower )ground\s*floor",
    "has_first_floor": r"first\s*floor|1st\s*floor",
    "has_second_floor": r"second\s*floor|2nd\s*floor",
    "has_third_floor": r"third\s*floor|3rd\s*floor",
    "has_fourth_plus": r"(fourth|fifth|sixth|seventh|eighth|ninth|tenth)\s*floor|([4-9]|1\d)th\s*floor",
}


def floor_flags(text: Column) -> dict[str, Column]:
    """0 or 1 for each floor, and ``floor_count``, how many there are. No text, no floors."""
    low = F.lower(F.coalesce(text, F.lit("")))
    flags = {name: low.rlike(pattern).cast("int") for name, pattern in FLOORS.items()}
    return flags | {"floor_count": sum(flags.values(), F.lit(0))}


# Words for numbers.
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth")
NUMBERS = {"two": 2, "three": 3, "four": 4, "five": 5, "2": 2, "3": 3, "4": 4, "5": 5}


def floor_info(text: Column) -> dict[str, Column]:
    """What a text tells of a home's floor, in eleven columns.

    Rules stand in order and later ones override single fields: penthouse, basement, lower ground,
    ground and top floor set category (and level); an ordinal word sets the level; a number sets it
    if level or category are still open; the level sets an open category. "No lift" has the word lift
    and so tells of one. No text tells nothing.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda pattern: low.rlike(pattern)
    number = lambda pattern: F.nullif(F.regexp_extract(low, pattern, 1), F.lit("")).try_cast("double")
    penthouse, basement, lower, ground, top = has(r"\bpenthouse\b"), has(r"\bbasement\b"), has(r"\blower ground\b"), has(r"\bground floor\b"), has(r"\btop floor\b")
    level = F.when(ground, 0.0).when(lower, -0.5).when(basement, -1.0)
    category = F.when(top, "top_floor").when(ground, "ground").when(lower, "lower_ground").when(basement, "basement").when(penthouse, "penthouse")
    sure = F.when(top, "medium").when(category.isNotNull(), "high")
    ordinal = F.coalesce(*[F.when(has(rf"\b{word}\s+floor\b"), float(i)) for i, word in enumerate(ORDINALS, 1)])
    level = F.coalesce(ordinal, level)
    numeric = F.when(level.isNull() | category.isNull(), F.coalesce(number(r"\b(\d+)(?:st|nd|rd|th)?\s*floor\b"), number(r"\bfloor\s*(\d+)\b")))
    level = F.coalesce(numeric, level)
    sure = F.when(ordinal.isNotNull() | numeric.isNotNull(), "high").otherwise(F.coalesce(sure, F.lit("none")))
    by_level = F.when(level < 0, "basement").when(level == 0, "ground").when(level <= 2, "lower").when(level <= 5, "mid").when(level.isNotNull(), "high")
    counted = F.nullif(F.regexp_extract(low, r"\b(two|three|four|five|2|3|4|5)\s+floors?\b", 1), F.lit(""))
    two, three = F.contains(low, F.lit("maisonette")) | F.contains(low, F.lit("duplex")), F.contains(low, F.lit("triplex"))
    span = F.coalesce(*[F.when(counted == word, n) for word, n in NUMBERS.items()], F.lit(1))
    return {
        "floor_level": level, "floor_category": F.coalesce(category, by_level), "is_multi_floor": counted.isNotNull() | two | three,
        "num_floors_span": F.greatest(span, F.when(three, 3).when(two, 2).otherwise(1)), "has_lift": F.when(has(r"\b(lift|elevator)\b"), True).when(has(r"\bno lift\b|walk[- ]?up\b"), False),
        "is_penthouse": penthouse, "is_basement": basement, "is_lower_ground": lower, "is_ground": ground, "is_top_floor": top, "floor_confidence": sure,
    }
