"""Quantities, units, formulas and reaction conditions read from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.schemas import placeholder_name

#: Canonical spelling of lower-case units.
CANONICAL = {
    "ml": "mL", "ul": "µL", "ug": "µg", "umol": "µmol", "um": "µM", "g": "g", "mg": "mg", "kg": "kg", "l": "L", "mol": "mol", "mmol": "mmol", "nmol": "nmol",
    "m": "M", "mm": "mM", "n": "N", "wt%": "wt%", "vol%": "vol%", "mol%": "mol%", "%": "%", "eq": "eq", "equiv": "equiv", "v/v": "v/v", "w/w": "w/w", "w/v": "w/v",
}
UNITS = (*CANONICAL, "µl", "µg", "µmol", "µm")
_UNIT = "|".join(sorted(UNITS, key=len, reverse=True))
#: A plain number with its unit, and any number apart from its unit.
QUANTITY = rf"(?iu)^(\d+\.?\d*(?:e[+-]?\d+)?)\s*({_UNIT})$"
SPACED = rf"(?iu)^([+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)\s+({_UNIT})$"
MEASURE = r"(\d+(?:\.\d+)?)\s*(g|mg|kg|mL|L|ml|l|mmol|mol|M|mM|wt%|vol%|%)"
#: Units of amounts of substance, techniques and atmospheres in order, names of atmospheres, and prices of a token, in and out.
MOLAR = ("mol", "mmol", "umol", "µmol", "nmol")
TECHNIQUES = ("reflux", "hydrothermal", "stirring", "sonication", "calcination", "drying")
ATMOSPHERES = ("nitrogen", "argon", "vacuum")
ATMOSPHERE_NAMES = {"n2": "nitrogen", "n₂": "nitrogen", "ar": "argon", "o2": "oxygen", "h2": "hydrogen", "ambient": "air", "inert": "inert"}
RATES = {"gemini": (0.000000075, 0.0000003)}


def number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("double")


def unit(u: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in CANONICAL.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.lower(u)), u)


def quantity(text: Column) -> Column:
    """struct<value, unit> of a text such as 2.195 g or, with a space, -5 g; null if it is none."""
    t = F.trim(text)
    part = lambda k: F.coalesce(*[F.nullif(F.regexp_extract(t, p, k), F.lit("")) for p in (QUANTITY, SPACED)])
    value = part(1).try_cast("double")
    return F.when(value.isNotNull(), F.struct(value.alias("value"), unit(part(2)).alias("unit")))


def atmosphere_name(a: Column) -> Column:
    low = F.lower(F.trim(a))
    pairs = F.create_map(*[F.lit(x) for kv in ATMOSPHERE_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, low), low)


def formula(f: Column) -> Column:
    """The formula, trimmed, if it is made of letters, digits, brackets, dots and signs only."""
    return F.when(f.rlike(r"^[A-Za-z0-9()\[\].·+\-]+$"), F.trim(f))


def checked_name(name: Column) -> Column:
    return F.when(~placeholder_name(name), F.trim(name))


def measures(window: Column) -> Column:
    """All struct<value, unit> in a text."""
    values = F.regexp_extract_all(window, F.lit(MEASURE), F.lit(1))
    units = F.regexp_extract_all(window, F.lit(MEASURE), F.lit(2))
    return F.zip_with(values, units, lambda v, u: F.struct(v.try_cast("double").alias("value"), u.alias("unit")))


def window_after(text: Column, name: Column, reach: int = 120) -> Column:
    """From the first mention of the name, in any case, to `reach` characters behind it; empty without one."""
    at = F.position(F.lower(name), F.lower(text))
    return F.when(at > 0, F.substring(text, at, F.length(name) + reach)).otherwise("")


def aligned(window: Column) -> Column:
    """struct<quantity, moles> from the measures in order: the first molar one is moles, what fits neither slot is left."""
    none = F.lit(None).cast("struct<value:double,unit:string>")
    molar = lambda m: m["unit"].isin(*MOLAR)

    def step(acc: Column, m: Column) -> Column:
        as_moles = molar(m) & acc["moles"].isNull()
        return F.struct(
            F.when(~as_moles & acc["quantity"].isNull(), m).otherwise(acc["quantity"]).alias("quantity"),
            F.when(as_moles, m).otherwise(acc["moles"]).alias("moles"),
        )

    return F.aggregate(measures(window), F.struct(none.alias("quantity"), none.alias("moles")), step)


def temperature(text: Column) -> Column:
    return number(text, r"(?i)(\d+(?:\.\d+)?)\s*(?:°C|C\b|celsius)")


def duration(text: Column) -> Column:
    pattern = r"(?i)(\d+(?:\.\d+)?)\s*(hours?|hrs?|h\b|min(?:utes?)?|days?)"
    value, u = number(text, pattern), F.lower(F.regexp_extract(text, pattern, 2))
    return F.when(u.startswith("min"), value / 60.0).when(u.startswith("day"), value * 24.0).otherwise(value)


def technique(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(t)), t) for t in TECHNIQUES])


def atmosphere(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(a)), a) for a in ATMOSPHERES], F.when(low.rlike(r"\b(?:under|in)\s+air\b|\bair\s+atmosphere\b"), "air"))


def pressure(text: Column) -> Column:
    low, pattern = F.lower(text), r"(\d+(?:\.\d+)?)\s*(atm|bar|kpa|mpa)\b"
    value, u = number(low, pattern), F.regexp_extract(low, pattern, 2)
    return F.when(u == "atm", value).when(u == "bar", value * 0.986923).when(u == "kpa", value / 101.325).when(u == "mpa", value * 9.86923).when(F.contains(low, F.lit("ambient pressure")), 1.0)


def cost(provider: Column, tokens: Column) -> Column:
    """Half of the tokens at the input rate, half at the output rate; providers without rates cost nothing."""
    half = F.floor(tokens / 2)
    out = F.lit(0.0)
    for name, (into, outof) in RATES.items():
        out = F.when(provider == name, half * into + (tokens - half) * outof).otherwise(out)
    return out
