"""Fifteen validation rules as array expressions on a recipe row, and the routing of corrections.

A rule gives the findings of one recipe as an array; all arrays are put together in rule
order. There is no shuffle and no UDF. A new rule is one more line in RULES.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.schemas import FINDING

#: Units that a quantity may have, exact case.
UNITS = (
    "g mg kg ug µg mL L uL µL ml l mol mmol umol µmol nmol M mM uM µM N wt% vol% % mol% eq equiv v/v w/w w/v"
).split()
#: Agents in the order in which a correction is routed.
AGENTS = ("ENTITY_AGENT", "QUANTITY_AGENT", "CONDITION_AGENT")
#: Least and most of a condition.
RANGES = {"temperature_celsius": (-200.0, 3000.0), "duration_hours": (0.001, 720.0), "pressure_atm": (0.0001, 1000.0), "yield_percent": (0.0, 100.0)}
BLOCKING, WARNING = "BLOCKING", "WARNING"


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def at(i: Column, field: str) -> Column:
    return F.concat(F.lit("entities["), i.cast("string"), F.lit(f"].{field}"))


class Rule:
    def __init__(self, error: str, agent: str, found: Callable[[Rule], Column], severity: str = BLOCKING) -> None:
        self.error, self.agent, self.severity, self.found = error, agent, severity, found

    def finding(self, field: Column, name: Column | None = None, actual: Column | None = None, message: Column | None = None, severity: Column | None = None) -> Column:
        name, actual = (F.lit(None) if c is None else c for c in (name, actual))
        return F.struct(
            F.lit(self.number).alias("rule_no"), F.lit(self.error).alias("error_type"), (F.lit(self.severity) if severity is None else severity).alias("severity"), F.lit(self.agent).alias("responsible_agent"),
            field.cast("string").alias("field_path"), name.cast("string").alias("entity_name"), actual.cast("string").alias("actual_value"), (F.lit(self.error) if message is None else message).alias("message"),
        )

    number = 0


def when_any(condition: Column, finding: Column) -> Column:
    return F.when(condition, F.array(finding)).otherwise(F.array().cast(f"array<{FINDING}>"))


def each(make: Callable[[Column, Column], Column]) -> Column:
    """Findings per entity; make gives null for none."""
    return F.array_compact(F.transform("entities", make))


def no_entities(r: Rule) -> Column:
    return when_any(F.size("entities") == 0, r.finding(F.lit("entities"), message=F.lit("No chemicals were found.")))


def no_reactant(r: Rule) -> Column:
    return when_any((F.size("entities") > 0) & ~F.exists("entities", lambda e: e["role"] == "REACTANT"), r.finding(F.lit("entities"), message=F.lit("No reactant was found.")))


def repeated_names(r: Rule) -> Column:
    key = lambda e: F.lower(F.trim(e["name"]))
    keys = F.transform("entities", key)
    return each(lambda e, i: F.when(F.array_position(keys, key(e)) <= i, r.finding(at(i, "name"), e["name"], e["name"])))


def short_names(r: Rule) -> Column:
    return each(lambda e, i: F.when(F.length(F.trim(e["name"])) < 2, r.finding(at(i, "name"), e["name"], e["name"])))


def missing_units(r: Rule) -> Column:
    severity = lambda e: F.when(e["role"] == "SOLVENT", WARNING).otherwise(BLOCKING)
    return each(lambda e, i: F.when(e["role"].isin("REACTANT", "CATALYST", "SOLVENT") & blank(e["quantity"]["unit"]), r.finding(at(i, "quantity"), e["name"], severity=severity(e))))


def two_fields(make: Callable[[Column, Column, str], Column]) -> Column:
    return F.array_compact(F.flatten(F.transform("entities", lambda e, i: F.array(make(e, i, "quantity"), make(e, i, "moles")))))


def invalid_units(r: Rule) -> Column:
    unit = lambda e, f: e[f]["unit"]
    return two_fields(lambda e, i, f: F.when(~blank(unit(e, f)) & ~unit(e, f).isin(*UNITS), r.finding(at(i, f"{f}.unit"), e["name"], unit(e, f))))


def not_positive(r: Rule) -> Column:
    return two_fields(lambda e, i, f: F.when(e[f].isNotNull() & (e[f]["value"] <= 0), r.finding(at(i, f"{f}.value"), e["name"], e[f]["value"])))


def two_roles(r: Rule) -> Column:
    names = lambda role: F.transform(F.filter("entities", lambda e: e["role"] == role), lambda e: F.lower(e["name"]))
    return F.transform(F.array_sort(F.array_intersect(names("SOLVENT"), names("REACTANT"))), lambda n: r.finding(F.lit("entities"), n, n))


def product_amounts(r: Rule) -> Column:
    return each(lambda e, i: F.when((e["role"] == "PRODUCT") & e["quantity"].isNotNull(), r.finding(at(i, "quantity"), e["name"])))


def outside(field: str) -> Callable[[Rule], Column]:
    least, most = RANGES[field]

    def found(r: Rule) -> Column:
        value = F.col("conditions")[field]
        return when_any(F.coalesce(~value.between(least, most), F.lit(False)), r.finding(F.lit(f"conditions.{field}"), actual=value))

    return found


def no_conditions(r: Rule) -> Column:
    c = F.col("conditions")
    none = c.isNull()
    neither = c["temperature_celsius"].isNull() & c["duration_hours"].isNull()
    message = F.when(none, "No reaction conditions were found.").otherwise("Neither temperature nor duration was found.")
    return when_any(none | neither, r.finding(F.lit("conditions"), message=message))


def odd_mass(r: Rule) -> Column:
    grams = lambda q: q["value"] * F.when(q["unit"] == "g", 1.0).when(q["unit"] == "mg", 0.001).when(q["unit"] == "kg", 1000.0)
    moles = lambda q: q["value"] * F.when(q["unit"] == "mol", 1.0).when(q["unit"] == "mmol", 0.001)
    odd = lambda e: F.coalesce((moles(e["moles"]) > 0) & ~F.try_divide(grams(e["quantity"]), moles(e["moles"])).between(1.0, 100000.0), F.lit(False))
    return each(lambda e, i: F.when(odd(e), r.finding(at(i, "quantity"), e["name"])))


RULES = [
    Rule("NO_ENTITIES", AGENTS[0], no_entities),
    Rule("NO_PRIMARY_REACTANT", AGENTS[0], no_reactant),
    Rule("DUPLICATE_ENTITY_NAMES", AGENTS[0], repeated_names),
    Rule("ENTITY_NAME_TOO_SHORT", AGENTS[0], short_names),
    Rule("UNIT_MISSING", AGENTS[1], missing_units),
    Rule("UNIT_INVALID", AGENTS[1], invalid_units),
    Rule("QUANTITY_NEGATIVE", AGENTS[1], not_positive),
    Rule("SOLVENT_IS_REACTANT", AGENTS[0], two_roles),
    Rule("PRODUCT_QUANTITY_AS_INPUT", AGENTS[0], product_amounts, WARNING),
    Rule("TEMPERATURE_OUT_OF_RANGE", AGENTS[2], outside("temperature_celsius")),
    Rule("DURATION_OUT_OF_RANGE", AGENTS[2], outside("duration_hours")),
    Rule("PRESSURE_OUT_OF_RANGE", AGENTS[2], outside("pressure_atm")),
    Rule("YIELD_OUT_OF_RANGE", AGENTS[2], outside("yield_percent")),
    Rule("NO_CONDITIONS", AGENTS[2], no_conditions, WARNING),
    Rule("MOLES_MASS_INCONSISTENT", AGENTS[1], odd_mass, WARNING),
]
for _number, _rule in enumerate(RULES, 1):
    _rule.number = _number


def assemble(recipes: DataFrame, entities: DataFrame, conditions: DataFrame) -> DataFrame:
    """Recipe rows with `entities` (array in order) and `conditions` (struct) from their long tables."""
    quantity = F.when(F.col("value").isNotNull(), F.struct(F.col("value").alias("value"), F.col("unit").alias("unit")))
    moles = F.when(F.col("moles_value").isNotNull(), F.struct(F.col("moles_value").alias("value"), F.col("moles_unit").alias("unit")))
    lists = entities.groupBy("recipe_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "role", quantity.alias("quantity"), moles.alias("moles")))).alias("entities"))
    structs = conditions.select("recipe_id", F.struct(*[c for c in conditions.columns if c != "recipe_id"]).alias("conditions"))
    empty = F.array().cast(lists.schema["entities"].dataType)
    return recipes.join(lists, "recipe_id", "left").join(structs, "recipe_id", "left").withColumn("entities", F.coalesce("entities", empty))


def with_findings(rows: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Adds `findings`, in rule order."""
    return rows.withColumn("findings", F.concat(*[r.found(r) for r in rules]))


def summary(validated: DataFrame, n_rules: int = len(RULES)) -> DataFrame:
    """Adds blocking, warnings, passed, rules_passed (a rule with warnings only has passed) and primary_agent."""
    blocking = F.filter("findings", lambda f: f["severity"] == BLOCKING)
    order = F.create_map(*[F.lit(x) for k, a in enumerate(AGENTS) for x in (a, k)])
    rows = validated.withColumn("blocking", blocking).withColumn("warnings", F.filter("findings", lambda f: f["severity"] == WARNING))
    failed = F.size(F.array_distinct(F.transform("blocking", lambda f: f["rule_no"])))
    first = F.array_min(F.transform("blocking", lambda f: F.try_element_at(order, f["responsible_agent"])))
    return rows.withColumn("passed", F.size("blocking") == 0).withColumn("rules_passed", F.lit(n_rules) - failed).withColumn("primary_agent", F.get(F.array(*map(F.lit, AGENTS)), first))


def error_groups(summed: DataFrame) -> DataFrame:
    """Of the routed agent's findings those of the first error type: error_type, fields and messages joined."""
    mine = F.filter("blocking", lambda f: f["responsible_agent"] == F.col("primary_agent"))
    rows = summed.where("not passed").withColumn("mine", mine).withColumn("error_type", F.get("mine", 0)["error_type"])
    same = F.filter("mine", lambda f: f["error_type"] == F.col("error_type"))
    joined = lambda field: F.array_join(F.transform("same", lambda f: f[field]), "; ")
    return rows.withColumn("same", same).select("recipe_id", "primary_agent", "error_type", joined("field_path").alias("fields"), joined("message").alias("messages"), F.size("same").alias("n_findings"))


def resolve_attempts(attempts: DataFrame, max_retries: int = 3) -> DataFrame:
    """chunk_id, status, attempts_used, n_corrections from rows (chunk_id, attempt, passed).

    The first passing attempt decides: PASSED if it is the first, else CORRECTED; none within
    the limit is FAILED. Each failing attempt before the last allowed one is a correction.
    """
    within = attempts.where(F.col("attempt") <= max_retries)
    first = within.groupBy("chunk_id").agg(F.min(F.when(F.col("passed"), F.col("attempt"))).alias("first"), F.max("attempt").alias("last"))
    status = F.when(F.col("first") == 1, "PASSED").when(F.col("first") > 1, "CORRECTED").otherwise("FAILED")
    used = F.coalesce("first", "last")
    return first.select("chunk_id", status.alias("status"), used.alias("attempts_used"), F.when(F.col("first").isNotNull(), F.col("first") - 1).otherwise(F.least("last", F.lit(max_retries - 1))).alias("n_corrections"))


def correction_requests(groups: DataFrame, payloads: DataFrame, max_retries: int = 3) -> DataFrame:
    """Request texts for an external model, one per failed recipe (recipe_id, attempt, payload)."""
    text = F.concat_ws("\n", F.format_string("Correction attempt %d of %d for %s", "attempt", F.lit(max_retries), "primary_agent"), F.concat(F.lit("- "), "error_type", F.lit(": "), "fields"), F.concat(F.lit("Messages: "), "messages"), F.concat(F.lit("Previous output: "), "payload"), F.lit("Return the corrected values only as JSON; do not invent values."))
    return groups.join(payloads, "recipe_id").select("recipe_id", "primary_agent", text.alias("request"))


def second_names(entities: DataFrame) -> DataFrame:
    """Entities whose name occurred before in their recipe, whatever its case and outer spaces."""
    w = Window.partitionBy("recipe_id", F.lower(F.trim("name"))).orderBy("pos")
    return entities.withColumn("occurrence", F.row_number().over(w)).where("occurrence > 1")
