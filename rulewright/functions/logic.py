"""Conditions over a map of facts. A fact that isn't there makes a condition unknown, which is SQL's NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A condition: what fact, `eq`, `neq` or `in`, and values in canonical string form (one, but for `in`).
CONDITION = "struct<fact:string,op:string,values:array<string>>"
NO_CONDITIONS = f"cast(array() as array<{CONDITION}>)"


def canonical(value: Column) -> Column:
    """A double as text: whole numbers without a fraction, so that 1 and 1.0 are one value."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def condition(one: Column, facts: Column) -> Column:
    """True, false, or null where the fact is unknown."""
    known = facts[one["fact"]]
    return (
        F.when(known.isNull(), F.lit(None).cast("boolean"))
        .when(one["op"] == "neq", known != one["values"][0])
        .otherwise(F.array_contains(one["values"], known))
    )


def all_of(conditions: Column, facts: Column) -> Column:
    """False if any is false, else unknown if any is, else true."""
    truths = F.transform(conditions, lambda c: condition(c, facts))
    return F.aggregate(truths, F.lit(True), lambda a, b: a & b)


def unknown_facts(conditions: Column, facts: Column) -> Column:
    """The facts that all_of doesn't know, sorted; none where it is false anyway."""
    named = F.transform(F.filter(conditions, lambda c: facts[c["fact"]].isNull()), lambda c: c["fact"])
    decided = all_of(conditions, facts)
    return F.when(decided.isNotNull(), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(named)))


def rendered(one: Column) -> Column:
    return F.concat(one["fact"], F.when(one["op"] == "neq", F.lit(" != ")).when(one["op"] == "in", F.lit(" in ")).otherwise(F.lit(" = ")), F.array_join(one["values"], ", "))
