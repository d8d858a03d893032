"""From raw records to typed events, episodes and outcomes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CONSEQUENCES, UNKNOWN_TYPE


def classify(features: Mapping[str, Column], entries: Sequence[tuple[str, Mapping[str, str]]]) -> Column:
    """The first entry (type, wanted features) that matches; `unknown` if none does.

    A type may hold ${feature} places; an empty one makes it unknown.
    """
    chosen = F.lit(UNKNOWN_TYPE)
    for type_, wanted in reversed(entries):
        match = reduce(lambda a, b: a & b, (features[k] == v for k, v in wanted.items()), F.lit(True))
        name: Column = F.lit(type_)
        empty = F.lit(False)
        for feature, value in features.items():
            place = "${" + feature + "}"
            if place in type_:
                name = F.replace(name, F.lit(place), F.coalesce(value, F.lit("")))
                empty = empty | (F.coalesce(value, F.lit("")) == "")
        chosen = F.when(F.coalesce(match, F.lit(False)), F.when(empty, UNKNOWN_TYPE).otherwise(name)).otherwise(chosen)
    return chosen


def contact_order(*then: str) -> Window:
    return Window.partitionBy("interaction").orderBy("at", *then)


def one_episode(events: DataFrame) -> DataFrame:
    return events.withColumn("episode", F.concat("interaction", F.lit("#0")))


def episodes_at(events: DataFrame, begins: Column, order: Window) -> DataFrame:
    """A new episode at each event for which `begins` holds, counted along the contact."""
    number = F.sum(F.coalesce(begins, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("episode", F.concat_ws("#", "interaction", number.cast("string")))


def after_gap(at: str, gap: str, order: Window) -> Column:
    """Begins: nothing before, or more than `gap` (an interval) before."""
    before = F.lag(at).over(order)
    return before.isNull() | (F.col(at) > before + F.expr(f"INTERVAL {gap}"))


def classify_outcomes(events: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """interaction, outcome: of rules (label, `any_event` or `closed_without`, type) the first that holds, or null."""
    seen = {t: F.bool_or(F.col("type") == t) for _, _, t in rules}
    flags = events.groupBy("interaction").agg(*(c.alias(f"has {t}") for t, c in seen.items()))
    label = F.lit(None).cast("string")
    for name, how, type_ in reversed(rules):
        has = F.col(f"`has {type_}`")
        label = F.when(has if how == "any_event" else ~has, name).otherwise(label)
    return flags.select("interaction", label.alias("outcome"))


def scope_by(events: DataFrame, hint: str) -> DataFrame:
    """A hint of the source takes the operator's place; team and agent are cleared."""
    if hint not in events.columns:
        raise ValueError(f"no hint named {hint}")
    nothing = F.lit(None).cast("string")
    return events.withColumns({"operator": F.col(hint), "team": nothing, "agent": nothing})


def is_action() -> Column:
    return (F.col("kind") == "action") & (F.col("type") != UNKNOWN_TYPE)


def consequence_rank(consequence: Column) -> Column:
    """From 0; an undeclared type counts as irreversible."""
    ranks = F.create_map(*(x for k, c in enumerate(CONSEQUENCES) for x in (F.lit(c), F.lit(k))))
    return F.coalesce(ranks[consequence], F.lit(len(CONSEQUENCES) - 1))


def consequential(events: DataFrame, alphabet: DataFrame, floor: str = "compensable") -> DataFrame:
    """Actions at or above the floor, with identity and recommendable of their type."""
    terms = F.broadcast(alphabet.select("type", "consequence", "identity", "recommendable"))  # as many as action types
    typed = events.where(is_action()).join(terms, "type", "left")
    declared = F.col("consequence").isNotNull()
    return typed.where(consequence_rank(F.col("consequence")) >= CONSEQUENCES.index(floor)).withColumns(
        {"recommendable": F.when(declared, F.coalesce("recommendable", F.col("consequence") != "irreversible")).otherwise(False), "identity": F.coalesce("identity", F.array().cast("array<string>"))}
    )
