"""Labels and redaction."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of values that must not leave, and what stands for them.
REDACTIONS = {
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}": "<email>",
    r"\+?\d[\d ()-]{7,}\d": "<phone>",
    r"\d{4,}": "<digits>",
}


def label(type_: Column, labels: Mapping[str, str] | None = None) -> Column:
    """The alphabet's label, or the type's name in words."""
    plain = F.regexp_replace(F.regexp_replace(type_, r"^[a-z]+:", ""), r"[_-]+", " ")
    if not labels:
        return plain
    named = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.coalesce(named[type_], plain)


def redact_text(text: Column, rules: Mapping[str, str] = REDACTIONS) -> Column:
    for pattern, instead in rules.items():
        text = F.regexp_replace(text, pattern, instead)
    return text


def redact_slots(slots: Column, strategies: Mapping[str, str], otherwise: str | None = None, salt: str = "") -> Column:
    """A map of slots by strategy: `token` (a fixed word), `hash` (16 digits), `drop`; `otherwise` for those not named, or kept.

    Null values pass.
    """
    def strategy(key: Column) -> Column:
        chosen = F.lit(otherwise).cast("string")
        for name, kind in strategies.items():
            chosen = F.when(key == name, F.lit(kind)).otherwise(chosen)
        return chosen

    kept = F.map_filter(slots, lambda k, v: F.coalesce(strategy(k), F.lit("keep")) != "drop")
    return F.transform_values(
        kept,
        lambda k, v: F.when(v.isNull(), v).when(strategy(k) == "token", F.concat(F.lit("<"), k, F.lit(">"))).when(strategy(k) == "hash", F.substring(F.sha2(F.concat(F.lit(salt), v), 256), 1, 16)).otherwise(v),
    )
