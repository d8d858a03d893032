"""Rule ids: the same rule has the same id in every run, whatever its figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a rule is about, in the order of the names; absent ones are left out.
BINDINGS = ("action", "guard", "guards", "slot", "subject")


def json_text(value: Column) -> Column:
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'^\{"v":(.*)\}$', 1)


def condition_json(fact: Column, op: Column, value_json: Column) -> Column:
    """value_json: the value as JSON, so that true and "true" differ."""
    return F.concat(F.lit('{"fact":'), json_text(fact), F.lit(',"op":'), json_text(op), F.lit(',"value":'), value_json, F.lit("}"))


def rule_id(family: Column, pattern: Column, bindings: dict[str, Column], conditions: Column, window: Column) -> Column:
    """First 16 hexadecimal digits of the sha256 of the rule as JSON, keys and conditions sorted.

    conditions: an array of what condition_json gives.
    """
    about = F.to_json(F.struct(*(bindings[k].alias(k) for k in BINDINGS if k in bindings)))
    text = F.concat(
        F.lit('{"bindings":'), about, F.lit(',"conditions":['), F.array_join(F.array_sort(conditions), ","), F.lit('],"family":'), json_text(family),
        F.lit(',"pattern":'), json_text(pattern), F.lit(',"window":'), json_text(window), F.lit("}"),
    )
    return F.substring(F.sha2(text, 256), 1, 16)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)
