"""Advice at a decision: rules with three-valued checks, and what is said of them.

A request is a row: request, operator, considering (an action or null), seq, types before it in the episode and the contact,
facts. Only adjudicated (real) rules speak. Where a fact is missing a rule is neither kept nor broken: it abstains and names it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.logic import all_of, unknown_facts
from .facts import overlaid
from .patterns import EXACTLY, IMPLIES, ONCE, SAME, WITHOUT

#: Later layers win.
LAYERS = ("observed", "slots", "intent", "caller")
REQUESTS = (
    "request string, operator string, considering string, considering_slots map<string,string>, before array<string>, contact_before array<string>,"
    " contact_slots array<struct<type:string,slots:map<string,string>>>, facts map<string,string>"
)


def merged_facts(*layers: Column) -> Column:
    """Observations, slots, the intent and the caller's own facts, of which the last has its way."""
    empty = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    out = empty
    for layer in layers:
        out = overlaid(out, F.coalesce(layer, empty))
    return out


def check_request(row: dict) -> list[str]:
    """What is wrong with a request, by path."""
    wrong = []
    if not isinstance(row.get("operator"), str) or not row["operator"]:
        wrong.append("operator: must be a non-empty string")
    episode = row.get("episode")
    if not isinstance(episode, dict) or not isinstance(episode.get("events"), list):
        wrong.append("episode.events: must be a list")
    for at, event in enumerate(((episode or {}).get("events") or []) if isinstance(episode, dict) else []):
        if not isinstance(event, dict) or not isinstance(event.get("type"), str):
            wrong.append(f"episode.events[{at}].type: must be a string")
    for fact, value in (row.get("facts") or {}).items():
        if not isinstance(value, (str, int, float, bool, type(None))):
            wrong.append(f"facts.{fact}: must be a scalar")
    return wrong


def servable(rules: DataFrame, recommendable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules that may speak, action and number of recommendations withheld)."""
    real = rules.where("status = 'real'").join(F.broadcast(recommendable.select(F.col("action").alias("subject"), "may")), "subject", "left")
    blocked = (F.col("family") == "recommendation") & ~F.coalesce("may", F.lit(False))
    return real.where(~blocked).drop("may"), real.where(blocked).groupBy("subject").count()


def same_slot_events() -> tuple[Column, Column]:
    """Whether a guard on the considered object is among the events, and whether one is there that may be on it.

    The episode's own events are searched too, with or without a contact. A guard that only its type is known of may be on the object.
    """
    slot = F.col("slot")
    told = F.coalesce("contact_slots", F.array().cast("array<struct<type:string,slots:map<string,string>>>"))
    same_type = lambda e: F.array_contains("guards", e["type"])
    found = F.exists(told, lambda e: F.coalesce(same_type(e) & (e["slots"][slot] == F.col("considering_slots")[slot]), F.lit(False)))
    untold = F.exists(told, lambda e: F.coalesce(same_type(e) & e["slots"][slot].isNull(), F.lit(False)))
    types = F.transform(told, lambda e: e["type"])
    seen = F.array_union(F.coalesce("before", F.array().cast("array<string>")), F.coalesce("contact_before", F.array().cast("array<string>")))
    return found, untold | F.exists("guards", lambda g: F.array_contains(seen, g) & ~F.array_contains(types, g))


def keeps() -> Column:
    """Whether an obligation is kept by a request: true, false, or null where the request doesn't tell."""
    guard, types = F.col("guards")[0], F.col("before")
    in_episode = F.array_contains("before", guard)
    contact = F.when(in_episode, True).otherwise(F.array_contains("contact_before", guard))  # null without a contact
    value = F.col("considering_slots")[F.col("slot")]
    found, unsure = same_slot_events()
    count = lambda t: F.size(F.filter(types, lambda x: x == t))
    return (
        F.when(F.col("pattern") == IMPLIES, in_episode)
        .when(F.col("pattern") == WITHOUT, contact)
        .when(F.col("pattern") == ONCE, count(F.col("subject")) == 0)
        .when(F.col("pattern") == EXACTLY, count(guard) == 1)
        .when(F.col("pattern") == SAME, F.when(value.isNull(), None).when(found, True).when(F.col("contact_before").isNull() | unsure, None).otherwise(False))
    )


def structural_unknowns() -> Column:
    """What a check needs that the request doesn't have, whatever is known of the conditions."""
    none = F.array().cast("array<string>")
    value = F.col("considering_slots")[F.col("slot")]
    return (
        F.when((F.col("pattern") == WITHOUT) & ~F.array_contains("before", F.col("guards")[0]) & F.col("contact_before").isNull(), F.array(F.lit("contact")))
        .when((F.col("pattern") == SAME) & value.isNull(), F.array(F.concat(F.lit("considering.slot."), "slot")))
        .when((F.col("pattern") == SAME) & keeps().isNull() & F.col("contact_before").isNull(), F.array(F.lit("contact")))
        .when((F.col("pattern") == SAME) & keeps().isNull(), F.array(F.concat(F.lit("slot."), "slot")))
        .otherwise(none)
    )


def advise(requests: DataFrame, obligations: DataFrame, recommendations: DataFrame) -> DataFrame:
    """request, operator, considering, verdict, why, warned, cleared, recommended, missing for every request.

    obligations: operator, id, pattern, subject, guards, slot, conditions. recommendations: operator, id, action,
    conditions. warn: a rule about the considered action is broken; recommend: an antecedent is true; clear: rules were
    kept and nothing is missing; otherwise abstain, for an unknown fact or because nothing covers the request.
    """
    none = F.array().cast("array<string>")
    asked = requests.join(F.broadcast(obligations.withColumnRenamed("operator", "op")), (F.col("operator") == F.col("op")) & (F.col("considering") == F.col("subject")))
    asked = asked.withColumns({"applies": all_of(F.col("conditions"), F.col("facts")), "kept": keeps(), "unknown": unknown_facts(F.col("conditions"), F.col("facts")), "lacking": structural_unknowns()})
    speaks = F.coalesce(F.col("applies"), F.lit(True))
    duties = asked.groupBy("request").agg(
        F.array_sort(F.collect_set(F.when(F.col("applies") & ~F.col("kept"), F.col("id")))).alias("warned"),
        F.array_sort(F.collect_set(F.when(F.col("applies") & F.col("kept"), F.col("id")))).alias("cleared"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(speaks, F.concat("unknown", "lacking")).otherwise(none))))).alias("duty_missing"),
    )
    hints = requests.select("request", F.col("operator").alias("op"), "facts").join(F.broadcast(recommendations), F.col("op") == F.col("operator")).withColumns(
        {"applies": all_of(F.col("conditions"), F.col("facts")), "unknown": unknown_facts(F.col("conditions"), F.col("facts"))}
    )
    hints = hints.groupBy("request").agg(
        F.array_sort(F.collect_set(F.when(F.col("applies"), F.col("action")))).alias("recommended"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("unknown")))).alias("hint_missing")
    )
    rows = requests.select("request", "operator", "considering").join(duties, "request", "left").join(hints, "request", "left")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("warned", "cleared", "recommended", "duty_missing", "hint_missing")})
    rows = rows.withColumn("missing", F.array_sort(F.array_union("duty_missing", "hint_missing"))).drop("duty_missing", "hint_missing")
    clear = (F.size("cleared") > 0) & (F.size("missing") == 0)
    verdict = F.when(F.size("warned") > 0, "warn").when(F.size("recommended") > 0, "recommend").when(clear, "clear").otherwise("abstain")
    why = F.when(verdict == "abstain", F.when(F.size("missing") > 0, "unknown_fact").otherwise("uncovered"))
    return rows.withColumns({"verdict": verdict, "why": why})


def coverage(answers: DataFrame) -> DataFrame:
    """operator, verdict, why, answers."""
    return answers.groupBy("operator", "verdict", "why").agg(F.count("*").alias("answers"))


def top_missing(answers: DataFrame, most: int = 10) -> DataFrame:
    """fact, requests: what was missing most."""
    return answers.select(F.explode("missing").alias("fact")).groupBy("fact").agg(F.count("*").alias("requests")).orderBy(F.col("requests").desc(), "fact").limit(most)


def replay_metrics(answers: DataFrame, taken: DataFrame) -> DataFrame:
    """One row: points, answered, warned, cleared, recommended, agreed, and of agreed ones with an outcome the good ones.

    taken: request, action, good.
    """
    rows = answers.join(taken, "request")
    said = F.col("verdict") != "abstain"
    agreed = F.array_contains("recommended", F.col("action"))
    return rows.agg(
        F.count("*").alias("points"), F.count_if(said).alias("answered"), F.count_if(F.col("verdict") == "warn").alias("warned"), F.count_if(F.col("verdict") == "clear").alias("cleared"),
        F.count_if(F.size("recommended") > 0).alias("recommended"), F.count_if(agreed).alias("agreed"),
        F.count_if(agreed & F.col("good").isNotNull()).alias("judged"), F.count_if(agreed & F.col("good")).alias("good"),
    )


def observation_yield(without: DataFrame, with_: DataFrame) -> DataFrame:
    """One row: how many answers observations changed from abstaining, and warnings they raised; and withdrew, which must be none."""
    both = without.select("request", F.col("verdict").alias("a")).join(with_.select("request", F.col("verdict").alias("b")), "request")
    return both.agg(
        F.count_if(F.col("a") != "abstain").alias("answered_without"), F.count_if((F.col("a") == "abstain") & (F.col("b") != "abstain")).alias("because_of"),
        F.count_if((F.col("a") != "warn") & (F.col("b") == "warn")).alias("warnings_raised"), F.count_if((F.col("a") == "warn") & (F.col("b") != "warn")).alias("warnings_withdrawn"),
    )
