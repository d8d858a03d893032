"""Mining: from typed events to a table of rules with evidence, provenance, status and identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import condition_json, rule_id
from ..functions.text import label
from ..operators.facts import condition_text, conditioned, discriminating, vocabulary
from ..operators.instances import KEY
from ..operators.instances import instances as instances_of
from ..operators.patterns import ONCE, PATTERNS, SAME, VACUOUS_EPISODE, candidates, checks, measured, of_pattern, union_of
from ..operators.provenance import evidence, verdicts
from ..operators.rulesets import settle
from ..reuse import written
from ..schema import Thresholds


def sentence(template: str) -> Column:
    """A pattern's template with labels of the subject and guards, as a column of `specs`."""
    subject, guards = label(F.col("subject")), F.array_join(F.transform("guards", lambda g: label(g)), " or ")
    out = F.lit(template)
    for place, value in (
        ("{X_type}", F.col("subject")), ("{x}", subject), ("{X}", F.concat(F.upper(F.substring(subject, 1, 1)), F.substring(subject, F.lit(2), F.length(subject)))),
        ("{y}", guards), ("{Y}", F.array_join("guards", "', '")), ("{s}", F.coalesce("slot", F.lit(""))),
    ):
        out = F.replace(out, F.lit(place), value)
    return out


def by_template(field: str) -> Column:
    out = F.lit(None).cast("string")
    for p in PATTERNS:
        out = F.when(F.col("pattern") == p.name, sentence(getattr(p, field))).otherwise(out)
    return out


def identified(rules: DataFrame) -> DataFrame:
    """rules with id, from pattern, subject, guards, slot, conditions and window."""
    bindings = {
        "guard": F.when((F.col("pattern") != SAME) & (F.size("guards") == 1), F.col("guards")[0]),
        "guards": F.when(F.col("pattern") == SAME, F.array_join("guards", "|")),
        "slot": F.col("slot"),
        "subject": F.col("subject"),
    }
    value = lambda v: F.when(v.isin("true", "false"), v).otherwise(F.concat(F.lit('"'), v, F.lit('"')))
    conditions = F.transform("conditions", lambda c: condition_json(c["fact"], c["op"], value(c["values"][0])))
    return rules.withColumn("id", rule_id(F.lit("obligation"), F.col("pattern"), bindings, conditions, F.col("window")))


def mine(events: DataFrame, alphabet: DataFrame, t: Thresholds = Thresholds(), floor: str = "compensable", facts: DataFrame | None = None, requested: DataFrame | None = None) -> DataFrame:
    """The rule table, a row for each operator and rule that could be measured there.

    id, operator, pattern, window, subject, guards, slot, conditions, condition_key, verdict, level, scope, found_in, holds, of,
    corpus_holds, corpus_of, failing, status, reason, suppressed_by, text, why, predicate, evidence. facts: KEY, facts
    of instances, for conditioned variants. requested: pattern, subject, guards, slot, conditions a person asked for.
    """
    events = written(events)
    found = instances_of(events, alphabet, floor)
    if facts is not None:
        found = found.join(facts, KEY, "left")
    enough = found.groupBy("operator", "subject").count().where(F.col("count") >= t.min_instances).drop("count")
    found = found.join(F.broadcast(enough), ["operator", "subject"], "left_semi")
    found = written(found)
    suggested = written(candidates(found, events, alphabet, t))
    specs = written(union_of(suggested))
    floors = of_pattern(F.col("pattern"), {p.name: getattr(t, p.floor) for p in PATTERNS})
    if facts is not None:
        plain = written(checks(found, specs, events, alphabet, ("facts",)))
        support = measured(plain, False).where("level = 'operator'")
        failing = support.where(F.col("holds") / F.col("of") < floors).select("spec", "operator", "pattern")
        words = vocabulary(found, t)
        subjects = plain.join(F.broadcast(specs.select("spec", "subject")), "spec")
        wanted = discriminating(subjects, failing, words, t).select("operator", "spec", "subject", "fact", "value", F.lit(1).alias("n"))
        owned = specs.join(wanted.select("operator", "spec").distinct(), "spec").select("operator", "spec", "pattern", "subject", "guards", "slot", "conditions")
        extra = conditioned(owned, wanted.drop("spec")).join(wanted.select("operator", "spec").distinct(), ["operator", "spec"]).drop("spec")
        specs = written(union_of(suggested.unionByName(extra.select(suggested.columns))))
    if requested is not None:
        specs = specs.unionByName(union_of(requested.withColumn("operator", F.lit("")).select(suggested.columns))).dropDuplicates(["spec"])
    support = written(measured(checks(found, specs, events, alphabet)))
    rules = judged(verdicts(support, t).join(F.broadcast(specs), ["spec", "pattern"]), t)
    rules = settle(rules)
    when = F.concat(F.when(F.size("conditions") > 0, F.concat(F.lit("Where "), condition_text(), F.lit(": "))).otherwise(""), by_template("text"))
    rules = rules.withColumns({"text": when, "why": by_template("why"), "predicate": by_template("predicate")})
    return rules.withColumn("evidence", evidence(F.col("why")))


def judged(rules: DataFrame, t: Thresholds) -> DataFrame:
    """Measured specs with their verdicts as rules: also window, condition_key, id, status, reason. Those kept here that don't reach their pattern's floor go."""
    floors = of_pattern(F.col("pattern"), {p.name: getattr(t, p.floor) for p in PATTERNS})
    window = of_pattern(F.col("pattern"), {p.name: p.window for p in PATTERNS})
    rules = rules.withColumns({"window": window, "condition_key": F.coalesce(F.to_json("conditions"), F.lit("[]"))})
    rules = rules.where((F.col("verdict") != "own") | (F.col("holds") / F.col("of") >= floors))
    vacuous = (F.col("pattern") == ONCE) & (F.col("corpus_holds") == F.col("corpus_of"))
    status = F.when(vacuous, "suppressed").when(F.col("verdict") == "neither", "refused").otherwise("proposed")
    return identified(rules).withColumns({"status": status, "reason": F.when(vacuous, VACUOUS_EPISODE)})


def ordered(rules: DataFrame) -> DataFrame:
    """As a report lists them."""
    from ..schema import STATUSES

    place = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    return rules.orderBy("operator", place, (F.col("holds") / F.col("of")).desc(), F.col("of").desc(), "id")


def statistics(rules: DataFrame) -> DataFrame:
    """operator (null: all), proposed, refused, suppressed, contradicted, rules."""
    kinds = ("proposed", "refused", "suppressed", "contradicted")
    return rules.rollup("operator").agg(*(F.count_if(F.col("status") == k).alias(k) for k in kinds), F.count("*").alias("rules"))


