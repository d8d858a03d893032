"""Antecedent -> action recommendations: a levelwise search over what was known when people decided.

A node is a set of conditions, one a fact, in the order of its items. Items are few (facts with repeated values), and each
level is a join of the nodes with the items of the decision points they select; the loop is over levels only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..reuse import written
from ..schema import GOOD_OUTCOMES, Thresholds
from .facts import vocabulary
from .instances import ACTOR
from .provenance import verdicts


def points_of(decided: DataFrame) -> DataFrame:
    """point, ACTOR, action, facts, good (null: unknown) from decision points with facts and outcome."""
    good = F.when(F.col("outcome").isNotNull(), F.col("outcome").isin(*GOOD_OUTCOMES))
    return decided.select(F.col("episode").alias("point"), *ACTOR, F.col("subject").alias("action"), "facts", good.alias("good"))


def items_of(points: DataFrame, t: Thresholds) -> DataFrame:
    """operator, item (numbered by fact and value), fact, value."""
    order = Window.partitionBy("operator").orderBy("fact", "value")
    return vocabulary(points, t, ("operator",)).withColumn("item", F.row_number().over(order)).select("operator", "item", "fact", "value")


def floor_of(length: int, t: Thresholds) -> int:
    from math import ceil

    return ceil(t.min_instances * max(1, length) ** t.antecedent_floor_exponent)


def node_key(items: Column) -> Column:
    return F.array_join(items.cast("array<string>"), ",")


def agreements(members: DataFrame) -> DataFrame:
    """operator, node, items, action, matched, selected, good, judged of nodes' members (operator, node, items, point, action, good)."""
    keys = ["operator", "node", "items"]
    total = members.groupBy(*keys).agg(F.count("*").alias("selected"))
    by_action = members.groupBy(*keys, "action").agg(F.count("*").alias("matched"), F.count_if("good").alias("good"), F.count("good").alias("judged"))
    return by_action.join(total, keys)


def subsets(rows: DataFrame) -> DataFrame:
    """rows with sub and sub_items: each node with one item left out, and its key."""
    without = F.transform(F.sequence(F.lit(0), F.size("items") - 1), lambda k: F.filter("items", lambda x, i: i != k))
    return rows.withColumn("sub_items", F.explode(without)).withColumn("sub", node_key(F.col("sub_items")))


def members_of(nodes: DataFrame, having: DataFrame) -> DataFrame:
    """The members of nodes (operator, node, items) that the search didn't visit: the points that have all their items."""
    terms = nodes.withColumn("item", F.explode("items"))
    met = terms.join(having, ["operator", "item"]).groupBy("operator", "node", "items", "point", "action", "good").agg(F.count("*").alias("met"))
    return met.where("met = size(items)").drop("met")


def recommend(points: DataFrame, recommendable: DataFrame, t: Thresholds = Thresholds()) -> tuple[DataFrame, DataFrame]:
    """(rules, withheld): operator, node, items, conditions, action, matched, selected, good, judged; and operator, action, candidates.

    Shortest first: a node under which an action reaches its floor is explained, and a node is visited only as an extension of
    one that was visited, had no explained part and explained nothing. A longer one must beat each part by recommend_gain; of parts that weren't visited,
    those of nodes that would be rules are measured for it. Actions that may not be recommended explain all
    the same, but are withheld and counted. recommendable: action, may.
    """
    items = items_of(points, t)
    having = points.select("operator", "point", "action", "good", F.explode("facts").alias("fact", "value")).join(F.broadcast(items), ["operator", "fact", "value"])
    having = written(having.select("operator", "point", "action", "good", "item", "fact"))
    members = having.select("operator", F.col("item").cast("string").alias("node"), F.array("item").alias("items"), "point", "action", "good")
    rules, known, explained = None, None, None
    for length in range(1, t.antecedent_max_length + 1):
        live = found = written(agreements(members).where(F.col("selected") >= t.min_instances))
        if explained is not None:
            dead = subsets(found.select("operator", "node", "items").distinct()).join(explained, ["operator", "sub"], "left_semi").select("operator", "node").distinct()
            live = live.join(dead, ["operator", "node"], "left_anti")
        clears = fresh = live.where((F.col("matched") / F.col("selected") >= t.recommend_agreement) & (F.col("matched") >= floor_of(length, t)))
        if length > 1:
            clears = written(clears)
            asked = subsets(clears.select("operator", "node", "items").distinct()).select("operator", F.col("sub").alias("node"), F.col("sub_items").alias("items")).distinct()
            unseen = asked.join(known.select("operator", "node").distinct(), ["operator", "node"], "left_anti")
            parts = known.unionByName(agreements(members_of(unseen, having)))
            parts = parts.select("operator", F.col("node").alias("sub"), "action", (F.col("matched") / F.col("selected")).alias("part"))
            beaten = subsets(clears).join(parts, ["operator", "sub", "action"], "left").where(F.col("matched") / F.col("selected") < F.coalesce("part", F.lit(0.0)) + t.recommend_gain)
            fresh = clears.join(beaten.select("operator", "node", "action").distinct(), ["operator", "node", "action"], "left_anti")
        rules = fresh if rules is None else rules.unionByName(fresh)
        known = found
        if length == t.antecedent_max_length:
            break
        done = clears.select("operator", F.col("node").alias("sub")).distinct()
        going_on = live.select("operator", "node").distinct().join(done.withColumnRenamed("sub", "node"), ["operator", "node"], "left_anti")
        explained = done if explained is None else explained.unionByName(done)
        nodes = members.select("operator", "node", "items", "point", "action", "good").join(going_on, ["operator", "node"], "left_semi")
        more = having.select("operator", "point", "item")
        grown = nodes.join(more, ["operator", "point"]).where(F.col("item") > F.element_at("items", -1))
        # one value a fact: a point has one value of each, so that two items of one fact never meet
        members = grown.select("operator", F.concat_ws(",", "node", F.col("item").cast("string")).alias("node"), F.concat("items", F.array("item")).alias("items"), "point", "action", "good")
        large = members.groupBy("operator", "node").count().where(F.col("count") >= t.min_instances).select("operator", "node")
        members = written(members.join(large, ["operator", "node"], "left_semi"))
    named = rules.withColumn("item", F.explode("items")).join(F.broadcast(items), ["operator", "item"])
    text = F.concat("fact", F.lit(" = "), "value")
    conditions = named.groupBy("operator", "node").agg(F.array_sort(F.collect_set(text)).alias("conditions"))
    rules = rules.join(conditions, ["operator", "node"]).join(F.broadcast(recommendable.select("action", "may")), "action", "left").withColumn("may", F.coalesce("may", F.lit(False)))
    withheld = rules.where("not may").groupBy("operator", "action").agg(F.count("*").alias("candidates"))
    return rules.where("may").drop("may"), withheld


def with_provenance(rules: DataFrame, points: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """rules (operator, conditions, action) with verdict, level, scope, found_in, holds, of, corpus_holds, corpus_of: whether the operator, one of its teams or agents does so, or others do.

    A rule is an antecedent and an action; it is scored once at every operator, team and agent that meets the antecedent,
    by joining its conditions with the facts of all decision points. The points of a fact are spread over tasks by the join, and counted before they are shuffled again.
    """
    spec = F.concat_ws("\x1f", F.array_join("conditions", " and "), "action")
    asked = rules.select(spec.alias("spec"), "conditions", F.col("action").alias("advised")).dropDuplicates(["spec"])
    terms = asked.select("spec", "advised", F.size("conditions").alias("many"), F.explode("conditions").alias("condition"))
    known = points.select("point", *ACTOR, "action", F.explode(F.transform(F.map_entries("facts"), lambda e: F.concat(e["key"], F.lit(" = "), e["value"]))).alias("condition"))
    met = terms.join(known, "condition").groupBy("spec", "advised", "many", "point", *ACTOR, "action").agg(F.count("*").alias("met")).where("met = many")
    levels = F.explode(F.array(*(F.struct(F.lit(level).alias("level"), F.col(level).alias("scope")) for level in ACTOR)))
    at = met.withColumn("at", levels).select("*", "at.*").where("scope is not null").withColumn("pattern", F.lit("antecedent-implies-action"))
    support = at.groupBy("spec", "pattern", "operator", "level", "scope").agg(F.count_if(F.col("action") == F.col("advised")).alias("holds"), F.count("*").alias("of"))
    judged = verdicts(support.withColumns({"n": F.col("of"), "failing": F.lit(None).cast("string")}), t).drop("pattern", "failing")
    return rules.withColumn("spec", spec).join(judged, ["spec", "operator"]).drop("spec")


def matches(rules: DataFrame, points: DataFrame) -> DataFrame:
    """rule, point: the points of each rule's operator and action for which all its conditions are true. rules: rule, operator, action, conditions."""
    known = points.select("operator", "action", "point", F.explode(F.transform(F.map_entries("facts"), lambda e: F.concat(e["key"], F.lit(" = "), e["value"]))).alias("condition"))
    asked = rules.select("rule", "operator", "action", F.size("conditions").alias("many"), F.explode("conditions").alias("condition"))
    met = asked.join(known, ["operator", "action", "condition"]).groupBy("rule", "point", "many").agg(F.count("*").alias("met"))
    return met.where("met = many").select("rule", "point")


def covered(rules: DataFrame, points: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """The rules that answer something new, for each operator and action the broadest first.

    One whose points are mostly answered already stays only if it lies in a single broader rule and is more accurate. The
    choice is greedy, one rule after another, but made for all groups at once and for as many rules as can be decided: one that would be
    new even if all open rules before it stayed; one that isn't new and beats no rule before it; and one that meets no open rule before it,
    by what it shares with those that stayed. The first open rule of a group always is of the last kind. Counts are by point and by rule, so
    that a group's points are never in one task.
    """
    named = rules.select("operator", "action", "node", "conditions", (F.col("matched") / F.col("selected")).alias("rate"), "matched")
    order = Window.partitionBy("operator", "action").orderBy(F.col("matched").desc(), F.array_join("conditions", " and "), "node")
    open_ = written(named.withColumns({"rank": F.row_number().over(order), "rule": F.concat_ws("\x1f", "operator", "action", "node")}))
    met = matches(open_, points).join(open_.select("rule", "operator", "action", "rank", "rate"), "rule")
    met = written(met.withColumn("place", F.concat_ws("\x1f", "operator", "action", "point")).select("rule", "place", "rank", "rate"))
    size = met.groupBy("rule").agg(F.count("*").alias("size"))
    state = written(open_.select("rule", "operator", "action", "rank", "rate").join(size, "rule").withColumn("stays", F.lit(None).cast("boolean")))
    earlier = Window.partitionBy("operator", "action").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    while not state.where("stays is null").isEmpty():
        some = met.join(state.select("rule", "stays"), "rule").where("stays or stays is null")
        first = some.groupBy("place").agg(F.min(F.when(F.col("stays"), F.col("rank"))).alias("taken"), F.min(F.when(F.col("stays").isNull(), F.col("rank"))).alias("asked"))
        rows = some.where("stays is null").join(first, "place")
        taken, asked = F.coalesce(F.col("taken") < F.col("rank"), F.lit(False)), F.col("asked") < F.col("rank")
        counts = rows.groupBy("rule").agg(F.count_if(~taken).alias("new"), F.count_if(~taken & ~asked).alias("new_at_least"), F.count_if(asked).alias("shared"))
        lowest = F.min(F.when(F.col("stays") | F.col("stays").isNull(), F.col("rate"))).over(earlier)
        known = written(state.withColumn("lowest", lowest).join(counts, "rule", "left"))
        old = F.col("new") < t.recommend_novelty * F.col("size")
        sure = F.when(F.col("new_at_least") >= t.recommend_novelty * F.col("size"), True).when(old & (F.col("lowest").isNull() | (F.col("rate") <= F.col("lowest") + t.recommend_gain)), False)
        known = known.withColumn("now", F.coalesce("stays", sure))
        # alone: nothing before them is open, so that those that stayed are the rules they are compared with
        alone = known.where(F.col("now").isNull() & (F.col("shared") == 0)).select("rule", "size")
        mine = met.join(alone, "rule").select("rule", "place", "rank", "rate", "size")
        theirs = met.join(state.where("stays").select("rule"), "rule", "left_semi").select("place", F.col("rule").alias("host"), F.col("rank").alias("host_rank"), F.col("rate").alias("host_rate"))
        shared = mine.join(theirs, "place").where("host_rank < rank").groupBy("rule", "size", "rate", "host", "host_rank", "host_rate").agg(F.count("*").alias("both"))
        best = shared.groupBy("rule", "size", "rate").agg(F.max_by(F.struct("both", "host_rate"), F.struct("both", -F.col("host_rank"))).alias("best"))
        better = (F.col("best.both") >= 0.9 * F.col("size")) & (F.col("rate") > F.col("best.host_rate") + t.recommend_gain)
        chosen = alone.join(best.select("rule", better.alias("better")), "rule", "left").select("rule", F.coalesce("better", F.lit(False)).alias("decided"))
        fresh = ~old & (F.col("shared") == 0)
        now = known.join(chosen, "rule", "left").withColumn("stays", F.coalesce("now", F.when(fresh, True), F.when(F.col("shared") == 0, F.col("decided"))))
        state = written(now.select(*state.columns))
    kept = state.where("stays").join(open_.select("rule", "node"), "rule").select("operator", "action", "node")
    return rules.join(kept, ["operator", "action", "node"], "left_semi")


def lift(rules: DataFrame, points: DataFrame) -> DataFrame:
    """rules with base and base_of: how often the action was taken at all."""
    total = points.groupBy("operator").agg(F.count("*").alias("base_of"))
    taken = points.groupBy("operator", "action").agg(F.count("*").alias("base"))
    return rules.join(taken, ["operator", "action"]).join(total, "operator")


def lift_in_strata(points: DataFrame, fact: str, value: str, stratum: str) -> DataFrame:
    """operator, action, stratum, with_fact, with_of, without, without_of: the action's rate with and without fact = value, by another fact."""
    has = F.col("facts")[fact] == value
    rows = points.where(has.isNotNull()).withColumns({"has": has, "stratum": F.col("facts")[stratum]})
    total = rows.groupBy("operator", "stratum").agg(F.count_if("has").alias("with_of"), F.count_if(~F.col("has")).alias("without_of"))
    taken = rows.groupBy("operator", "stratum", "action").agg(F.count_if("has").alias("with_fact"), F.count_if(~F.col("has")).alias("without"))
    return taken.join(total, ["operator", "stratum"])


def as_rules(rules: DataFrame, points: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Recommendations as rows of the rule table: id, operator, pattern, window, action, conditions, holds, of, verdict, status, text.

    Agreement is support; the verdict is that of with_provenance, or, where rules have none, own if it reaches own_support with enough
    decision points. Rules found nowhere are refused.
    """
    from ..functions.identity import condition_json, rule_id
    from ..functions.text import label

    parts = F.transform("conditions", lambda c: F.split(c, " = ", 2))
    value = lambda v: F.when(v.isin("true", "false"), v).otherwise(F.concat(F.lit('"'), v, F.lit('"')))
    conditions = F.transform(parts, lambda p: condition_json(p[0], F.lit("eq"), value(p[1])))
    pattern, window = F.lit("antecedent-implies-action"), F.lit("episode")
    own = (F.col("selected") >= t.min_instances) & (F.col("matched") / F.col("selected") >= t.own_support)
    verdict = F.col("verdict") if "verdict" in rules.columns else F.when(own, "own").otherwise("neither")
    holds, of = ("holds", "of") if "holds" in rules.columns else ("matched", "selected")
    return rules.select(
        rule_id(F.lit("recommendation"), pattern, {"action": F.col("action")}, conditions, window).alias("id"), "operator", pattern.alias("pattern"), window.alias("window"), "action", "conditions",
        F.col(holds).alias("holds"), F.col(of).alias("of"), "good", "judged", verdict.alias("verdict"), F.when(verdict == "neither", "refused").otherwise("proposed").alias("status"),
        F.concat(F.lit("When "), F.array_join("conditions", " and "), F.lit(", "), label(F.col("action")), F.lit(".")).alias("text"),
    )
