"""The engine's own queries over the test corpora, each with the thresholds it states."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.logic import CONDITION, NO_CONDITIONS, all_of, unknown_facts
from .operators import advise as serve
from .operators import audit, diff, evaluate, facts, observe, patterns, provenance, recommend, rulesets, store
from .operators.instances import ACTOR, KEY, as_of, decision_points, earlier, firsts, instances
from .plans import sweep as sweeping
from .plans.mine import identified
from .reuse import kept, shared_folder, written
from .schema import Thresholds
from .sources import rulestore
from .sources.corpora import conversations, order_lines, table, user_events

#: The test data are near random: precedence shares lie near 0.6, and these thresholds let something through.
LOW = replace(Thresholds(), implies_support=0.5, own_support=0.45, guard_support=0.3)
FLOOR = "reversible"
PREDICATES = (
    ("p-data", "obs.mentions_the", "event.text", r"\bthe\b", 0.9, 0.1),
    ("p-long", "obs.asks", "episode.text", r"\?", 0.9, 0.1),
)
PREDICATE = "pred string, fact string, window string, pattern string, assert_at double, refute_at double"
#: A policy for the corpus of orders, written for these queries.
CLAUSES = [
    ("c1", "return only what was shipped", True, None, "precedence", "action:RF", "action:AF", "interaction", False, None, None),
    ("c2", "one open return an order", True, None, "at-most-one", "action:RF", None, "episode", False, None, None),
    ("c3", "acknowledge before closing", True, None, "precedence", "action:AF", "action:RF", "episode", True, None, None),
    ("c4", "urgent orders are settled first", True, None, "precedence", "action:RF", "action:NO", "interaction", False, "episode.intent", "intent:1-URGENT"),
    ("c6", "high priority is settled first", True, None, "precedence", "action:RF", "action:NO", "interaction", False, "episode.intent", "intent:2-HIGH"),
    ("c7", "urgent returns were shipped", True, None, "precedence", "action:RF", "action:AF", "interaction", False, "episode.intent", "intent:1-URGENT"),
    ("c5", "be polite", False, "tone", None, None, None, "interaction", False, None, None),
]


def users(spark, sf_dir):
    events, contacts, terms = user_events(spark, sf_dir)
    events = kept(events)
    return events, contacts, terms, instances(events, terms, FLOOR)


def orders(spark, sf_dir, with_facts: bool = False):
    events, contacts, terms = order_lines(spark, sf_dir)
    events = kept(events)
    found = instances(events, terms)
    if with_facts:
        found = facts.with_facts(found, intents=events.select("episode", "intent").distinct())
    return events, contacts, terms, found


def _written_orders(spark, sf_dir):
    """order_lines() with the events, as far as rules need them, in a table, which is smaller than a cache that goes to disk."""
    events, contacts, terms = order_lines(spark, sf_dir)
    return written(events.select(*KEY, *ACTOR, "at", "kind", "type", "slots", "intent")), contacts, terms


def listed(column: str):
    return F.array_join(F.array_sort(column), "|")


def audit_counts(spark, sf_dir):
    events, _, terms, _ = users(spark, sf_dir)
    return audit.audit(events, terms, floor=FLOOR)


def audit_subjects(spark, sf_dir):
    events, _, terms, _ = users(spark, sf_dir)
    return audit.subjects(events, terms, floor=FLOOR)


def audit_outcomes(spark, sf_dir):
    return audit.outcomes(user_events(spark, sf_dir)[1])


def sessionize_events(spark, sf_dir):
    events = user_events(spark, sf_dir)[0]
    return events.groupBy("interaction", "episode").agg(F.count("*").alias("events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def _guard_stats(spark, sf_dir, scope):
    events, _, _, found = users(spark, sf_dir)
    stats = patterns.guard_stats(found, events, scope)
    return stats.select("operator", "subject", "guard", "n", "instances", F.round("share", 6).alias("share"), "rank")


def guard_stats_episode(spark, sf_dir):
    return _guard_stats(spark, sf_dir, "episode")


def guard_stats_contact(spark, sf_dir):
    return _guard_stats(spark, sf_dir, "interaction")


def specs_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(pattern, subject, guards, slot) without conditions."""
    specs = spark.createDataFrame(rows, "pattern string, subject string, guards array<string>, slot string").withColumn("conditions", F.expr(NO_CONDITIONS))
    return specs.withColumn("spec", patterns.spec_key())


def _orders_support(spark, sf_dir, pattern, pairs, slot=None):
    events, _, terms, found = orders(spark, sf_dir)
    specs = specs_of(spark, [(pattern, s, g, slot) for s, g in pairs])
    checked = patterns.checks(found, specs, events, terms)
    support = patterns.measured(checked, False).where("level = 'operator'").join(F.broadcast(specs.select("spec", "subject", "guards")), "spec")
    return support.select("operator", "subject", listed("guards").alias("guards"), "holds", "of", F.round(F.col("holds") / F.col("of"), 6).alias("ratio"))


PAIRS = [("action:RF", ["action:AF"]), ("action:AF", ["action:RF"]), ("action:RF", ["action:NO"])]


def precedence_episode(spark, sf_dir):
    return _orders_support(spark, sf_dir, patterns.IMPLIES, PAIRS)


def precedence_contact(spark, sf_dir):
    return _orders_support(spark, sf_dir, patterns.WITHOUT, PAIRS)


def at_most_one(spark, sf_dir):
    return _orders_support(spark, sf_dir, patterns.ONCE, [("action:RF", []), ("action:AF", [])])


def exactly_one_per(spark, sf_dir):
    return _orders_support(spark, sf_dir, patterns.EXACTLY, PAIRS)


def same_slot_precedence(spark, sf_dir):
    return _orders_support(spark, sf_dir, patterns.SAME, [("action:RF", ["action:AF", "action:NO"]), ("action:AF", ["action:RF"])], "supplier")


def conditioned_precedence(spark, sf_dir):
    events, _, terms, found = orders(spark, sf_dir, True)
    specs = specs_of(spark, [(patterns.IMPLIES, *PAIRS[0], None)])
    words = facts.vocabulary(found, LOW)
    owned = specs.drop("spec").join(found.select("operator", "subject").distinct(), "subject")
    all_ = facts.conditioned(owned, words).withColumn("spec", patterns.spec_key())
    support = patterns.measured(patterns.checks(found, all_.drop("operator").dropDuplicates(["spec"]), events, terms), False).where("level = 'operator'")
    named = support.join(F.broadcast(all_.select("spec", F.col("conditions")[0]["values"][0].alias("value")).distinct()), "spec")
    return named.select("operator", "value", "holds", "of")


def condition_vocabulary(spark, sf_dir):
    return facts.vocabulary(orders(spark, sf_dir, True)[3], Thresholds()).select("operator", "subject", "fact", "value", "n")


def slots_before(spark, sf_dir):
    """What users' sessions had told before each action that matters."""
    events, _, _, found = users(spark, sf_dir)
    return facts.slots_before(found, events).select("interaction", "episode", "seq", F.col("slots")["k"].alias("k"))


def slot_vocabulary(spark, sf_dir):
    """Conditions on the supplier last met in an order, before actions that matter."""
    events, _, _, found = orders(spark, sf_dir)
    known = facts.with_facts(found, slots=facts.slots_before(found, events))
    return facts.vocabulary(known, Thresholds()).select("operator", "subject", "fact", "value", "n")


def _support_at(spark, sf_dir, level):
    events, _, terms, found = orders(spark, sf_dir)
    specs = specs_of(spark, [(patterns.WITHOUT, s, g, None) for s, g in PAIRS])
    support = patterns.measured(patterns.checks(found, specs, events, terms), False).where(F.col("level") == level).join(F.broadcast(specs.select("spec", "subject", "guards")), "spec")
    return support.select("operator", "scope", "subject", F.col("guards")[0].alias("guard"), "holds", "of", "n")


def support_by_operator(spark, sf_dir):
    return _support_at(spark, sf_dir, "operator")


def support_by_team(spark, sf_dir):
    return _support_at(spark, sf_dir, "team")


def support_by_agent(spark, sf_dir):
    return _support_at(spark, sf_dir, "agent")


def _verdicts(spark, sf_dir):
    events, _, terms, found = orders(spark, sf_dir)
    specs = specs_of(spark, [(patterns.IMPLIES, s, g, None) for s, g in PAIRS])
    t = replace(Thresholds(), own_support=0.3, borrowed_operators=2)
    return provenance.verdicts(patterns.measured(patterns.checks(found, specs, events, terms)), t).join(F.broadcast(specs), ["spec", "pattern"])


def provenance_verdicts(spark, sf_dir):
    rows = _verdicts(spark, sf_dir)
    return rows.select("operator", "subject", F.col("guards")[0].alias("guard"), "verdict", F.coalesce("level", F.lit("")).alias("level"), F.coalesce("scope", F.lit("")).alias("scope"), F.coalesce(listed("found_in"), F.lit("")).alias("found_in"), "holds", "of", "corpus_holds", "corpus_of")


def rule_identity(spark, sf_dir):
    specs = specs_of(spark, [(patterns.IMPLIES, s, g, None) for s, g in PAIRS] + [(patterns.ONCE, "action:RF", [], None), (patterns.SAME, "action:RF", ["action:AF", "action:NO"], "supplier")])
    window = F.when(F.col("pattern") == patterns.SAME, "interaction").otherwise("episode")
    return identified(specs.withColumn("window", window)).select("pattern", "subject", listed("guards").alias("guards"), "id")


def _rule_rows(spark, sf_dir, low=LOW):
    """Rules of users' actions at every operator, as proposed, with situation."""
    events, _, terms, found = users(spark, sf_dir)
    every = [("action:purchase", "action:signup"), ("action:signup", "action:purchase"), ("action:purchase", "action:view"), ("action:purchase", "action:click"), ("action:signup", "action:view"), ("action:signup", "action:click")]
    rows = [(p, s, [g], None) for p in (patterns.IMPLIES, patterns.WITHOUT) for s, g in every]
    specs = specs_of(spark, rows)
    support = patterns.measured(patterns.checks(found, specs, events, terms)).where("level = 'operator'").join(F.broadcast(specs), ["spec", "pattern"])
    window = F.when(F.col("pattern") == patterns.IMPLIES, "episode").otherwise("interaction")
    rules = support.withColumns({"window": window, "condition_key": F.lit("[]"), "status": F.when(F.col("holds") / F.col("of") >= low.own_support, "proposed").otherwise("refused"), "reason": F.lit(None).cast("string"), "corpus_holds": F.col("holds"), "corpus_of": F.col("of")})
    return written(identified(rules))


def contradictions(spark, sf_dir):
    rules = _rule_rows(spark, sf_dir)
    found = rulesets.contradictions(rules.where("status = 'proposed'"))
    return found.select("operator", F.least("subject", "guard").alias("one"), F.greatest("subject", "guard").alias("other")).groupBy("operator", "one", "other").agg(F.count("*").alias("cycles"))


def subsumption_twin(spark, sf_dir):
    rules = _rule_rows(spark, sf_dir).where("status = 'proposed'")
    found = rulesets.implied(rules).where(F.size("by") == 1)
    return found.join(rules, ["operator", "id"]).select("operator", "subject", F.col("guards")[0].alias("guard"))


def subsumption_transitive(spark, sf_dir):
    rules = _rule_rows(spark, sf_dir).where("status = 'proposed'")
    found = rulesets.implied(rules).where(F.size("by") == 2)
    middle = rules.where(F.col("pattern") == patterns.IMPLIES).select("operator", F.col("id").alias("mid"), F.col("guards")[0].alias("through"))
    rows = found.join(rules, ["operator", "id"]).withColumn("mid", F.col("by")[0]).join(middle, ["operator", "mid"])
    return rows.select("operator", "subject", F.col("guards")[0].alias("guard"), "through")


def vacuity_contact(spark, sf_dir):
    rules = _rule_rows(spark, sf_dir).where(F.col("pattern") == patterns.WITHOUT)
    return rules.select("operator", "subject", F.col("guards")[0].alias("guard"), "holds", "of", (F.col("holds") == F.col("of")).cast("int").alias("vacuous"))


def rule_statuses(spark, sf_dir):
    return rulesets.settle(_rule_rows(spark, sf_dir)).groupBy("operator", "pattern", "status").agg(F.count("*").alias("rules"))


def _points(spark, sf_dir):
    """Decision points of orders with the intent and the customer's segment as facts."""
    events, _, terms, found = orders(spark, sf_dir, True)
    segment = events.select("interaction", "agent").distinct().select("interaction", F.create_map(F.lit("contact.segment"), "agent").alias("facts"))
    found = facts.with_facts(found, intents=events.select("episode", "intent").distinct(), contact_facts=segment)
    outcomes = events.select("episode", "outcome").distinct()
    return recommend.points_of(decision_points(found).join(outcomes, "episode", "left"))


RECOMMEND = replace(Thresholds(), recommend_agreement=0.28, recommend_gain=0.005, antecedent_max_length=2)


def decision_points_of(spark, sf_dir):
    rows = decision_points(orders(spark, sf_dir)[3])
    return rows.groupBy("operator", F.col("subject").alias("action")).agg(F.count("*").alias("points"), F.countDistinct("interaction").alias("contacts"))


def _recommended(spark, sf_dir):
    terms = order_lines(spark, sf_dir)[2].select(F.col("type").alias("action"), F.lit(True).alias("may"))
    points = _points(spark, sf_dir)
    points = written(points)
    return points, written(recommend.recommend(points, terms, RECOMMEND)[0])


def _of_length(rules, n):
    return rules.where(F.size("items") == n).select("operator", F.array_join("conditions", " and ").alias("conditions"), "action", "matched", "selected", "good", "judged")


def recommend_depth1(spark, sf_dir):
    return _of_length(_recommended(spark, sf_dir)[1], 1)


def recommend_depth2(spark, sf_dir):
    return _of_length(_recommended(spark, sf_dir)[1], 2)


def recommend_cover(spark, sf_dir):
    points, rules = _recommended(spark, sf_dir)
    return recommend.covered(rules, points, RECOMMEND).select("operator", F.array_join("conditions", " and ").alias("conditions"), "action", "matched", "selected")


def recommend_provenance(spark, sf_dir):
    """Where what is advised under one fact is done: here, by a team or an agent, or elsewhere."""
    points, rules = _recommended(spark, sf_dir)
    found = recommend.with_provenance(rules.where(F.size("items") == 1), points, replace(RECOMMEND, own_support=0.3, borrowed_operators=2, min_instances=30))
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("level", "scope")]
    return found.select("operator", F.array_join("conditions", " and ").alias("conditions"), "action", "verdict", *text, F.coalesce(listed("found_in"), F.lit("")).alias("found_in"), "holds", "of", "corpus_holds", "corpus_of")


def withheld_actions(spark, sf_dir):
    terms = order_lines(spark, sf_dir)[2].select(F.col("type").alias("action"), F.col("recommendable").alias("may"))
    return recommend.recommend(_points(spark, sf_dir), terms, replace(RECOMMEND, antecedent_max_length=1))[1]


def outcome_precision(spark, sf_dir):
    rows = _points(spark, sf_dir)
    return rows.groupBy("operator", "action").agg(F.count("*").alias("points"), F.count("good").alias("judged"), F.count_if("good").alias("good"))


def lift_context(spark, sf_dir):
    points, rules = _recommended(spark, sf_dir)
    rows = recommend.lift(rules.where(F.size("items") == 1), points)
    return rows.select("operator", F.array_join("conditions", " and ").alias("conditions"), "action", "matched", "selected", "base", "base_of", F.round(F.col("matched") / F.col("selected") - F.col("base") / F.col("base_of"), 6).alias("lift"))


def lift_by_stratum(spark, sf_dir):
    rows = recommend.lift_in_strata(_points(spark, sf_dir), "episode.intent", "intent:1-URGENT", "contact.segment")
    return rows.select("operator", "action", "stratum", "with_fact", "with_of", "without", "without_of")


def _clauses(spark):
    return spark.createDataFrame(CLAUSES, evaluate.CLAUSES)


def _exercised(spark, sf_dir, given=None):
    """given: what orders() gives with facts, if it is there already."""
    events, _, _, found = given or orders(spark, sf_dir, True)
    return evaluate.exercise(found, firsts(events, "episode"), firsts(events, "interaction"), _clauses(spark))


def clause_exercise(spark, sf_dir):
    return _exercised(spark, sf_dir)


def controls(spark, sf_dir):
    outcomes = order_lines(spark, sf_dir)[0].select("episode", "outcome").distinct()
    return evaluate.controls(_exercised(spark, sf_dir), outcomes)


def _policy_rules(spark, sf_dir):
    """Rules of orders at each operator with support of at least 0.3; id is readable here."""
    events, _, terms, found = orders(spark, sf_dir)
    specs = specs_of(spark, [(p, s, g, None) for p in (patterns.IMPLIES, patterns.WITHOUT) for s, g in PAIRS] + [(patterns.ONCE, "action:RF", [], None)])
    support = patterns.measured(patterns.checks(found, specs, events, terms), False).where("level = 'operator'").join(F.broadcast(specs), ["spec", "pattern"])
    name = F.concat_ws("/", "operator", "pattern", "subject", listed("guards"))
    nothing = F.lit(None).cast("string")
    return written(support.select(name.alias("id"), F.col("operator").alias("scope"), "pattern", "subject", "guards", nothing.alias("fact"), nothing.alias("value"), "holds", "of", (F.col("holds") / F.col("of") >= 0.3).alias("good")))


def alignment(spark, sf_dir):
    return evaluate.align(_policy_rules(spark, sf_dir).where("good"), _clauses(spark))


def policy_metrics(spark, sf_dir):
    rules = _policy_rules(spark, sf_dir)
    return evaluate.metrics(rules.where("good"), rules.where("not good"), _clauses(spark), evaluate.align(rules, _clauses(spark)))


def gate(spark, sf_dir):
    return evaluate.gate(policy_metrics(spark, sf_dir)).select("precision_lenient", "recall_lenient", "refusal_correct", "gate")


def diff_regions(spark, sf_dir):
    rules = _policy_rules(spark, sf_dir).where("good")
    found = diff.regions(rules, evaluate.align(rules, _clauses(spark)), _clauses(spark), _exercised(spark, sf_dir))
    return found.select("region", "kind", "id")


def _flows(spark, sf_dir):
    """orders() with facts, of events in a table."""
    events, contacts, terms = _written_orders(spark, sf_dir)
    return events, contacts, terms, facts.with_facts(instances(events, terms), intents=events.select("episode", "intent").distinct())


def _rules_of_flows(spark, given):
    """Precedence rules of orders under each intent, at each operator with support of at least 0.3."""
    events, _, terms, found = given
    plain = specs_of(spark, [(p, s, g, None) for p in (patterns.IMPLIES, patterns.WITHOUT) for s, g in PAIRS]).drop("spec")
    words = written(facts.vocabulary(found, replace(Thresholds(), min_instances=1)).where("fact = 'episode.intent'"))  # else all plans below hold what counts them
    owned = plain.join(words.select("operator", "subject").distinct(), "subject")
    specs = written(facts.conditioned(owned, words).drop("operator").withColumn("spec", patterns.spec_key()).dropDuplicates(["spec"]))
    support = patterns.measured(patterns.checks(found, specs, events, terms), False).where("level = 'operator'").join(F.broadcast(specs), ["spec", "pattern"])
    name = F.concat_ws("/", "operator", "pattern", "subject", listed("guards"), F.col("conditions")[0]["values"][0])
    return written(support.where(F.col("holds") / F.col("of") >= 0.3).select(name.alias("id"), F.col("operator").alias("scope"), "pattern", "subject", "guards", "conditions"))


def alignment_of_flows(spark, sf_dir):
    return evaluate.align(_rules_of_flows(spark, _flows(spark, sf_dir)), _clauses(spark))


def diff_of_flows(spark, sf_dir):
    """The regions of rules under an intent, with the flows that the policy has their pair for."""
    given = _flows(spark, sf_dir)
    rules = _rules_of_flows(spark, given)
    found = diff.regions(rules, evaluate.align(rules, _clauses(spark)), _clauses(spark), _exercised(spark, sf_dir, given))
    return found.where("region not in ('gap', 'inexpressible')").select("region", "kind", "id", F.coalesce(F.array_join("elsewhere", "|"), F.lit("")).alias("elsewhere"))


def gold_report(spark, sf_dir):
    rules = _policy_rules(spark, sf_dir).where("good")
    pairs = evaluate.align(rules, _clauses(spark)).select("rule", "clause").distinct()
    pairs = pairs.unionByName(spark.createDataFrame([("a rule nobody mined", "c1")], "rule string, clause string"))
    raters = F.explode(F.array(F.lit("ann"), F.lit("bo")))
    gold = pairs.withColumn("rater", raters).withColumn("verdict", F.when((F.col("rater") == "bo") & F.col("rule").contains("ASIA"), "rejected").otherwise("confirmed"))
    return evaluate.gold_report(gold, evaluate.align(rules, _clauses(spark)))


def _requests(spark, sf_dir):
    """Every decision point of orders asked cold: what came before, and the intent only of orders that are not low."""
    events, _, terms, found = orders(spark, sf_dir)
    points = decision_points(found)
    types = lambda scope, name: earlier(points, events, scope).groupBy("episode").agg(F.collect_set("guard").alias(name))
    intent = events.select("episode", "intent").distinct().where("intent <> 'intent:5-LOW'")
    none = F.array().cast("array<string>")
    rows = points.join(types("episode", "before"), "episode", "left").join(types("interaction", "contact_before"), "episode", "left").join(intent, "episode", "left")
    known = F.map_filter(F.create_map(F.lit("episode.intent"), "intent"), lambda k, v: v.isNotNull())
    return rows.select(
        F.col("episode").alias("request"), "operator", F.col("subject").alias("considering"), F.col("slots").alias("considering_slots"), F.coalesce("before", none).alias("before"),
        F.coalesce("contact_before", none).alias("contact_before"), F.lit(None).cast("array<struct<type:string,slots:map<string,string>>>").alias("contact_slots"), known.alias("facts"),
    )


def _served(spark, sf_dir):
    operators = table(spark, sf_dir, "region").select(F.col("r_name").alias("operator"))
    urgent = f"cast(array(named_struct('fact', 'episode.intent', 'op', 'eq', 'values', array('intent:1-URGENT'))) as array<{CONDITION}>)"
    no_slot = F.lit(None).cast("string").alias("slot")
    base = operators.select("operator", F.lit("r1").alias("id"), F.lit(patterns.WITHOUT).alias("pattern"), F.lit("action:RF").alias("subject"), F.array(F.lit("action:AF")).alias("guards"), no_slot, F.expr(NO_CONDITIONS).alias("conditions"))
    more = operators.select("operator", F.lit("r2").alias("id"), F.lit(patterns.IMPLIES).alias("pattern"), F.lit("action:AF").alias("subject"), F.array(F.lit("action:RF")).alias("guards"), no_slot, F.expr(urgent).alias("conditions"))
    hints = operators.where("operator = 'ASIA'").select("operator", F.lit("h1").alias("id"), F.lit("action:AF").alias("action"), F.expr(urgent).alias("conditions"))
    return serve.advise(_requests(spark, sf_dir), base.unionByName(more), hints)


def advise_replay(spark, sf_dir):
    rows = _served(spark, sf_dir)
    return rows.select("request", "considering", "verdict", F.coalesce("why", F.lit("")).alias("why"), listed("warned").alias("warned"), listed("cleared").alias("cleared"), listed("missing").alias("missing"))


def coverage_summary(spark, sf_dir):
    return serve.coverage(_served(spark, sf_dir)).select("operator", "verdict", F.coalesce("why", F.lit("")).alias("why"), "answers")


def missing_facts_topk(spark, sf_dir):
    return serve.top_missing(_served(spark, sf_dir))


def replay_metrics(spark, sf_dir):
    taken = _points(spark, sf_dir).select(F.col("point").alias("request"), "action", "good")
    return serve.replay_metrics(_served(spark, sf_dir), taken)


def three_valued(spark, sf_dir):
    """A conjunction of two conditions over facts of orders, of which one is missing for low priorities."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.map_filter(F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))), lambda k, v: v.isNotNull()).alias("facts"))
    both = F.expr(f"cast(array(named_struct('fact', 'status', 'op', 'eq', 'values', array('F')), named_struct('fact', 'priority', 'op', 'in', 'values', array('1-URGENT', '2-HIGH'))) as array<{CONDITION}>)")
    truth = F.coalesce(all_of(both, F.col("facts")).cast("string"), F.lit("unknown"))
    return rows.groupBy(truth.alias("truth"), F.array_join(unknown_facts(both, F.col("facts")), "|").alias("unknown")).agg(F.count("*").alias("orders"))


def _predicates(spark):
    return spark.createDataFrame(PREDICATES, PREDICATE)


def observation_sites(spark, sf_dir):
    found = observe.sites(conversations(spark, sf_dir), _predicates(spark))
    return found.groupBy("pred").agg(F.count("*").alias("sites"), F.countDistinct("sha").alias("texts"), F.sum(F.length("text")).alias("characters"))


def distinct_text_calls(spark, sf_dir):
    return observe.calls(observe.sites(conversations(spark, sf_dir), _predicates(spark)).where("pred = 'p-data'")).select("sha", "sites")


def _annotated(spark, sf_dir):
    found = observe.sites(conversations(spark, sf_dir), _predicates(spark))
    return observe.annotations(found, observe.observe(observe.calls(found), _predicates(spark)), _predicates(spark))


def band_emission(spark, sf_dir):
    return _annotated(spark, sf_dir).where("pred = 'p-data'").groupBy(F.coalesce("value", F.lit("withheld")).alias("value"), "p").agg(F.count("*").alias("lines"))


def asof_observation(spark, sf_dir):
    """At each turn, the last answer about an earlier one of its episode."""
    lines = _annotated(spark, sf_dir).where("pred = 'p-data'")
    sites = lines.select("interaction", "episode", "seq").distinct()
    rows = as_of(sites, lines.select("interaction", "episode", "seq", "fact", "value"), ["episode"], ["seq"])
    return rows.select("interaction", "episode", "seq", F.coalesce("value", F.lit("unknown")).alias("value"))


def redaction_preview(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", observe.redact_text(F.col("text")).alias("text"))
    return rows.select("doc_id", F.length("text").alias("length"), F.length(F.regexp_replace("text", "<(email|phone|digits)>", "")).alias("plain"))


def _labelled_answers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select(F.col("lang").alias("pred"), (F.expr("(least(n_chars, 2000) + 10) div 20") / 100).alias("p"), (F.col("quality") == 1).alias("label"))


def observed_distribution(spark, sf_dir):
    return observe.observed_distribution(_labelled_answers(spark, sf_dir))


def calibration_bands(spark, sf_dir):
    """Quality labels as answers about documents, with a probability from the text's length."""
    size = observe.derive_bands(_labelled_answers(spark, sf_dir), replace(Thresholds(), min_label_separation=0.0, min_calibration=40, min_label=5, min_predicate_precision=0.85))
    return size.select("pred", "assert_at", F.coalesce("problem", F.lit("")).alias("problem"))


def lifecycle_merge(spark, sf_dir):
    """Two runs over the orders of either half of the parts' keys: what the second does to the first's rules."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("id"), F.col("o_orderstatus").alias("scope"), (F.col("o_totalprice") > 200000).alias("kept"))
    run = lambda half: rows.where(F.col("o_orderkey") % 2 == half).groupBy("id", "scope").agg(F.count_if("kept").alias("holds"), F.count("*").alias("of")).withColumn("corpus", F.lit("orders"))
    person = F.when(F.col("id") == "1-URGENT", "real").when(F.col("id") == "2-HIGH", "not_real").when(F.col("id") == "5-LOW", "refused").otherwise("proposed")
    old = run(0).withColumns({"status": person, "reason": F.lit(None).cast("string")})
    new = run(1).where("not (id = '5-LOW' and scope = 'F') and not (id = '3-MEDIUM' and scope = 'P')").withColumn("status", F.when(F.col("scope") == "O", "refused").otherwise("proposed"))
    merged = store.merge(old, new, "r2")
    return merged.select("id", "scope", "holds", "of", "status", F.coalesce("reason", F.lit("")).alias("reason"), "change")


def _replayed_store(spark, sf_dir):
    """A store after a run over the orders of even keys, people's verdicts, and a run over those of odd keys."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("id"), F.col("o_orderstatus").alias("scope"), (F.col("o_totalprice") > 200000).alias("kept"))
    run = lambda half: rows.where(F.col("o_orderkey") % 2 == half).groupBy("id", "scope").agg(F.count_if("kept").alias("holds"), F.count("*").alias("of"), F.min("o_orderkey").cast("string").alias("least"))
    proof = lambda mined: mined.select("id", "scope", F.lit("c").alias("interaction"), F.col("least").alias("episode"), F.lit(0).alias("seq"), F.lit(True).alias("holds"))
    rules = rulestore.open_rules(spark, shared_folder(spark))
    first = written(run(0).withColumns({"status": F.when(F.col("id") == "5-LOW", "refused").otherwise("proposed"), "verdict": F.lit("own")}))
    rulestore.persist_mined(rules, "orders", "r1", first, proof(first))
    said = first.where("id in ('1-URGENT', '2-HIGH') or id = '3-MEDIUM' and scope = 'F'").select(
        "id", F.lit("orders").alias("corpus"), "scope", F.when(F.col("id") == "1-URGENT", "real").when(F.col("id") == "2-HIGH", "not_real").otherwise("narrowed").alias("verdict"),
        F.when(F.col("id") == "2-HIGH", "{not json").alias("note"), F.when(F.col("id") == "3-MEDIUM", "episode.intent").alias("fact"), F.when(F.col("id") == "3-MEDIUM", "intent:x").alias("value"),
        F.lit("ann").alias("reviewer"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("at"),
    )
    rulestore.record_verdicts(rules, said)
    second = written(run(1).where("not (id = '5-LOW' and scope = 'F') and not (id = '4-NOT SPECIFIED' and scope = 'P')").withColumn("status", F.when(F.col("scope") == "O", "refused").otherwise("proposed")))
    rulestore.persist_mined(rules, "orders", "r2", second, proof(second))
    return rules


def rule_store(spark, sf_dir):
    """What the store says of each rule after both runs, with the number of its evidence rows and the first of them."""
    rules = _replayed_store(spark, sf_dir)
    proof = rules.table("evidence").groupBy("id", "scope").agg(F.count("*").alias("proofs"), F.min("episode").alias("proof"))
    rows = rules.table("rules").join(proof, ["id", "scope"], "left")
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("retired_reason", "reproposed_reason", "proof")]
    return rows.select("id", "scope", "holds", "of", "status", "run", *text, F.coalesce("proofs", F.lit(0)).alias("proofs"))


def verdict_history(spark, sf_dir):
    rows = rulestore.history(_replayed_store(spark, sf_dir))
    return rows.select("id", "scope", "verdict", F.coalesce("note", F.lit("")).alias("note"), F.coalesce("condition.fact", F.lit("")).alias("fact"), F.coalesce(F.col("condition.values")[0], F.lit("")).alias("value"), "holds", "of", "reviewer")


def review_pace(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("user-"), F.col("user_id") % 20).alias("reviewer"), F.col("ts").alias("at"))
    return store.pace(rows, 0, 6000).select("reviewer", "gaps", F.round("median_seconds", 3).alias("median_seconds"))


def spread_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return evaluate.spread(rows, ["o_orderpriority"], ["o_orderkey"], 12)


def hash_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    return evaluate.hash_sample(rows, F.col("key"), "s1", 50)


def threshold_sweep(spark, sf_dir):
    """How many pairs of actions each operator would be asked about, by the floor of instances and of support."""
    events, _, _, found = users(spark, sf_dir)
    stats = patterns.guard_stats(found, events, "episode")
    grid = spark.createDataFrame([(n, s) for n in (5, 30, 100) for s in (0.3, 0.5, 0.7)], "min_instances int, support double")
    rows = stats.join(F.broadcast(grid), (F.col("instances") >= F.col("min_instances")) & (F.col("share") >= F.col("support")))
    return rows.groupBy("min_instances", "support").agg(F.count("*").alias("candidates"), F.sum("n").alias("kept"))


#: A policy for users' actions, and thresholds to be tried against it.
USER_CLAUSES = [
    ("u1", "sign up before buying", True, None, "precedence", "action:purchase", "action:signup", "interaction", False, None, None),
    ("u2", "one sign-up a session", True, None, "at-most-one", "action:signup", None, "episode", False, None, None),
    ("u3", "look before signing up", True, None, "precedence", "action:signup", "action:view", "episode", True, None, None),
    ("u4", "be polite", False, "tone", None, None, None, "interaction", False, None, None),
]
GRID = "own_support=0.45,0.6;guard_support=0.3,0.6;min_instances=5,400"


def _grid(spark):
    return sweeping.points_table(spark, sweeping.grid_of(GRID), LOW)


def swept_rules(spark, sf_dir):
    """The rules of users' actions that each point of the grid mines."""
    events, _, terms, _ = users(spark, sf_dir)
    rules = sweeping.swept_rules(events, terms, _grid(spark), FLOOR)
    return rules.select("point", "operator", "pattern", "subject", listed("guards").alias("guard"), "verdict", "status", "holds", "of", "corpus_holds", "corpus_of")


def mining_sweep(spark, sf_dir):
    events, _, terms, _ = users(spark, sf_dir)
    clauses = spark.createDataFrame(USER_CLAUSES, evaluate.CLAUSES)
    rows = sweeping.sweep(events, terms, _grid(spark), clauses, FLOOR)
    return rows.select("min_instances", "own_support", "guard_support", "proposed", "refused", "precision_lenient", "recall_lenient", "refusal_correct")


def timeline_runs(spark, sf_dir):
    """Each contact's turns with runs of one role collapsed to a count."""
    order = Window.partitionBy("interaction").orderBy("seq", "kind")
    rows = conversations(spark, sf_dir).withColumn("new", (F.lag("kind").over(order).isNull() | (F.lag("kind").over(order) != F.col("kind"))).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("interaction", "run", "kind").agg(F.count("*").alias("turns"))


def mined_rules(spark, sf_dir):
    """The whole mining plan over users' actions."""
    from .plans.mine import mine

    events, _, terms, _ = users(spark, sf_dir)
    rules = mine(events, terms, LOW, floor=FLOOR)
    return rules.select("id", "operator", "pattern", "subject", listed("guards").alias("guards"), "verdict", "status", "holds", "of", "text", "evidence")


def mined_conditioned(spark, sf_dir):
    """The mining plan over orders, with variants under the intent and the suppliers met before."""
    from .plans.mine import mine

    events, _, terms = _written_orders(spark, sf_dir)
    found = instances(events, terms)
    found = facts.with_facts(found, intents=events.select("episode", "intent").distinct(), slots=facts.slots_before(found, events))
    t = replace(LOW, implies_support=0.36, guard_support=0.2)
    rules = mine(events, terms, t, facts=found.select(*KEY, "facts"))
    return rules.select("id", "operator", "pattern", "condition_key", "verdict", "status", "holds", "of", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")]
    helpers = {"users", "orders", "listed", "specs_of", "queries"}
    found = {f.__name__: f for f in own if f.__name__ not in helpers}
    found["decision_points"] = found.pop("decision_points_of")
    return found
