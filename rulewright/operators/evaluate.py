"""Mined rules against a written policy, and against people who rated the matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..reuse import written
from ..schema import Thresholds
from .instances import with_firsts
from .patterns import IMPLIES, ONCE, SAME, WITHOUT

#: A clause: id, text, expressible, reason, shape (precedence, at-most-one), subject, guard, window, adjacent, fact, value.
CLAUSES = "id string, text string, expressible boolean, reason string, shape string, subject string, guard string, window string, adjacent boolean, fact string, value string"


#: Outcomes that count as good: a fixed value.
GOOD = ("resolved",)


def exercise(found: DataFrame, firsts_in_episode: DataFrame, firsts_in_contact: DataFrame, clauses: DataFrame) -> DataFrame:
    """clause, exercised, violated, kept: each expressible clause at the instances of its subject, in its own window.

    found: instances with facts. A clause of a fact is exercised where that is known to have its value. At most one is
    judged by episode. firsts: as instances.firsts gives them.
    """
    stated = clauses.where("expressible").select(F.col("id").alias("clause"), "shape", "subject", "guard", "window", "fact", "value")
    rows = with_firsts(found, firsts_in_episode, firsts_in_contact).join(F.broadcast(stated), "subject").where(F.col("fact").isNull() | (F.element_at("facts", F.col("fact")) == F.col("value")))
    order, once = rows.where("shape = 'precedence' and window is not null"), rows.where("shape = 'at-most-one'")
    first = F.when(F.col("window") == "episode", F.col("in_episode")[F.col("guard")]["first"]).otherwise(F.col("in_contact")[F.col("guard")]["first"])
    order = order.select("clause", (F.coalesce(first, F.lit(1 << 30)) < F.col("seq")).alias("kept"))
    once = once.select("clause", "interaction", "episode", F.col("in_episode")[F.col("subject")]["times"].alias("times")).where("times is not null")
    once = once.groupBy("clause", "interaction", "episode").agg((F.max("times") <= 1).alias("kept")).select("clause", "kept")
    judged = order.unionByName(once).groupBy("clause").agg(F.count("*").alias("exercised"), F.count_if(~F.col("kept")).alias("violated"), F.count_if("kept").alias("kept"))
    return stated.select("clause").join(judged, "clause", "left").select("clause", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("exercised", "violated", "kept")))


def controls(exercised: DataFrame, outcomes: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """One row: clauses violated at least once, kept at own_support over min_instances, never exercised, and the share of
    those contacts with an outcome (outcomes: a row each) whose outcome isn't good."""
    judged = outcomes.where("outcome is not null").agg((F.count_if(~F.col("outcome").isin(*GOOD)) / F.nullif(F.count("*"), F.lit(0))).alias("share"))
    counts = exercised.agg(
        F.count_if(F.col("violated") > 0).alias("violated_at_least_once"),
        F.count_if((F.col("exercised") >= t.min_instances) & (F.col("kept") / F.nullif(F.col("exercised"), F.lit(0)) >= t.own_support)).alias("kept_at_own_support"),
        F.count_if(F.col("exercised") == 0).alias("never_exercised"),
    )
    return counts.crossJoin(judged.select(F.round("share", 6).alias("failed_share")))  # one row each


def stated_conditions(rules: DataFrame) -> Column:
    """fact and value (null for any but one equal to it) of each condition of a rule: of conditions, or of fact and value."""
    if "conditions" in rules.columns:
        return F.transform("conditions", lambda c: F.named_struct(F.lit("fact"), c["fact"], F.lit("value"), F.when((c["op"] == "eq") & (F.size(c["values"]) == 1), c["values"][0])))
    return F.when(F.col("fact").isNull(), F.array().cast("array<struct<fact:string,value:string>>")).otherwise(F.array(F.struct("fact", "value")))


def align(rules: DataFrame, clauses: DataFrame) -> DataFrame:
    """rule, scope, clause, kind: exact, general (says less of when) or proposed (a person must look).

    rules: id, scope, pattern, subject, guards, and conditions, or fact and value of a single one or null; of several, any may be the clause's. The plain precedence patterns and those on
    the same object meet precedence clauses of their subject and guard; at-most-one rules those of their subject. A rule without condition
    is exact for a clause without one, and where the clauses of its pair name as many values as all precedence clauses of its subject.
    A rule of another value of the clause's fact is no pair for precedence, and proposed for at-most-one.
    """
    pair = rules.select(F.col("id").alias("rule"), "scope", "pattern", "subject", F.explode_outer("guards").alias("guard"), F.size("guards").alias("guards"), stated_conditions(rules).alias("terms"))
    terms = clauses.where("expressible").select(F.col("id").alias("clause"), "shape", F.col("subject").alias("clause_subject"), F.col("guard").alias("clause_guard"), "fact", "value")
    order = terms.where("shape = 'precedence'")
    values = F.countDistinct(F.when(F.col("fact").isNotNull(), F.col("value")))
    of_pair = order.groupBy("clause_subject", "clause_guard").agg(values.alias("pair_values"))
    of_subject = order.groupBy("clause_subject").agg(values.alias("subject_values"))
    terms = terms.join(of_pair, ["clause_subject", "clause_guard"], "left").join(of_subject, "clause_subject", "left")
    same = (F.col("subject") == F.col("clause_subject")) & (
        (F.col("pattern") == ONCE) & (F.col("shape") == "at-most-one") | F.col("pattern").isin(IMPLIES, WITHOUT, SAME) & (F.col("shape") == "precedence") & (F.col("guard") == F.col("clause_guard"))
    )
    met = pair.join(F.broadcast(terms), same)  # clauses are as many as people wrote
    fact, value = F.col("fact"), F.col("value")
    alike = F.coalesce(F.exists("terms", lambda c: (c["fact"] == fact) & (c["value"] == value)), F.lit(False))
    several = (F.col("pattern") == SAME) & (F.col("guards") > 1)
    other = F.coalesce(F.exists("terms", lambda c: c["fact"] == fact), F.lit(False)) & ~alike & (F.col("pattern") != ONCE) & ~several
    covers = (F.col("pattern") != ONCE) & (F.col("pair_values") > 0) & (F.col("pair_values") == F.col("subject_values"))
    kind = (
        F.when(several, "proposed")
        .when(F.size("terms") == 0, F.when(F.col("fact").isNull() | covers, "exact").otherwise("general"))
        .when(alike, "exact")
        .otherwise("proposed")
    )
    return met.where(~other).select("rule", "scope", "clause", kind.alias("kind")).distinct()


def strength(kind: Column) -> Column:
    return F.when(kind == "exact", 3).when(kind == "general", 2).when(kind == "proposed", 1).otherwise(0)


#: Patterns that a clause can state.
ALIGNABLE = (IMPLIES, WITHOUT, SAME, ONCE)


def metrics(rules: DataFrame, refused: DataFrame, clauses: DataFrame, alignments: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row: rules, aligned exactly, aligned, and clauses recovered, strictly and leniently; refused ones that no clause states as they are.

    by: columns of rules, refused and alignments that name sets of rules, each measured for itself; a set that only has refused rules has a row.
    """
    own = [*by, "rule", "scope"]
    named = lambda rows, *more: rows.select(*by, F.col("id").alias("rule"), "scope", *more)

    def met(one: DataFrame, other: DataFrame) -> DataFrame:
        return one.join(other, list(by), "left") if by else one.crossJoin(other)  # one row each

    best = named(rules, F.col("pattern").isin(*ALIGNABLE).alias("alignable")).join(alignments, own, "left").groupBy(*own, "alignable").agg(F.max(strength(F.col("kind"))).alias("best"))
    ours = best.groupBy(*by).agg(
        F.count("*").alias("rules"), F.count_if(F.col("best") == 3).alias("strict"), F.count_if(F.col("best") >= 2).alias("lenient"), F.count_if(F.col("best") == 1).alias("to_confirm"),
        F.count_if(F.col("best") == 0).alias("unaligned"), F.count_if("alignable").alias("alignable"), F.count_if(~F.col("alignable") & (F.col("best") == 0)).alias("unalignable"),
    )
    firm = alignments.join(named(rules), own, "left_semi")
    recovered = firm.groupBy(*by, "clause").agg(F.max(strength(F.col("kind"))).alias("best"))
    stated = F.broadcast(clauses.where("expressible").select(F.col("id").alias("clause"), "adjacent"))  # as many as people wrote
    found = recovered.join(stated, "clause").groupBy(*by).agg(
        F.count_if(F.col("best") == 3).alias("recalled_strict"), F.count_if(F.col("best") >= 2).alias("recalled_lenient"), F.count_if((F.col("best") >= 2) & F.col("adjacent")).alias("recalled_adjacent")
    )
    wrong = named(refused).join(alignments.where("kind = 'exact'").select(own).distinct(), own, "left_semi").distinct().groupBy(*by).agg(F.count("*").alias("refused_wrongly"))
    rejected = refused.groupBy(*by).agg(F.count("*").alias("refused"))
    start = rules.select(*by).unionByName(refused.select(*by)).distinct() if by else None
    row = met(met(met(met(start, ours) if by else ours, found), rejected), wrong).crossJoin(stated.agg(F.count("*").alias("clauses")))
    counts = ("rules", "strict", "lenient", "to_confirm", "unaligned", "alignable", "unalignable", "recalled_strict", "recalled_lenient", "recalled_adjacent", "refused", "refused_wrongly")
    row = row.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    ratio = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 6)
    return row.withColumns(
        {"precision_strict": ratio("strict", "rules"), "precision_lenient": ratio("lenient", "rules"), "precision_alignable": ratio("lenient", "alignable"), "recall_strict": ratio("recalled_strict", "clauses"),
         "recall_lenient": ratio("recalled_lenient", "clauses"), "refusal_correct": F.round(1 - F.col("refused_wrongly") / F.nullif(F.col("refused"), F.lit(0)), 6)}
    )


def inexpressible(clauses: DataFrame) -> DataFrame:
    """reason, clauses: why clauses can't be stated as rules."""
    return clauses.where("not expressible").groupBy(F.coalesce("reason", F.lit("unstated")).alias("reason")).agg(F.count("*").alias("clauses"))


def gate(measured: DataFrame) -> DataFrame:
    """measured with gate. Targets 0.7, 0.5, 0.8; below 0.4 precision, or refusal at chance 0.5, is falsified."""
    precision, recall, refusal = F.col("precision_lenient"), F.coalesce("recall_lenient", F.lit(0.0)), F.col("refusal_correct")
    verdict = (
        F.when(precision.isNull(), "unmeasured")
        .when((precision < 0.4) | (refusal <= 0.5), "falsified")
        .when((precision >= 0.7) & (recall >= 0.5) & (F.coalesce(refusal, F.lit(1.0)) >= 0.8), "target")
        .otherwise("between")
    )
    return measured.withColumn("gate", verdict)


def gold_report(gold: DataFrame, alignments: DataFrame) -> DataFrame:
    """One row: pairs, double-rated, agreed, matcher agreement with the majority (a tie confirms), pairs the matcher never proposed.

    gold: rule, clause, verdict (confirmed, rejected), rater.
    """
    said = gold.groupBy("rule", "clause").agg(F.countDistinct("rater").alias("raters"), F.countDistinct("verdict").alias("verdicts"), F.count_if(F.col("verdict") == "confirmed").alias("yes"), F.count("*").alias("all"))
    paired = alignments.select("rule", "clause").distinct().withColumn("matched", F.lit(True))
    rows = said.join(paired, ["rule", "clause"], "left").withColumn("confirmed", F.col("yes") * 2 >= F.col("all"))
    matched = F.coalesce("matched", F.lit(False))
    return rows.agg(
        F.count("*").alias("pairs"), F.count_if(F.col("raters") > 1).alias("double_rated"), F.count_if((F.col("raters") > 1) & (F.col("verdicts") == 1)).alias("raters_agree"),
        F.count_if(matched == F.col("confirmed")).alias("matcher_agrees"), F.count_if(~matched).alias("missed"),
    )


def latest(verdicts: DataFrame) -> DataFrame:
    """Of verdicts (rule, clause, rater, verdict, at) the last of each rater on each pair; the others are superseded."""
    order = Window.partitionBy("rule", "clause", "rater").orderBy(F.col("at").desc())
    return verdicts.withColumn("rank", F.row_number().over(order)).withColumn("superseded", F.col("rank") > 1).drop("rank")


def spread(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """At most `most` rows of each group, evenly spread over its order: the first, the last and those between.

    Rows are sorted over all tasks, also those of one group. A row for each group and task says which of its places
    are wanted, and only those rows are taken.
    """
    at, part, place = "at_", "part_", "place_"
    keys = [F.asc_nulls_first(c) for c in (*by, *order)]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id())
    placed = written(placed.withColumns({part: F.shiftright(at, 33).cast("int"), place: F.col(at).bitwiseAND(F.lit((1 << 33) - 1))}))
    pieces = placed.groupBy(*by, part).agg(F.min(place).alias("first"), F.count("*").alias("many"))
    group = Window.partitionBy(*by)
    pieces = pieces.withColumns({"size": F.sum("many").over(group), "before": F.sum("many").over(group.orderBy(part)) - F.col("many")})
    every = F.sequence(F.lit(0), F.col("size") - 1)
    even = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.floor(k * (F.col("size") - 1) / max(1, most - 1) + 0.5))
    wanted = pieces.withColumn("wanted", F.explode(F.array_distinct(F.when(F.col("size") <= most, every).otherwise(even))))
    wanted = wanted.where("wanted >= before and wanted < before + many").select(F.col(part).alias("p"), (F.col("wanted") - F.col("before") + F.col("first")).alias("q"))
    return placed.join(wanted, (F.col(part) == F.col("p")) & (F.col(place) == F.col("q"))).select(*rows.columns)


def hash_sample(rows: DataFrame, key: Column, salt: str, most: int) -> DataFrame:
    """The rows of the least sha256 of salt and key: the same in every run, and a larger draw extends a smaller one."""
    return rows.orderBy(F.substring(F.sha2(F.concat_ws("\0", F.lit(salt), key), 256), 1, 16), key).limit(most)


def recall_over(alignments: DataFrame, exercised: DataFrame) -> DataFrame:
    """subset (violated, kept), clauses, recalled_strict, recalled_lenient: recall over clauses that were broken, and that never were."""
    best = alignments.groupBy("clause").agg(F.max(strength(F.col("kind"))).alias("best"))
    rows = exercised.where("exercised > 0").withColumn("subset", F.when(F.col("violated") > 0, "violated").otherwise("kept")).join(best, "clause", "left")
    return rows.groupBy("subset").agg(F.count("*").alias("clauses"), F.count_if(F.col("best") == 3).alias("recalled_strict"), F.count_if(F.col("best") >= 2).alias("recalled_lenient"))


def gold_sample(rules: DataFrame, alignments: DataFrame, clauses: DataFrame, each: int = 12) -> DataFrame:
    """stratum, rule, clause to be rated: aligned pairs by kind, near misses (one subject, no alignment), rules without any (tribal)."""
    pairs = alignments.select(F.col("kind").alias("stratum"), "rule", "clause").distinct()
    near = rules.select(F.col("id").alias("rule"), "subject").join(F.broadcast(clauses.where("expressible").select(F.col("id").alias("clause"), "subject")), "subject")
    near = near.join(pairs, ["rule", "clause"], "left_anti").select(F.lit("near-miss").alias("stratum"), "rule", "clause").distinct()
    alone = rules.select(F.col("id").alias("rule")).distinct().join(pairs.select("rule").unionByName(near.select("rule")).distinct(), "rule", "left_anti")
    alone = alone.select(F.lit("tribal").alias("stratum"), "rule", F.lit(None).cast("string").alias("clause"))
    return spread(pairs.unionByName(near).unionByName(alone), ["stratum"], ["rule", "clause"], each)


def gold_progress(sample: DataFrame, gold: DataFrame) -> DataFrame:
    """stratum, total, rated, raters, double_rated."""
    said = gold.groupBy("rule", "clause").agg(F.collect_set("rater").alias("by"))
    rows = sample.join(said, ["rule", "clause"], "left")
    return rows.groupBy("stratum").agg(F.count("*").alias("total"), F.count("by").alias("rated"), F.size(F.array_distinct(F.flatten(F.collect_list("by")))).alias("raters"), F.count_if(F.size("by") > 1).alias("double_rated"))
