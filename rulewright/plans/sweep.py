"""Mining under many thresholds at once, and how each choice does against a written policy.

Thresholds are a table, a row a point. What all points share is done once: first occurrences, the ranks of guards,
and the checks of every spec that any point suggests, which are most of the work. Suggestions, verdicts, statuses and
figures then have the point among their keys; these tables are as large as the vocabulary of actions, operators and points.
"""

from __future__ import annotations

from dataclasses import asdict, replace
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import align, metrics
from ..operators.instances import instances as instances_of
from ..operators.patterns import checks, measured, ranked, suggested, union_of
from ..operators.provenance import verdicts
from ..operators.rulesets import settle
from ..reuse import written
from ..schema import Thresholds
from .mine import judged

#: Thresholds that change what is mined without conditions.
AXES = ("min_instances", "implies_support", "own_support", "guard_support", "max_guard_rules", "borrowed_operators")
WHOLE = ("min_instances", "max_guard_rules", "borrowed_operators")
BETWEEN = "\x1f"


def grid_of(text: str) -> list[dict[str, float]]:
    """`min_instances=3,5;own_support=0.6` as points: every combination of the axes' values; no text is one point without any."""
    axes = []
    for axis in filter(None, (a.strip() for a in text.split(";"))):
        name, _, values = axis.partition("=")
        if name.strip() not in AXES or not values:
            raise ValueError(f"{axis}: a threshold and its values, as {AXES[0]}=3,5")
        axes.append([(name.strip(), float(v)) for v in values.split(",")])
    return [dict(point) for point in product(*axes)]


def points_table(spark: SparkSession, points: list[dict], t: Thresholds = Thresholds()) -> DataFrame:
    """point (its number) and all AXES, those that a point leaves out as in t."""
    rows = [(k, *(int(x[a]) if a in WHOLE else float(x[a]) for a in AXES)) for k, p in enumerate(points) for x in ({**asdict(t), **p},)]
    return spark.createDataFrame(rows, "point int, " + ", ".join(f"{a} {'int' if a in WHOLE else 'double'}" for a in AXES))


def swept_rules(events: DataFrame, alphabet: DataFrame, points: DataFrame, floor: str = "compensable") -> DataFrame:
    """The rule table (plans.mine.judged) of every point, with point: what mine() without facts gives with its thresholds, but for the texts."""
    t, also = replace(Thresholds(), **{a: F.col(a) for a in AXES}), ("point", *AXES)
    points = F.broadcast(points)  # as many as a person asks for
    events = written(events)
    found = written(instances_of(events, alphabet, floor))
    enough = found.groupBy("operator", "subject").agg(F.count("*").alias("instances"))
    specs = written(union_of(suggested(ranked(found, events, alphabet).crossJoin(points), t, also), also))
    single = written(specs.drop(*also).dropDuplicates(["spec"]))
    support = written(measured(checks(found, single, events, alphabet)))
    asked = support.join(specs.select(*also, "spec", "subject"), "spec").join(enough, ["operator", "subject"]).where(F.col("instances") >= t.min_instances)
    rules = verdicts(asked.drop("instances", "subject"), t, also=also).join(single, ["spec", "pattern"])
    # points don't meet one another in what follows
    rules = judged(rules, t).withColumn("operator", F.concat_ws(BETWEEN, F.col("point").cast("string"), "operator"))
    return settle(rules).withColumn("operator", F.split("operator", BETWEEN)[1])


def sweep(events: DataFrame, alphabet: DataFrame, points: DataFrame, clauses: DataFrame, floor: str = "compensable") -> DataFrame:
    """A row for each point: its thresholds, proposed, refused, precision and recall (lenient and strict) and correct refusals against the clauses; null where nothing is there to divide by."""
    rules = written(swept_rules(events, alphabet, points, floor))
    nothing = F.lit(None).cast("string")
    rows = rules.select("point", "id", F.concat_ws(BETWEEN, F.col("point").cast("string"), "operator").alias("scope"), "pattern", "subject", "guards", nothing.alias("fact"), nothing.alias("value"), "status")
    pairs = align(rows, clauses).withColumn("point", F.split("scope", BETWEEN)[0].cast("int"))
    figures = metrics(rows.where("status = 'proposed'"), rows.where("status = 'refused'"), clauses, pairs, by=("point",))
    figures = figures.select("point", F.col("rules").alias("proposed"), "refused", "precision_lenient", "precision_strict", "recall_lenient", "recall_strict", "refusal_correct")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("proposed", "refused")} | {c: F.coalesce(c, F.lit(0.0)) for c in ("recall_lenient", "recall_strict")}
    return points.join(figures, "point", "left").withColumns(zero)
