"""Mining at many points at once against mining at each."""

import random

import pytest

from rulewright.operators import evaluate
from rulewright.plans.mine import mine
from rulewright.plans.sweep import grid_of, points_table, sweep, swept_rules
from rulewright.schema import Thresholds, alphabet

from .test_engine import events

FIELDS = ("operator", "id", "pattern", "verdict", "level", "scope", "found_in", "holds", "of", "corpus_holds", "corpus_of", "status", "reason", "suppressed_by")


def test_grid():
    assert grid_of("min_instances=3,5; own_support=0.6") == [{"min_instances": 3.0, "own_support": 0.6}, {"min_instances": 5.0, "own_support": 0.6}]
    assert grid_of("") == [{}]
    for bad in ("x=1", "min_instances", "min_instances=a"):
        with pytest.raises(ValueError):
            grid_of(bad)


def test_sweep_is_mining_at_each_point(spark):
    r = random.Random(4)
    terms = alphabet(spark, [{"type": f"action:{x}", "consequence": "compensable", "identity": ["file"]} for x in ("read", "edit", "send")] + [{"type": "action:look", "consequence": "none"}])
    logs = None
    for operator in ("o1", "o2", "o3"):
        contacts = {f"{operator}-{k}": [(e, f"action:{r.choice(['read', 'edit', 'send', 'look'])}", {"file": r.choice("fg")}) for e in range(2) for _ in range(r.randint(0, 5))] for k in range(25)}
        part = events(spark, contacts, operator)
        logs = part if logs is None else logs.unionByName(part)
    points = grid_of("min_instances=5,40;implies_support=0.3,0.7;own_support=0.3,0.5;guard_support=0.2,0.5;max_guard_rules=1,3;borrowed_operators=1")[::3]
    table = points_table(spark, points)
    got = swept_rules(logs, terms, table).select("point", *FIELDS).collect()
    clauses = spark.createDataFrame([("c1", "", True, None, "precedence", "action:edit", "action:read", "interaction", False, None, None), ("c2", "", True, None, "at-most-one", "action:send", None, "episode", True, None, None)], evaluate.CLAUSES)
    figures = {x["point"]: x for x in sweep(logs, terms, table, clauses).collect()}
    assert set(figures) == set(range(len(points)))
    for k, p in list(enumerate(points))[::5]:
        t = Thresholds(**{a: int(v) if a in ("min_instances", "max_guard_rules", "borrowed_operators") else v for a, v in p.items()})
        alone = mine(logs, terms, t)
        assert sorted(str(tuple(x)[1:]) for x in got if x["point"] == k) == sorted(str(tuple(x)) for x in alone.select(*FIELDS).collect())
        assert (figures[k]["proposed"], figures[k]["refused"]) == tuple(alone.where(f"status = '{s}'").count() for s in ("proposed", "refused"))
    assert {x["pattern"] for x in got} >= {"no-X-without-prior-Y-same-S", "at-most-one-X"}
