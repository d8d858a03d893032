"""The cover in rounds against the choice one rule after another; the spread sample over tasks against places in one list."""

import random

import pytest

from rulewright.operators.evaluate import spread
from rulewright.operators.recommend import covered
from rulewright.schema import Thresholds


def one_after_another(rules, points, t):
    out = []
    for group in {r[:2] for r in rules}:
        seen, kept = set(), []
        for r in sorted((r for r in rules if r[:2] == group), key=lambda r: (-r[4], " and ".join(r[3]))):
            mine = {p for p, op, action, facts in points if (op, action) == group and all(c.split(" = ")[1] == facts.get(c.split(" = ")[0]) for c in r[3])}
            rate = r[4] / r[5]
            if len(mine - seen) < t.recommend_novelty * len(mine):
                host = max(kept, key=lambda k: len(k[0] & mine), default=None)
                if host is None or len(host[0] & mine) < 0.9 * len(mine) or rate <= host[1] + t.recommend_gain:
                    continue
            kept.append((mine, rate))
            seen |= mine
            out.append(r[:3])
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_cover(spark, seed):
    r = random.Random(seed)
    facts = {k: [f"{k}{i}" for i in range(n)] for k, n in (("a", 2), ("b", 3), ("c", 5))}
    points = [(f"p{k}", r.choice(["o", "o", "u"]), r.choice(["x", "y"]), {f: r.choice(v) for f, v in facts.items() if r.random() < 0.9}) for k in range(500)]
    rules = []
    for group in ("o", "u"):
        for action in ("x", "y"):
            for k in range(30):
                some = r.sample(sorted(facts), r.randint(1, 3))
                conditions = sorted(f"{f} = {r.choice(facts[f])}" for f in some)
                met = sum(all(c.split(" = ")[1] == p[3].get(c.split(" = ")[0]) for c in conditions) for p in points if p[1:3] == (group, action))
                if met and conditions not in [x[3] for x in rules if x[:2] == (group, action)]:
                    rules.append((group, action, f"n{k}", conditions, met, met + r.randint(0, met)))
    t = Thresholds()
    got = covered(spark.createDataFrame(rules, "operator string, action string, node string, conditions array<string>, matched long, selected long"), spark.createDataFrame(points, "point string, operator string, action string, facts map<string,string>"), t)
    want = one_after_another(rules, points, t)
    assert sorted((x["operator"], x["action"], x["node"]) for x in got.collect()) == want
    assert 4 < len(want) < len(rules)


def test_cover_of_nothing(spark):
    rules = spark.createDataFrame([], "operator string, action string, node string, conditions array<string>, matched long, selected long")
    assert covered(rules, spark.createDataFrame([], "point string, operator string, action string, facts map<string,string>")).count() == 0


@pytest.mark.parametrize("most", [1, 3, 40])
def test_spread(spark, most):
    rows = [(g, k) for g, n in (("a", 17), ("b", 2), (None, 60)) for k in range(n)]
    want = []
    for g in ("a", "b", None):
        own = sorted(k for h, k in rows if h == g)
        places = range(len(own)) if len(own) <= most else {int(k * (len(own) - 1) / max(1, most - 1) + 0.5) for k in range(most)}
        want += [(g, own[p]) for p in places]
    random.Random(1).shuffle(rows)
    got = spread(spark.createDataFrame(rows, "g string, k int").repartition(5), ["g"], ["k"], most)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
