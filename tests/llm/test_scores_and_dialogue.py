"""Resampling, quality rules and repair of conversations against brute force, on small tables with nulls, ties, repeated rows, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rulewright.llm import dialogue, importance, quality

DOCS = "doc_id long, text string, n long, place long, before long, part int, able int, good long"
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(r, n):
    return " ".join(r.choice(["Ra", "ti", "su", "Über", "x1", "no-no", "##", "a,b", "Σ"]) + r.choice(["", ".", "!", "|"]) for _ in range(n))


def corpus(seed=3, n=80):
    r = random.Random(seed)
    rows = [(k, prose(r, r.randint(0, 80))) for k in range(n)]
    line = prose(r, 7)
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "\n".join([line, "", line, " ", line, prose(r, 9)])), (n + 4, "na " * 60), (n + 5, prose(r, 30_000)), (n + 6, "ab"), (n + 7, "x\x00y \x1cz É.é")]
    rows += [rows[5], rows[5], (None, rows[5][1]), (None, prose(r, 40)), (None, prose(r, 40))]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], DOCS).repartition(5)


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=repr)


# --- 11


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(g.encode()) % 10000 for g in grams]


def resampled(docs, target):
    found = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for f in found for b in f[2]), Counter(b for x in target for b in features(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in s}
    rows = []
    for d, n_words, f in found:
        h = int(hashlib.sha256(f"42:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([d, n_words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: 5 * len(able) // 100])}
    return [(*r, ranks.get(id(r))) for r in rows]


def test_resampling(spark):
    docs, target = corpus(), [prose(random.Random(9), 50), None, "", "Ra ti Ra ti"]
    got = importance.resample(table(spark, docs), spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int"))
    assert sorted_rows(got.collect()) == sorted_rows(resampled(docs, target))


def test_resampling_equal_rows_get_ranks_of_their_own(spark):
    docs = [(7, prose(random.Random(1), 40))] * 100
    got = importance.resample(table(spark, docs), table(spark, []))
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == [1, 2, 3, 4, 5]


def test_resampling_of_nothing(spark):
    assert importance.resample(table(spark, []), table(spark, corpus()[:3])).collect() == []


# --- 12


def base(text):
    text = text or ""
    words = SPACE_WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    return [len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered)]


def judged(docs, labels, least=-50_000):
    trusted = {d for d, q in labels if q == 1} - {d for d, q in labels if q != 1} - {None}
    def grams(t):
        return [(ord(a) * 1_000_003**2 + ord(b) * 1_000_003 + ord(c)) % 65_521 for a, b, c in zip(t or "", (t or "")[1:], (t or "")[2:])]

    raw, target = Counter(), Counter()
    for d, t in docs:
        raw.update(grams(t))
        if d in trusted:
            target.update(grams(t))
    gain = {b: math.floor(1e6 * math.log((target[b] + 1) * (raw.total() + 65_521) / ((raw[b] + 1) * (target.total() + 65_521)))) if target else 0 for b in raw}
    out = []
    for d, t in docs:
        b = base(t)
        failed = b[0] < 10 or 100 * b[4] > 20 * b[0]
        g = grams(t)
        out.append((d, *b, len(g), sum(gain[x] for x in g), failed, not failed and sum(gain[x] for x in g) >= least * len(g)))
    return out


@pytest.mark.parametrize("labels", [[(k, int(k % 4 > 0)) for k in range(60)] + [(1, 1), (2, 0), (None, 1)], []])
def test_quality(spark, labels):
    docs = corpus()
    means = sorted(r[7] // r[6] for r in judged(docs, labels) if r[6] and not r[8])
    least = means[len(means) // 2]
    got = quality.judged(table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int"), least).collect()
    want = judged(docs, labels, least)
    assert sorted_rows(got) == sorted_rows(want)
    assert not labels or {r[-1] for r in want} == {True, False}


def test_quality_joins_many_labels_by_a_shuffle(spark):
    docs, labels = table(spark, corpus()), spark.createDataFrame([(k, 1) for k in range(30)], "doc_id long, quality int")
    few, many = (sorted_rows(quality.with_trust(docs, labels, n).collect()) for n in (100, 0))
    assert few == many and sum(r[1] for r in few) == 32


def test_quality_of_nothing(spark):
    assert quality.judged(table(spark, []), spark.createDataFrame([], "doc_id long, quality int")).collect() == []


def test_windows_end_with_their_text(spark):
    docs = [(1, "a b c d e f g h i j"), (2, "c d e f a b c d e f")]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.judged(table(spark, docs), spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert got == {1: 0, 2: 0}


# --- 13

TURNS = "conv_id long, turn long, role string, text string, row long, part int, place int, c int, first int"


def talk(seed=5, n=60):
    r = random.Random(seed)
    rows = []
    for c in [*range(n), None]:
        for t in range(r.randint(0, 9)):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "Assistant", None])
            text = r.choice(["Good. ", "Yes!", "And then", "", " \n", None, "Why?\n", "x.y", f"text {r.random()}."])
            rows.append((c, r.choice([None, t, t, t, t, 3]), role, text))
    return rows + rows[:9]


def long_talk(n=700):
    r = random.Random(11)
    return [(1, t, r.choice(["user", "assistant", "system"]) if r.random() < 0.3 else ("user", "assistant")[t % 2], r.choice([f"No {t}.", f"cut {t}", "Again.", ""])) for t in range(n)] + [(2, 0, "user", "Hi."), (0, 5, "user", "a.")]


def damage(rows):
    out = []
    for c, t, role, text in rows:
        text, role = " " if text is None else text, " " if role is None else role
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def report(conv, rows):
    """Of one conversation's damaged rows, by the least (cost, letters) from each row and grammar state to the end."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    follows = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {(len(rows), s): (0, "", ()) for s in ("", "a")}
    for i in range(len(rows), -1, -1):
        here = {s: [best[i, s]] if (i, s) in best else [] for s in ("", "s", "u", "a")}
        if i < len(rows):
            _, _, role, text = rows[i]
            more = 3 if faults[i] == "truncated" else 0
            for s in here:
                options = [("D", 4, s, ())]
                if faults[i] not in ("blank", "duplicate"):
                    if (s, role[:1]) in follows:
                        options.append(("K", more, role[:1], (f"{role}:{text}",)))
                    options += [("R", 3 + more, name[0], (f"{name}:{text}",)) for name in ("user", "assistant") if (s, name[0]) in follows]
                for e, cost, to, line in options:
                    rest = best[i + 1, to]
                    here[s].append((cost + rest[0], e + rest[1], line + rest[2]))
        for _ in range(4):  # inserted turns
            for s in here:
                for name in ("user", "assistant"):
                    if (s, name[0]) in follows and here[name[0]]:
                        c, e, lines = min(here[name[0]])
                        here[s] = [min([*here[s], (c + 3, "I" + e, (f"{name}:",) + lines)])]
        best |= {(i, s): min(x) for s, x in here.items() if x}
    cost, audit, lines = best[0, ""]
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    return (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def reports(rows):
    left = damage(rows)
    return [report(c, [r for r in left if r[0] == c]) for c in {r[0] for r in rows}]


def talks(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], TURNS).repartition(4)


@pytest.mark.parametrize("rows, parts", [(talk(), 4), (talk(6), 40), (long_talk(), 23)])
def test_conversations(spark, rows, parts):
    """Also with conversations that lie in many tasks."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted_rows(dialogue.conversation_reports(talks(spark, rows)).collect()) == sorted_rows(r for r, _ in reports(rows))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_repaired_turns(spark):
    rows = talk(8, 30)
    made = dialogue.repaired_turns(dialogue.repaired(talks(spark, rows))).orderBy("conv_id", "part", "place", "step").collect()
    for (conv, *_), lines in reports(rows):
        assert tuple(f"{m['role']}:{m['text']}" for m in made if m["conv_id"] == conv) == lines


def test_conversations_of_nothing(spark):
    assert dialogue.conversation_reports(talks(spark, [])).collect() == []
    assert dialogue.conversation_reports(talks(spark, [(c, t, "user", "a.") for c in range(3) for t in range(99) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0])).select("audit").distinct().collect() == [("",)]


def test_cost_matrices():
    """A piece's matrix turns the costs after it into those before it, as one turn after another does."""
    r = random.Random(2)
    for _ in range(200):
        codes = [r.choice([i + cut for i in range(4) for cut in (0, 4)] + [8, 10]) for _ in range(r.randint(1, 9))]
        m, after = dialogue.matrix(__import__("numpy").array(codes)), dialogue.AT_END
        for code in codes[::-1]:
            after = dialogue.before(after, code)
        direct = tuple(min(m[4 * s + t] + dialogue.AT_END[t] for t in range(4)) for s in range(4))
        assert direct == after
