"""The engine's queries as SQL over the same tables, written apart from their DataFrames, for DuckDB."""

from __future__ import annotations

USERS = """
WITH base AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
ev AS (
  SELECT CAST(user_id AS VARCHAR) AS interaction,
    user_id || '#' || sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 1 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS episode,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS seq,
    CASE WHEN event_type = 'error' THEN 'system' ELSE 'action' END AS kind,
    CASE WHEN event_type = 'error' THEN 'system:' ELSE 'action:' END || event_type AS type,
    'op-' || (user_id % 3) AS operator, 'team-' || (user_id % 6) AS team
  FROM base),
acts AS (SELECT * FROM ev WHERE kind = 'action'),
inst AS (SELECT *, type AS subject FROM ev WHERE type IN ('action:purchase', 'action:signup'))"""

ORDERS = """
WITH ev AS (
  SELECT CAST(o_custkey AS VARCHAR) AS interaction, CAST(o_orderkey AS VARCHAR) AS episode,
    CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY l_shipdate, o_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS seq,
    'action:' || l_returnflag || l_linestatus AS type, l_suppkey AS supplier, r_name AS operator, n_name AS team, c_mktsegment AS agent,
    'intent:' || o_orderpriority AS intent, CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'P' THEN 'escalated' END AS outcome
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
inst AS (SELECT *, type AS subject FROM ev WHERE type IN ('action:AF', 'action:AO', 'action:RF', 'action:RO'))"""

PAIRS = """,
pairs(subject, guard) AS (VALUES ('action:RF', 'action:AF'), ('action:AF', 'action:RF'), ('action:RF', 'action:NO'))"""
RATIO = "CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS holds, count(*) AS \"of\""


def earlier(scope: str, guard: str = "p.guard") -> str:
    return f"coalesce((SELECT min(e.seq) FROM ev e WHERE e.{scope} = i.{scope} AND e.type = {guard}) < i.seq, FALSE)"


def times(guard: str) -> str:
    return f"coalesce((SELECT count(*) FROM ev e WHERE e.episode = i.episode AND e.type = {guard}), 0)"


def guard_stats(scope: str) -> str:
    return f"""{USERS},
met AS (
  SELECT DISTINCT i.operator, i.subject, i.interaction, i.seq, e.type AS guard FROM inst i JOIN acts e
  ON e.{scope} = i.{scope} AND e.seq < i.seq AND e.type <> i.subject),
n AS (SELECT operator, subject, guard, count(*) AS n FROM met GROUP BY ALL),
t AS (SELECT operator, subject, count(*) AS instances FROM inst GROUP BY ALL)
SELECT operator, subject, guard, n, instances, round(n / instances, 6) AS share,
  CAST(row_number() OVER (PARTITION BY operator, subject ORDER BY n DESC, guard) AS INTEGER) AS rank
FROM n JOIN t USING (operator, subject)"""


def support(scope: str) -> str:
    return f"""{ORDERS}{PAIRS},
c AS (SELECT i.operator, i.subject, p.guard AS guards, {earlier(scope)} AS ok FROM inst i JOIN pairs p USING (subject))
SELECT operator, subject, guards, holds, "of", round(holds / "of", 6) AS ratio
FROM (SELECT operator, subject, guards, {RATIO} FROM c GROUP BY ALL)"""


def per_episode(guard: str, test: str, pairs: str) -> str:
    shown = "p.guard" if guard == "p.guard" else "''"
    return f"""{ORDERS}{pairs},
c AS (
  SELECT i.operator, i.subject, {shown} AS guards, i.episode, bool_and({times(guard)} {test}) AS ok
  FROM inst i JOIN pairs p USING (subject) GROUP BY ALL)
SELECT operator, subject, guards, holds, "of", round(holds / "of", 6) AS ratio
FROM (SELECT operator, subject, guards, {RATIO} FROM c GROUP BY operator, subject, guards)"""


SAME_SLOT = f"""{ORDERS},
sets(subject, guards) AS (VALUES ('action:RF', 'action:AF|action:NO'), ('action:AF', 'action:RF')),
c AS (
  SELECT i.operator, i.subject, s.guards,
    EXISTS (SELECT 1 FROM ev e WHERE e.interaction = i.interaction AND e.supplier = i.supplier AND e.seq < i.seq AND list_contains(string_split(s.guards, '|'), e.type)) AS ok
  FROM inst i JOIN sets s USING (subject))
SELECT operator, subject, guards, holds, "of", round(holds / "of", 6) AS ratio
FROM (SELECT operator, subject, guards, {RATIO} FROM c GROUP BY ALL)"""

CONDITIONED = f"""{ORDERS},
c AS (SELECT i.operator, i.intent AS value, {earlier('episode', "'action:AF'")} AS ok FROM inst i WHERE subject = 'action:RF')
SELECT operator, value, {RATIO} FROM c GROUP BY operator, value HAVING count(*) >= 5"""

VOCABULARY = f"""{ORDERS},
n AS (SELECT operator, subject, intent AS value, count(*) AS n FROM inst GROUP BY ALL),
k AS (SELECT *, count(*) OVER (PARTITION BY operator, subject) AS kinds FROM n)
SELECT operator, subject, 'episode.intent' AS fact, value, n FROM k WHERE kinds >= 2 AND n >= 5"""


def support_at(level: str) -> str:
    return f"""{ORDERS}{PAIRS},
c AS (SELECT i.operator, i.{level} AS scope, i.subject, p.guard, {earlier('interaction')} AS ok FROM inst i JOIN pairs p USING (subject))
SELECT operator, scope, subject, guard, {RATIO}, count(*) AS n FROM c GROUP BY operator, scope, subject, guard"""


VERDICTS = f"""{ORDERS}{PAIRS},
c AS (SELECT i.operator, i.team, i.agent, i.subject, p.guard, {earlier('episode')} AS ok FROM inst i JOIN pairs p USING (subject)),
s AS (
  SELECT operator, 'operator' AS level, operator AS scope, 0 AS depth, subject, guard, {RATIO} FROM c GROUP BY operator, subject, guard
  UNION ALL SELECT operator, 'team', team, 1, subject, guard, {RATIO} FROM c GROUP BY operator, team, subject, guard
  UNION ALL SELECT operator, 'agent', agent, 2, subject, guard, {RATIO} FROM c GROUP BY operator, agent, subject, guard),
good AS (
  SELECT *, row_number() OVER (PARTITION BY operator, subject, guard ORDER BY depth, "of" DESC, scope) AS place
  FROM s WHERE "of" >= 5 AND holds / "of" >= 0.3),
w AS (SELECT * FROM s WHERE level = 'operator' AND "of" >= 5),
k AS (
  SELECT a.operator, a.subject, a.guard, string_agg(b.operator, '|' ORDER BY b.operator) AS found, count(b.operator) AS n
  FROM w a LEFT JOIN w b ON a.subject = b.subject AND a.guard = b.guard AND a.operator <> b.operator AND b.holds / b."of" >= 0.3 GROUP BY ALL)
SELECT w.operator, w.subject, w.guard, CASE WHEN g.level IS NOT NULL THEN 'own' WHEN k.n >= 2 THEN 'borrowed' ELSE 'neither' END AS verdict,
  coalesce(g.level, '') AS level, coalesce(g.scope, '') AS scope, CASE WHEN g.level IS NULL AND k.n >= 2 THEN k.found ELSE '' END AS found_in,
  coalesce(g.holds, w.holds) AS holds, coalesce(g."of", w."of") AS "of", w.holds AS corpus_holds, w."of" AS corpus_of
FROM w JOIN k USING (operator, subject, guard) LEFT JOIN good g ON g.operator = w.operator AND g.subject = w.subject AND g.guard = w.guard AND g.place = 1"""

IDENTITY = r"""
WITH r(pattern, subject, guards, body, w) AS (VALUES
  ('X-implies-prior-Y', 'action:RF', 'action:AF', '"guard":"action:AF",', 'episode'),
  ('X-implies-prior-Y', 'action:AF', 'action:RF', '"guard":"action:RF",', 'episode'),
  ('X-implies-prior-Y', 'action:RF', 'action:NO', '"guard":"action:NO",', 'episode'),
  ('at-most-one-X', 'action:RF', '', '', 'episode'),
  ('no-X-without-prior-Y-same-S', 'action:RF', 'action:AF|action:NO', '"guards":"action:AF|action:NO","slot":"supplier",', 'interaction'))
SELECT pattern, subject, guards, substr(sha256('{"bindings":{' || body || '"subject":"' || subject || '"},"conditions":[],"family":"obligation","pattern":"' || pattern || '","window":"' || w || '"}'), 1, 16) AS id FROM r"""

RULES = f"""{USERS},
every(subject, guard) AS (VALUES ('action:purchase', 'action:signup'), ('action:signup', 'action:purchase'), ('action:purchase', 'action:view'),
  ('action:purchase', 'action:click'), ('action:signup', 'action:view'), ('action:signup', 'action:click')),
c AS (
  SELECT i.operator, 'E' AS kind, i.subject, p.guard, {earlier('episode')} AS ok FROM inst i JOIN every p USING (subject)
  UNION ALL SELECT i.operator, 'C', i.subject, p.guard, {earlier('interaction')} FROM inst i JOIN every p USING (subject)),
allr AS (SELECT operator, kind, subject, guard, {RATIO} FROM c GROUP BY operator, kind, subject, guard),
r AS (SELECT * FROM allr WHERE holds / "of" >= 0.45)"""
CYCLES = f"""{RULES}
SELECT a.operator, a.subject AS one, a.guard AS other, count(*) AS cycles FROM r a JOIN r b
ON a.operator = b.operator AND a.kind = b.kind AND a.subject = b.guard AND a.guard = b.subject WHERE a.subject < a.guard GROUP BY ALL"""
TWINS = f"""{RULES}
SELECT a.operator, a.subject, a.guard FROM r a JOIN r b USING (operator, subject, guard) WHERE a.kind = 'C' AND b.kind = 'E'"""
CHAINS = f"""{RULES}
SELECT a.operator, a.subject, a.guard, min(b.guard) AS through FROM r a JOIN r b ON a.operator = b.operator AND a.subject = b.subject AND b.guard <> a.guard
JOIN r d ON d.operator = a.operator AND d.subject = b.guard AND d.guard = a.guard WHERE a.kind = 'E' AND b.kind = 'E' AND d.kind = 'E' GROUP BY ALL"""
VACUITY = f"""{RULES}
SELECT operator, subject, guard, holds, "of", CAST(holds = "of" AS INTEGER) AS vacuous FROM allr WHERE kind = 'C'"""
STATUSES = f"""{RULES},
cyc AS (SELECT DISTINCT a.operator, a.kind, a.subject, a.guard FROM r a JOIN r b ON a.operator = b.operator AND a.kind = b.kind AND a.subject = b.guard AND a.guard = b.subject),
left_ AS (SELECT r.* FROM r ANTI JOIN cyc USING (operator, kind, subject, guard)),
imp AS (
  SELECT a.operator, a.kind, a.subject, a.guard FROM left_ a JOIN left_ b USING (operator, subject, guard) WHERE a.kind = 'C' AND b.kind = 'E'
  UNION SELECT a.operator, a.kind, a.subject, a.guard FROM left_ a JOIN left_ b ON a.operator = b.operator AND a.subject = b.subject AND b.guard <> a.guard AND b.kind = 'E'
    JOIN left_ d ON d.operator = a.operator AND d.subject = b.guard AND d.guard = a.guard AND d.kind = 'E' WHERE a.kind = 'E'),
s AS (
  SELECT a.operator, a.kind, CASE WHEN r.operator IS NULL THEN 'refused' WHEN c.operator IS NOT NULL THEN 'contradicted' WHEN i.operator IS NOT NULL THEN 'suppressed'
    WHEN a.kind = 'C' AND a.holds = a."of" THEN 'suppressed' ELSE 'proposed' END AS status
  FROM allr a LEFT JOIN r USING (operator, kind, subject, guard) LEFT JOIN cyc c USING (operator, kind, subject, guard) LEFT JOIN imp i USING (operator, kind, subject, guard))
SELECT operator, CASE kind WHEN 'E' THEN 'X-implies-prior-Y' ELSE 'no-X-without-prior-Y' END AS pattern, status, count(*) AS rules FROM s GROUP BY ALL"""

POINTS = f"""{ORDERS},
pt AS (
  SELECT operator, episode AS point, interaction, subject AS action, intent, agent, outcome FROM inst
  QUALIFY row_number() OVER (PARTITION BY episode ORDER BY seq) = 1)"""
ONE_FACT = f"""{POINTS},
items AS (
  SELECT operator, point, action, outcome, 'contact.segment = ' || agent AS item FROM pt
  UNION ALL SELECT operator, point, action, outcome, 'episode.intent = ' || intent FROM pt),
sel AS (SELECT operator, item, count(*) AS selected FROM items GROUP BY ALL HAVING count(*) >= 5),
hit AS (
  SELECT operator, item, action, count(*) AS matched, count(*) FILTER (outcome = 'resolved') AS good, count(outcome) AS judged FROM items GROUP BY ALL),
one AS (SELECT hit.*, selected FROM hit JOIN sel USING (operator, item)),
rules AS (SELECT * FROM one WHERE matched / selected >= 0.28 AND matched >= 5)"""
DEPTH1 = f"""{ONE_FACT}
SELECT operator, item AS conditions, action, matched, selected, good, judged FROM rules"""
DEPTH2 = f"""{ONE_FACT},
pairwise AS (
  SELECT operator, agent, intent, action, count(*) AS matched, count(*) FILTER (outcome = 'resolved') AS good, count(outcome) AS judged,
    sum(count(*)) OVER (PARTITION BY operator, agent, intent) AS selected FROM pt GROUP BY operator, agent, intent, action)
SELECT b.operator, 'contact.segment = ' || agent || ' and episode.intent = ' || intent AS conditions, b.action, b.matched, CAST(b.selected AS BIGINT) AS selected, b.good, b.judged
FROM pairwise b LEFT JOIN one x ON x.operator = b.operator AND x.action = b.action AND x.item = 'contact.segment = ' || agent
LEFT JOIN one y ON y.operator = b.operator AND y.action = b.action AND y.item = 'episode.intent = ' || intent
WHERE b.selected >= 5 AND b.matched / b.selected >= 0.28 AND b.matched >= 10
  AND b.matched / b.selected >= coalesce(x.matched / x.selected, 0) + 0.005 AND b.matched / b.selected >= coalesce(y.matched / y.selected, 0) + 0.005
  AND NOT EXISTS (SELECT 1 FROM rules r WHERE r.operator = b.operator AND r.item IN ('contact.segment = ' || agent, 'episode.intent = ' || intent))"""
COVER = DEPTH2.replace(POINTS, POINTS.replace("WITH ev", "WITH RECURSIVE ev", 1), 1)
COVER_HEAD, COVER_TAIL = COVER.rsplit("\nSELECT b.operator", 1)
#: The choice one rule after another, with the points answered so far and the rules kept as lists.
COVER = f"""{COVER_HEAD},
every AS (
  SELECT operator, item AS conditions, action, matched, selected FROM rules
  UNION ALL SELECT operator, conditions, action, matched, selected FROM (SELECT b.operator{COVER_TAIL})),
matched AS (
  SELECT e.*, row_number() OVER (PARTITION BY operator, action ORDER BY matched DESC, conditions) AS rank,
    (SELECT list(point) FROM pt WHERE pt.operator = e.operator AND pt.action = e.action AND list_has_all(['contact.segment = ' || agent, 'episode.intent = ' || intent], string_split(e.conditions, ' and '))) AS mine FROM every e),
walk AS (
  SELECT operator, action, CAST(0 AS BIGINT) AS rank, CAST([] AS VARCHAR[]) AS seen, CAST([] AS STRUCT(points VARCHAR[], rate DOUBLE, conditions VARCHAR)[]) AS kept FROM (SELECT DISTINCT operator, action FROM matched)
  UNION ALL
  SELECT operator, action, rank, CASE WHEN stays THEN list_concat(seen, fresh) ELSE seen END, CASE WHEN stays THEN list_append(kept, {{'points': mine, 'rate': rate, 'conditions': conditions}}) ELSE kept END FROM (
    SELECT *, len(fresh) >= 0.5 * len(mine) OR coalesce(len(list_intersect(host.points, mine)) >= 0.9 * len(mine) AND rate > host.rate + 0.005, FALSE) AS stays FROM (
      SELECT w.operator, w.action, m.rank, w.seen, w.kept, m.mine, m.matched / m.selected AS rate, m.conditions, [p FOR p IN m.mine IF NOT list_contains(w.seen, p)] AS fresh,
        list_reduce(w.kept, lambda a, b: CASE WHEN len(list_intersect(b.points, m.mine)) > len(list_intersect(a.points, m.mine)) THEN b ELSE a END, CAST({{'points': [], 'rate': 9.0, 'conditions': ''}} AS STRUCT(points VARCHAR[], rate DOUBLE, conditions VARCHAR))) AS host
      FROM walk w JOIN matched m ON m.operator = w.operator AND m.action = w.action AND m.rank = w.rank + 1))),
last AS (SELECT operator, action, unnest([k.conditions FOR k IN max_by(kept, rank)]) AS conditions FROM walk GROUP BY operator, action)
SELECT operator, conditions, action, matched, selected FROM every JOIN last USING (operator, action, conditions)"""
WITHHELD = f"""{ONE_FACT}
SELECT operator, action, count(*) AS candidates FROM rules WHERE action LIKE 'action:R%' GROUP BY ALL"""
LIFT = f"""{ONE_FACT},
base AS (SELECT operator, action, count(*) AS base, sum(count(*)) OVER (PARTITION BY operator) AS base_of FROM pt GROUP BY operator, action)
SELECT operator, item AS conditions, action, matched, selected, base, CAST(base_of AS BIGINT) AS base_of, round(matched / selected - base / base_of, 6) AS lift FROM rules JOIN base USING (operator, action)"""
STRATA = f"""{POINTS},
x AS (SELECT operator, action, agent AS stratum, intent = 'intent:1-URGENT' AS has FROM pt),
t AS (SELECT operator, stratum, count(*) FILTER (has) AS with_of, count(*) FILTER (NOT has) AS without_of FROM x GROUP BY ALL)
SELECT operator, action, stratum, count(*) FILTER (has) AS with_fact, with_of, count(*) FILTER (NOT has) AS without, without_of FROM x JOIN t USING (operator, stratum) GROUP BY ALL"""

EXERCISE = f"""{ORDERS},
k AS (
  SELECT 'c1' AS clause, {earlier('interaction', "'action:AF'")} AS ok FROM inst i WHERE subject = 'action:RF'
  UNION ALL SELECT 'c3', {earlier('episode', "'action:RF'")} FROM inst i WHERE subject = 'action:AF'
  UNION ALL SELECT 'c4', {earlier('interaction', "'action:NO'")} FROM inst i WHERE subject = 'action:RF' AND intent = 'intent:1-URGENT'
  UNION ALL SELECT 'c6', {earlier('interaction', "'action:NO'")} FROM inst i WHERE subject = 'action:RF' AND intent = 'intent:2-HIGH'
  UNION ALL SELECT 'c7', {earlier('interaction', "'action:AF'")} FROM inst i WHERE subject = 'action:RF' AND intent = 'intent:1-URGENT'
  UNION ALL SELECT 'c2', count(*) <= 1 FROM inst WHERE subject = 'action:RF' GROUP BY interaction, episode),
ex AS (SELECT clause, count(*) AS exercised, count(*) FILTER (NOT ok) AS violated, count(*) FILTER (ok) AS kept FROM k GROUP BY clause)"""
CONTROLS = f"""{EXERCISE}
SELECT count(*) FILTER (violated > 0) AS violated_at_least_once, count(*) FILTER (exercised >= 5 AND kept / exercised >= 0.6) AS kept_at_own_support, 6 - count(*) AS never_exercised,
  (SELECT round(count(*) FILTER (outcome <> 'resolved') / nullif(count(outcome), 0), 6) FROM (SELECT DISTINCT episode, outcome FROM ev)) AS failed_share FROM ex"""
POLICY = f"""{EXERCISE}{PAIRS},
c AS (
  SELECT operator, 'X-implies-prior-Y' AS pattern, subject, p.guard AS guards, {earlier('episode')} AS ok FROM inst i JOIN pairs p USING (subject)
  UNION ALL SELECT operator, 'no-X-without-prior-Y', subject, p.guard, {earlier('interaction')} FROM inst i JOIN pairs p USING (subject)
  UNION ALL SELECT operator, 'at-most-one-X', 'action:RF', '', count(*) <= 1 FROM inst WHERE subject = 'action:RF' GROUP BY operator, interaction, episode),
sup AS (SELECT operator, pattern, subject, guards, {RATIO} FROM c GROUP BY operator, pattern, subject, guards),
pr AS (
  SELECT CASE WHEN guards = '' THEN operator || '/' || pattern || '/' || subject || '/' ELSE operator || '/' || pattern || '/' || subject || '/' || guards END AS id,
    operator AS scope, pattern, subject, guards, holds / "of" >= 0.3 AS good FROM sup),
cl(clause, shape, subject, guard, flow) AS (VALUES ('c1', 'p', 'action:RF', 'action:AF', NULL), ('c2', 'o', 'action:RF', '', NULL), ('c3', 'p', 'action:AF', 'action:RF', NULL),
  ('c4', 'p', 'action:RF', 'action:NO', 'intent:1-URGENT'), ('c6', 'p', 'action:RF', 'action:NO', 'intent:2-HIGH'), ('c7', 'p', 'action:RF', 'action:AF', 'intent:1-URGENT'))"""


def aligned(which: str, name: str = "al") -> str:
    """Without conditions a rule is exact for a clause without a flow, or if its pair's clauses name all the flows that clauses of the subject name."""
    return f""",
{name} AS (
  SELECT r.id AS rule, r.scope, cl.clause, CASE WHEN cl.flow IS NULL THEN 'exact' WHEN cl.shape = 'p'
    AND (SELECT count(DISTINCT c2.flow) FROM cl c2 WHERE c2.shape = 'p' AND c2.subject = cl.subject AND c2.guard = cl.guard)
      = (SELECT count(DISTINCT c3.flow) FROM cl c3 WHERE c3.shape = 'p' AND c3.subject = cl.subject) THEN 'exact' ELSE 'general' END AS kind
  FROM ({which}) r JOIN cl ON r.subject = cl.subject AND r.guards = cl.guard AND (r.pattern = 'at-most-one-X') = (cl.shape = 'o'))"""


GOOD_RULES, ALL_RULES = aligned("SELECT * FROM pr WHERE good"), aligned("SELECT * FROM pr")
ALIGNMENT = f"""{POLICY}{GOOD_RULES}
SELECT DISTINCT rule, scope, clause, kind FROM al"""
METRICS = f"""{POLICY}{ALL_RULES},
best AS (SELECT p.id, p.scope, max(CASE kind WHEN 'exact' THEN 3 WHEN 'general' THEN 2 ELSE 0 END) AS b FROM pr p LEFT JOIN al ON al.rule = p.id WHERE p.good GROUP BY ALL),
ours AS (SELECT count(*) AS rules, count(*) FILTER (b = 3) AS strict, count(*) FILTER (b >= 2) AS lenient, count(*) FILTER (b = 1) AS to_confirm, count(*) FILTER (b = 0) AS unaligned, count(*) AS alignable, CAST(0 AS BIGINT) AS unalignable FROM best),
rec AS (SELECT clause, max(CASE kind WHEN 'exact' THEN 3 ELSE 2 END) AS b FROM al JOIN pr ON pr.id = al.rule AND pr.good GROUP BY clause),
theirs AS (SELECT 6 AS clauses, count(*) FILTER (b = 3) AS recalled_strict, count(*) AS recalled_lenient, count(*) FILTER (clause = 'c3') AS recalled_adjacent FROM rec),
ref AS (SELECT count(*) AS refused, count(DISTINCT al.rule) AS refused_wrongly FROM (SELECT * FROM pr WHERE NOT good) p LEFT JOIN (SELECT DISTINCT rule FROM al WHERE kind = 'exact') al ON al.rule = p.id),
m AS (
  SELECT *, round(strict / nullif(rules, 0), 6) AS precision_strict, round(lenient / nullif(rules, 0), 6) AS precision_lenient, round(lenient / nullif(alignable, 0), 6) AS precision_alignable, round(recalled_strict / clauses, 6) AS recall_strict,
    round(recalled_lenient / clauses, 6) AS recall_lenient, round(1 - refused_wrongly / nullif(refused, 0), 6) AS refusal_correct FROM ours, theirs, ref)"""
GATE = f"""{METRICS}
SELECT precision_lenient, recall_lenient, refusal_correct, CASE WHEN precision_lenient IS NULL THEN 'unmeasured'
  WHEN precision_lenient < 0.4 OR refusal_correct <= 0.5 THEN 'falsified'
  WHEN precision_lenient >= 0.7 AND coalesce(recall_lenient, 0) >= 0.5 AND coalesce(refusal_correct, 1) >= 0.8 THEN 'target' ELSE 'between' END AS gate FROM m"""
DIFF = f"""{POLICY}{GOOD_RULES}
SELECT CASE WHEN a.rule IS NOT NULL THEN 'confirmed' ELSE 'tribal' END AS region,
  CASE WHEN a.rule IS NOT NULL THEN 'confirmed' WHEN EXISTS (SELECT 1 FROM cl WHERE cl.guard <> '' AND cl.subject = p.subject AND cl.guard = p.guards) THEN 'extended-beyond-policy' ELSE 'novel' END AS kind, p.id
FROM pr p LEFT JOIN (SELECT DISTINCT rule FROM al) a ON a.rule = p.id WHERE p.good
UNION ALL SELECT 'gap', CASE WHEN coalesce(exercised, 0) = 0 THEN 'never-exercised' WHEN violated > 0 THEN 'violated' ELSE 'kept-not-mined' END, cl.clause
FROM cl LEFT JOIN ex USING (clause) WHERE cl.clause NOT IN (SELECT clause FROM al)
UNION ALL SELECT 'inexpressible', 'tone', 'c5'"""
GOLD = f"""{POLICY}{GOOD_RULES},
votes AS (
  SELECT rule, clause, rater, CASE WHEN rater = 'bo' AND rule LIKE '%ASIA%' THEN 'rejected' ELSE 'confirmed' END AS verdict
  FROM (SELECT DISTINCT rule, clause FROM al UNION ALL SELECT 'a rule nobody mined', 'c1'), (VALUES ('ann'), ('bo')) r(rater)),
p AS (
  SELECT rule, clause, count(DISTINCT rater) AS raters, count(DISTINCT verdict) AS verdicts, 2 * count(*) FILTER (verdict = 'confirmed') >= count(*) AS yes FROM votes GROUP BY rule, clause),
m AS (SELECT p.*, EXISTS (SELECT 1 FROM al WHERE al.rule = p.rule AND al.clause = p.clause) AS matched FROM p)
SELECT count(*) AS pairs, count(*) FILTER (raters > 1) AS double_rated, count(*) FILTER (raters > 1 AND verdicts = 1) AS raters_agree,
  count(*) FILTER (matched = yes) AS matcher_agrees, count(*) FILTER (NOT matched) AS missed FROM m"""

SERVED = f"""{ORDERS},
pt AS (SELECT * FROM inst QUALIFY row_number() OVER (PARTITION BY episode ORDER BY seq) = 1),
q AS (
  SELECT i.episode AS request, i.operator, i.subject AS considering, outcome, CASE WHEN intent <> 'intent:5-LOW' THEN intent END AS known,
    {earlier('interaction', "'action:AF'")} AS had_af, {earlier('episode', "'action:RF'")} AS had_rf FROM pt i),
a AS (
  SELECT *, CASE WHEN considering = 'action:RF' AND NOT had_af THEN 'r1' WHEN considering = 'action:AF' AND known = 'intent:1-URGENT' AND NOT had_rf THEN 'r2' ELSE '' END AS warned,
    CASE WHEN considering = 'action:RF' AND had_af THEN 'r1' WHEN considering = 'action:AF' AND known = 'intent:1-URGENT' AND had_rf THEN 'r2' ELSE '' END AS cleared,
    operator = 'ASIA' AND coalesce(known = 'intent:1-URGENT', FALSE) AS hinted,
    CASE WHEN known IS NULL AND (considering = 'action:AF' OR operator = 'ASIA') THEN 'episode.intent' ELSE '' END AS missing FROM q),
v AS (SELECT *, CASE WHEN warned <> '' THEN 'warn' WHEN hinted THEN 'recommend' WHEN cleared <> '' AND missing = '' THEN 'clear' ELSE 'abstain' END AS verdict FROM a),
w AS (SELECT *, CASE WHEN verdict = 'abstain' THEN CASE WHEN missing <> '' THEN 'unknown_fact' ELSE 'uncovered' END ELSE '' END AS why FROM v)"""

PROSE = r"""
WITH said AS (
  SELECT CAST(conv_id AS VARCHAR) AS interaction, CAST(turn AS INTEGER) AS seq, role, text,
    conv_id || '#' || sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role) AS episode FROM conversations),
clean AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<email>', 'g'), '\+?\d[\d ()-]{7,}\d', '<phone>', 'g'), '\d{4,}', '<digits>', 'g') AS t FROM said),
whole AS (
  SELECT interaction, episode, seq, string_agg(text, chr(10)) OVER (PARTITION BY episode ORDER BY seq) AS raw FROM said),
long_ AS (
  SELECT interaction, episode, seq, regexp_replace(regexp_replace(regexp_replace(raw, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<email>', 'g'), '\+?\d[\d ()-]{7,}\d', '<phone>', 'g'), '\d{4,}', '<digits>', 'g') AS t FROM whole),
answers AS (
  SELECT interaction, episode, seq, t, CASE WHEN regexp_matches(t, '\bthe\b') THEN 0.97 WHEN contains(lower(t), 'the') THEN 0.6 ELSE 0.05 END AS p FROM clean WHERE length(trim(t)) > 0)"""
VALUE = "CASE WHEN p >= 0.9 THEN 'true' WHEN p <= 0.1 THEN 'false' END"

LIFECYCLE = """
WITH x AS (SELECT o_orderpriority AS id, o_orderstatus AS scope, o_orderkey % 2 AS half, o_totalprice > 200000 AS kept FROM orders),
a AS (SELECT id, scope, count(*) FILTER (kept) AS holds, count(*) AS n, CASE id WHEN '1-URGENT' THEN 'real' WHEN '2-HIGH' THEN 'not_real' WHEN '5-LOW' THEN 'refused' ELSE 'proposed' END AS was FROM x WHERE half = 0 GROUP BY ALL),
b AS (SELECT id, scope, count(*) FILTER (kept) AS holds, count(*) AS n, CASE WHEN scope = 'O' THEN 'refused' ELSE 'proposed' END AS now FROM x
  WHERE half = 1 AND NOT (id = '5-LOW' AND scope = 'F') AND NOT (id = '3-MEDIUM' AND scope = 'P') GROUP BY ALL),
j AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.scope, b.scope) AS scope, a.was, b.now, a.holds AS h1, a.n AS n1, b.holds AS h2, b.n AS n2 FROM a FULL JOIN b ON a.id = b.id AND a.scope = b.scope),
k AS (SELECT *, CASE WHEN was IS NULL THEN 'inserted' WHEN now IS NULL THEN CASE WHEN was IN ('real', 'not_real', 'narrowed', 'proposed') THEN 'retired' ELSE 'removed' END
  WHEN was = 'real' AND (n2 < 5 OR now = 'refused') THEN 'retired' WHEN was = 'not_real' AND abs(h2 / n2 - h1 / n1) >= 0.1 THEN 'reproposed' WHEN was IN ('real', 'not_real') THEN 'kept' ELSE 'updated' END AS change FROM j)
SELECT id, scope, coalesce(h2, h1) AS holds, coalesce(n2, n1) AS "of", CASE change WHEN 'retired' THEN 'retired' WHEN 'reproposed' THEN 'proposed' WHEN 'kept' THEN was WHEN 'removed' THEN was ELSE now END AS status,
  CASE WHEN change = 'retired' AND now IS NULL THEN 'not mined by run r2' WHEN change = 'retired' THEN 'support is gone in run r2' WHEN change = 'reproposed' THEN 'support changed in run r2' ELSE '' END AS reason, change FROM k"""

SWEEP = f"""{USERS},
grid(point, own_support, guard_support, min_instances) AS (
  SELECT CAST(row_number() OVER (ORDER BY a, b, c) - 1 AS INTEGER), CAST(a AS DOUBLE), CAST(b AS DOUBLE), CAST(c AS INTEGER) FROM (VALUES (0.45), (0.6)) x(a), (VALUES (0.3), (0.6)) y(b), (VALUES (5), (400)) z(c)),
total AS (SELECT operator, subject, count(*) AS instances FROM inst GROUP BY ALL),
met AS (
  SELECT DISTINCT 'X-implies-prior-Y' AS pattern, i.operator, i.subject, i.interaction, i.seq, e.type AS guard FROM inst i JOIN acts e ON e.episode = i.episode AND e.seq < i.seq AND e.type <> i.subject
  UNION ALL SELECT DISTINCT 'no-X-without-prior-Y', i.operator, i.subject, i.interaction, i.seq, e.type FROM inst i JOIN acts e ON e.interaction = i.interaction AND e.seq < i.seq AND e.type <> i.subject),
counted AS (SELECT pattern, operator, subject, guard, count(*) AS n FROM met GROUP BY ALL),
times AS (SELECT episode, type AS guard, count(*) AS times FROM acts GROUP BY ALL),
single AS (SELECT operator, subject, guard FROM (SELECT DISTINCT operator, subject, episode FROM inst) JOIN times USING (episode) GROUP BY ALL HAVING max(times) <= 1),
places AS (
  SELECT *, row_number() OVER (PARTITION BY pattern, operator, subject ORDER BY n DESC, guard) AS rank FROM counted
  UNION ALL SELECT 'exactly-one-Y-per-X', operator, subject, guard, n, row_number() OVER (PARTITION BY operator, subject ORDER BY n DESC, guard) FROM counted JOIN single USING (operator, subject, guard) WHERE pattern = 'X-implies-prior-Y'
  UNION ALL SELECT 'at-most-one-X', operator, subject, '', instances, 1 FROM total),
specs AS (
  SELECT DISTINCT point, own_support, guard_support, min_instances, pattern, subject, guard FROM places JOIN total USING (operator, subject), grid
  WHERE rank <= 3 AND instances >= min_instances AND CASE pattern WHEN 'exactly-one-Y-per-X' THEN n / instances >= 0.5 WHEN 'at-most-one-X' THEN TRUE ELSE n / instances >= guard_support END),
asked AS (SELECT DISTINCT pattern, subject, guard FROM specs),
units AS (
  SELECT a.*, i.operator, i.team, m.guard IS NOT NULL AS ok, 1 AS n FROM inst i JOIN asked a USING (subject) LEFT JOIN met m
  ON m.pattern = a.pattern AND m.interaction = i.interaction AND m.seq = i.seq AND m.subject = i.subject AND m.guard = a.guard WHERE a.pattern IN ('X-implies-prior-Y', 'no-X-without-prior-Y')
  UNION ALL
  SELECT a.*, i.operator, i.team, CASE WHEN a.guard = '' THEN coalesce(t.times, 0) <= 1 ELSE coalesce(t.times, 0) = 1 END, i.n
  FROM (SELECT operator, team, subject, episode, count(*) AS n FROM inst GROUP BY ALL) i JOIN asked a USING (subject) LEFT JOIN times t ON t.episode = i.episode AND t.guard = CASE WHEN a.guard = '' THEN a.subject ELSE a.guard END
  WHERE a.pattern IN ('at-most-one-X', 'exactly-one-Y-per-X')),
levels AS (
  SELECT pattern, subject, guard, operator, 0 AS level, operator AS scope, count(*) FILTER (ok) AS h, count(*) AS "of", sum(n) AS n FROM units GROUP BY ALL
  UNION ALL SELECT pattern, subject, guard, operator, 1, team, count(*) FILTER (ok), count(*), sum(n) FROM units GROUP BY ALL),
here AS (SELECT * FROM specs JOIN levels USING (pattern, subject, guard) JOIN total USING (operator, subject) WHERE instances >= min_instances),
own AS (
  SELECT point, pattern, subject, guard, operator, h, "of" FROM here WHERE "of" >= min_instances AND h / "of" >= own_support
  QUALIFY row_number() OVER (PARTITION BY point, pattern, subject, guard, operator ORDER BY level, n DESC, scope) = 1),
whole AS (SELECT * FROM here WHERE level = 0 AND n >= min_instances),
keepers AS (SELECT point, pattern, subject, guard, list(operator) AS them FROM whole WHERE "of" >= min_instances AND h / "of" >= own_support GROUP BY ALL),
verdicts AS (
  SELECT w.point, w.pattern, w.subject, w.guard, w.operator, w.own_support, w.h AS corpus_holds, w."of" AS corpus_of, coalesce(o.h, w.h) AS holds, coalesce(o."of", w."of") AS "of",
    CASE WHEN o.h IS NOT NULL THEN 'own' WHEN len([x FOR x IN coalesce(k.them, []) IF x <> w.operator]) >= 3 THEN 'borrowed' ELSE 'neither' END AS verdict
  FROM whole w LEFT JOIN own o USING (point, pattern, subject, guard, operator) LEFT JOIN keepers k USING (point, pattern, subject, guard)),
first AS (
  SELECT *, CASE WHEN pattern = 'at-most-one-X' AND corpus_holds = corpus_of THEN 'suppressed' WHEN verdict = 'neither' THEN 'refused' ELSE 'proposed' END AS s1 FROM verdicts
  WHERE verdict <> 'own' OR holds / "of" >= CASE WHEN pattern = 'no-X-without-prior-Y' THEN own_support ELSE 0.5 END),
second AS (
  SELECT f.*, CASE WHEN s1 = 'proposed' AND pattern IN ('X-implies-prior-Y', 'no-X-without-prior-Y')
    AND EXISTS (SELECT 1 FROM first g WHERE g.point = f.point AND g.operator = f.operator AND g.pattern = f.pattern AND g.subject = f.guard AND g.guard = f.subject AND g.s1 = 'proposed') THEN 'contradicted' ELSE s1 END AS s2 FROM first f),
plain AS (SELECT point, operator, subject, guard FROM second WHERE pattern = 'X-implies-prior-Y' AND s2 = 'proposed'),
third AS (
  SELECT s.*, CASE WHEN s2 <> 'proposed' THEN s2
    WHEN pattern IN ('no-X-without-prior-Y', 'exactly-one-Y-per-X') AND EXISTS (SELECT 1 FROM plain p WHERE p.point = s.point AND p.operator = s.operator AND p.subject = s.subject AND p.guard = s.guard) THEN 'suppressed'
    WHEN pattern = 'X-implies-prior-Y' AND EXISTS (SELECT 1 FROM plain p JOIN plain q ON q.point = p.point AND q.operator = p.operator AND q.subject = p.guard
      WHERE p.point = s.point AND p.operator = s.operator AND p.subject = s.subject AND p.guard <> s.guard AND q.guard = s.guard) THEN 'suppressed'
    WHEN pattern = 'no-X-without-prior-Y' AND corpus_holds = corpus_of THEN 'suppressed' ELSE 'proposed' END AS status FROM second s)"""

STORE = """
WITH x AS (SELECT o_orderpriority AS id, o_orderstatus AS scope, o_orderkey, o_orderkey % 2 AS half, o_totalprice > 200000 AS kept FROM orders),
a AS (
  SELECT id, scope, count(*) FILTER (kept) AS h, count(*) AS n, min(CAST(o_orderkey AS VARCHAR)) FILTER (o_orderkey = first) AS proof,
    CASE WHEN id = '1-URGENT' THEN 'real' WHEN id = '2-HIGH' THEN 'not_real' WHEN id = '3-MEDIUM' AND scope = 'F' THEN 'narrowed' WHEN id = '5-LOW' THEN 'refused' ELSE 'proposed' END AS was
  FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY id, scope, half) AS first FROM x) WHERE half = 0 GROUP BY ALL),
b AS (
  SELECT id, scope, count(*) FILTER (kept) AS h, count(*) AS n, min(CAST(o_orderkey AS VARCHAR)) FILTER (o_orderkey = first) AS proof, CASE WHEN scope = 'O' THEN 'refused' ELSE 'proposed' END AS now
  FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY id, scope, half) AS first FROM x) WHERE half = 1 AND NOT (id = '5-LOW' AND scope = 'F') AND NOT (id = '4-NOT SPECIFIED' AND scope = 'P') GROUP BY ALL),"""

FLOWS = f"""{ORDERS}{PAIRS},
met AS (
  SELECT i.operator, i.subject, i.intent, p.guard, {earlier('episode')} AS ok, 'X-implies-prior-Y' AS pattern FROM inst i JOIN pairs p USING (subject)
  UNION ALL SELECT i.operator, i.subject, i.intent, p.guard, {earlier('interaction')}, 'no-X-without-prior-Y' FROM inst i JOIN pairs p USING (subject)),
rules AS (
  SELECT operator, subject, guard, intent, operator || '/' || pattern || '/' || subject || '/' || guard || '/' || intent AS id FROM met GROUP BY operator, subject, guard, intent, pattern HAVING count(*) FILTER (ok) / count(*) >= 0.3),
clauses(clause, subject, guard, intent) AS (VALUES ('c1', 'action:RF', 'action:AF', NULL), ('c3', 'action:AF', 'action:RF', NULL), ('c4', 'action:RF', 'action:NO', 'intent:1-URGENT'), ('c6', 'action:RF', 'action:NO', 'intent:2-HIGH'), ('c7', 'action:RF', 'action:AF', 'intent:1-URGENT')),
pairs_of AS (SELECT r.*, c.clause, c.intent AS flow, CASE WHEN c.intent IS NULL THEN 'proposed' ELSE 'exact' END AS kind FROM rules r JOIN clauses c USING (subject, guard) WHERE c.intent IS NULL OR c.intent = r.intent)"""

LABELLED = """
WITH s AS (SELECT lang AS pred, (least(n_chars, 2000) + 10) // 20 AS q, quality = 1 AS label FROM documents JOIN labels USING (doc_id))"""

SQL = {
    "observed_distribution": f"{LABELLED}\nSELECT pred, CASE WHEN label THEN 'yes' ELSE 'no' END AS label, q / 100 AS p, count(*) AS n FROM s GROUP BY ALL",
    "calibration_bands": f"""{LABELLED},
size AS (SELECT pred, count(*) AS n, count(*) FILTER (label) AS yes, avg(q / 100) FILTER (label) - avg(q / 100) FILTER (NOT label) AS apart FROM s GROUP BY pred),
modes AS (SELECT s.pred, q FROM s JOIN size USING (pred) GROUP BY s.pred, q, n HAVING count(*) * 10 >= n),
c AS (SELECT pred, edge, count(*) FILTER (q >= edge) AS above, count(*) FILTER (q >= edge AND label) AS sure FROM s, (SELECT unnest(range(101)) AS edge) GROUP BY ALL),
e AS (SELECT pred, min(edge) FILTER (above > 0 AND sure / above >= 0.85) AS up FROM c WHERE NOT EXISTS (SELECT 1 FROM modes m WHERE m.pred = c.pred AND abs(m.q - c.edge) <= 2) GROUP BY pred),
p AS (
  SELECT pred, up, CASE WHEN coalesce(apart, 0) < 0 THEN 'labels not separated' WHEN n < 40 OR yes < 5 OR n - yes < 5 THEN 'too few labels' WHEN up IS NULL THEN 'not precise anywhere' ELSE '' END AS problem
  FROM size LEFT JOIN e USING (pred))
SELECT pred, CASE WHEN problem = '' THEN up / 100 END AS assert_at, problem FROM p""",
    "recommend_provenance": f"""{ONE_FACT.replace("intent, agent, outcome FROM inst", "intent, team, agent, outcome FROM inst", 1)},
known AS (SELECT operator, team, agent, action, unnest(['contact.segment = ' || agent, 'episode.intent = ' || intent]) AS item FROM pt),
asked AS (SELECT DISTINCT item, action AS advised FROM rules),
scored AS (SELECT a.*, operator, team, agent, action = advised AS ok FROM asked a JOIN known USING (item)),
levels AS (
  SELECT item, advised, operator, 0 AS rank, 'operator' AS level, operator AS scope, count(*) FILTER (ok) AS h, count(*) AS n FROM scored GROUP BY ALL
  UNION ALL SELECT item, advised, operator, 1, 'team', team, count(*) FILTER (ok), count(*) FROM scored GROUP BY ALL
  UNION ALL SELECT item, advised, operator, 2, 'agent', agent, count(*) FILTER (ok), count(*) FROM scored GROUP BY ALL),
own AS (SELECT * FROM levels WHERE n >= 30 AND h / n >= 0.3 QUALIFY row_number() OVER (PARTITION BY item, advised, operator ORDER BY rank, n DESC, scope) = 1),
whole AS (SELECT * FROM levels WHERE rank = 0 AND n >= 30),
keepers AS (SELECT item, advised, list(operator ORDER BY operator) AS them FROM whole WHERE h / n >= 0.3 GROUP BY ALL)
SELECT r.operator, r.item AS conditions, r.action, CASE WHEN o.h IS NOT NULL THEN 'own' WHEN len(e) >= 2 THEN 'borrowed' ELSE 'neither' END AS verdict, coalesce(o.level, '') AS level, coalesce(o.scope, '') AS scope,
  CASE WHEN o.h IS NULL AND len(e) >= 2 THEN array_to_string(e, '|') ELSE '' END AS found_in, coalesce(o.h, w.h) AS holds, coalesce(o.n, w.n) AS "of", w.h AS corpus_holds, w.n AS corpus_of
FROM rules r JOIN (SELECT w.*, [x FOR x IN coalesce(k.them, []) IF x <> w.operator] AS e FROM whole w LEFT JOIN keepers k USING (item, advised)) w ON w.item = r.item AND w.advised = r.action AND w.operator = r.operator
LEFT JOIN own o ON o.item = r.item AND o.advised = r.action AND o.operator = r.operator""",
    "alignment_of_flows": f"{FLOWS}\nSELECT id AS rule, operator AS scope, clause, kind FROM pairs_of",
    "diff_of_flows": f"""{FLOWS},
best AS (SELECT r.id, r.subject, r.guard, r.intent, max(CASE p.kind WHEN 'exact' THEN 3 WHEN 'proposed' THEN 1 ELSE 0 END) AS b FROM rules r LEFT JOIN pairs_of p USING (id) GROUP BY ALL),
other AS (SELECT b.id, string_agg(DISTINCT coalesce(c.intent, '(every flow)'), '|' ORDER BY coalesce(c.intent, '(every flow)')) AS elsewhere FROM best b JOIN clauses c USING (subject, guard) WHERE coalesce(c.intent, '') <> b.intent GROUP BY b.id)
SELECT CASE WHEN b = 3 THEN 'confirmed' WHEN b = 1 THEN 'undecided' ELSE 'tribal' END AS region, CASE WHEN b = 3 THEN 'confirmed' WHEN b = 1 THEN 'undecided' WHEN elsewhere IS NULL THEN 'novel' ELSE 'extended-beyond-policy' END AS kind, id,
  CASE WHEN b > 0 THEN '' ELSE coalesce(elsewhere, '') END AS elsewhere FROM best LEFT JOIN other USING (id)""",
    "slots_before": f"""{USERS.replace("'op-' ||", "json_extract_string(props, '$.k') AS k, 'op-' ||", 1)}
SELECT i.interaction, i.episode, i.seq, arg_max(e.k, e.seq) AS k FROM inst i JOIN ev e ON e.episode = i.episode AND e.seq < i.seq WHERE e.k IS NOT NULL GROUP BY ALL""",
    "slot_vocabulary": f"""{ORDERS},
known AS (SELECT i.operator, i.subject, i.interaction, i.seq, arg_max(e.supplier, e.seq) AS supplier FROM inst i JOIN ev e ON e.episode = i.episode AND e.seq < i.seq GROUP BY ALL),
n AS (SELECT operator, subject, supplier, count(*) AS n FROM known GROUP BY ALL)
SELECT operator, subject, 'slot.supplier' AS fact, CAST(supplier AS VARCHAR) AS value, n FROM n QUALIFY count(*) OVER (PARTITION BY operator, subject) >= 2 AND n >= 5""",
    "swept_rules": f'{SWEEP}\nSELECT point, operator, pattern, subject, guard, verdict, status, holds, "of", corpus_holds, corpus_of FROM third',
    "mining_sweep": f"""{SWEEP},
clauses(clause, pattern, subject, guard) AS (VALUES ('u1', 'X-implies-prior-Y', 'action:purchase', 'action:signup'), ('u1', 'no-X-without-prior-Y', 'action:purchase', 'action:signup'), ('u2', 'at-most-one-X', 'action:signup', ''),
  ('u3', 'X-implies-prior-Y', 'action:signup', 'action:view'), ('u3', 'no-X-without-prior-Y', 'action:signup', 'action:view')),
r AS (SELECT t.*, clause FROM third t LEFT JOIN clauses c USING (pattern, subject, guard) WHERE status IN ('proposed', 'refused'))
SELECT min_instances, own_support, guard_support, proposed, refused, round(aligned / nullif(proposed, 0), 6) AS precision_lenient, round(recalled / 3, 6) AS recall_lenient, round(1 - wrong / nullif(refused, 0), 6) AS refusal_correct FROM (
  SELECT g.*, count(*) FILTER (status = 'proposed') AS proposed, count(*) FILTER (status = 'refused') AS refused, count(*) FILTER (status = 'proposed' AND clause IS NOT NULL) AS aligned,
    count(DISTINCT clause) FILTER (status = 'proposed') AS recalled, count(*) FILTER (status = 'refused' AND clause IS NOT NULL) AS wrong
  FROM grid g LEFT JOIN (SELECT point, status, clause FROM r) r USING (point) GROUP BY ALL)""",
    "rule_store": f"""{STORE}
j AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.scope, b.scope) AS scope, was, now, a.h AS h1, a.n AS n1, b.h AS h2, b.n AS n2, a.proof AS p1, b.proof AS p2 FROM a FULL JOIN b ON a.id = b.id AND a.scope = b.scope),
k AS (
  SELECT *, CASE WHEN was IS NULL THEN 'inserted' WHEN now IS NULL THEN CASE WHEN was = 'refused' THEN 'removed' ELSE 'retired' END WHEN was = 'real' AND (n2 < 5 OR now = 'refused') THEN 'retired'
    WHEN was = 'not_real' AND abs(h2 / n2 - h1 / n1) >= 0.1 THEN 'reproposed' WHEN was IN ('real', 'not_real', 'narrowed') THEN 'kept' ELSE 'updated' END AS change FROM j)
SELECT id, scope, coalesce(h2, h1) AS holds, coalesce(n2, n1) AS "of", CASE change WHEN 'retired' THEN 'retired' WHEN 'reproposed' THEN 'proposed' WHEN 'kept' THEN was ELSE now END AS status, 'r2' AS run,
  CASE WHEN change = 'retired' AND now IS NULL THEN 'not mined by run r2' WHEN change = 'retired' THEN 'support is gone in run r2' ELSE '' END AS retired_reason,
  CASE WHEN change = 'reproposed' THEN 'support changed in run r2' ELSE '' END AS reproposed_reason, coalesce(p2, p1) AS proof, CAST(1 AS BIGINT) AS proofs
FROM k WHERE change <> 'removed'""",
    "verdict_history": f"""{STORE}
said AS (SELECT *, id = '3-MEDIUM' AS narrow FROM a WHERE id IN ('1-URGENT', '2-HIGH') OR id = '3-MEDIUM' AND scope = 'F')
SELECT id, scope, was AS verdict, CASE WHEN id = '2-HIGH' THEN '{{not json' ELSE '' END AS note, CASE WHEN narrow THEN 'episode.intent' ELSE '' END AS fact, CASE WHEN narrow THEN 'intent:x' ELSE '' END AS value,
  h AS holds, n AS "of", 'ann' AS reviewer FROM said""",
    "audit_counts": f"""{USERS},
s AS (SELECT subject, count(*) AS n FROM inst GROUP BY ALL)
SELECT count(DISTINCT interaction) AS interactions, count(*) AS events, count(DISTINCT episode) AS episodes, count(DISTINCT operator) AS operators, count(DISTINCT team) AS teams, 0 AS agents,
  0 AS unknown_events, (SELECT count(*) FROM s WHERE n >= 5) AS subjects, (SELECT count(*) FROM s WHERE n < 5) AS below_floor, round(count(DISTINCT episode) / count(DISTINCT interaction), 6) AS episodes_per_interaction,
  round(1 - (SELECT count(DISTINCT interaction) FROM inst) / count(DISTINCT interaction), 6) AS without_consequence, 0 AS too_many_unknown, CAST((SELECT count(*) FROM s WHERE n >= 5) = 0 AS INTEGER) AS nothing_to_say FROM ev""",
    "audit_subjects": f"{USERS}\nSELECT subject AS type, count(*) AS instances, count(DISTINCT interaction) AS contacts, CAST(count(*) >= 5 AS INTEGER) AS enough FROM inst GROUP BY subject",
    "audit_outcomes": f"{USERS},\nl AS (SELECT interaction, operator, max_by(type, seq) AS t FROM ev GROUP BY ALL)\nSELECT operator, CASE WHEN t = 'system:error' THEN 'escalated' ELSE 'resolved' END AS outcome, count(*) AS interactions FROM l GROUP BY ALL",
    "sessionize_events": f"{USERS}\nSELECT interaction, episode, count(*) AS events, min(seq) AS first_seq, max(seq) AS last_seq FROM ev GROUP BY ALL",
    "guard_stats_episode": guard_stats("episode"),
    "guard_stats_contact": guard_stats("interaction"),
    "precedence_episode": support("episode"),
    "precedence_contact": support("interaction"),
    "at_most_one": per_episode("i.subject", "<= 1", ",\npairs(subject) AS (VALUES ('action:RF'), ('action:AF'))"),
    "exactly_one_per": per_episode("p.guard", "= 1", PAIRS),
    "same_slot_precedence": SAME_SLOT,
    "conditioned_precedence": CONDITIONED,
    "condition_vocabulary": VOCABULARY,
    "support_by_operator": support_at("operator"),
    "support_by_team": support_at("team"),
    "support_by_agent": support_at("agent"),
    "provenance_verdicts": VERDICTS,
    "rule_identity": IDENTITY,
    "contradictions": CYCLES,
    "subsumption_twin": TWINS,
    "subsumption_transitive": CHAINS,
    "vacuity_contact": VACUITY,
    "rule_statuses": STATUSES,
    "decision_points": f"{POINTS}\nSELECT operator, action, count(*) AS points, count(DISTINCT interaction) AS contacts FROM pt GROUP BY ALL",
    "recommend_depth1": DEPTH1,
    "recommend_depth2": DEPTH2,
    "recommend_cover": COVER,
    "withheld_actions": WITHHELD,
    "outcome_precision": f"{POINTS}\nSELECT operator, action, count(*) AS points, count(outcome) AS judged, count(*) FILTER (outcome = 'resolved') AS good FROM pt GROUP BY ALL",
    "lift_context": LIFT,
    "lift_by_stratum": STRATA,
    "clause_exercise": f"{EXERCISE}\nSELECT * FROM ex",
    "controls": CONTROLS,
    "alignment": ALIGNMENT,
    "policy_metrics": f"{METRICS}\nSELECT * FROM m",
    "gate": GATE,
    "diff_regions": DIFF,
    "gold_report": GOLD,
    "advise_replay": f"{SERVED}\nSELECT request, considering, verdict, why, warned, cleared, missing FROM w",
    "coverage_summary": f"{SERVED}\nSELECT operator, verdict, why, count(*) AS answers FROM w GROUP BY ALL",
    "missing_facts_topk": f"{SERVED}\nSELECT missing AS fact, count(*) AS requests FROM w WHERE missing <> '' GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 10",
    "replay_metrics": f"{SERVED}\nSELECT count(*) AS points, count(*) FILTER (verdict <> 'abstain') AS answered, count(*) FILTER (verdict = 'warn') AS warned, count(*) FILTER (verdict = 'clear') AS cleared, count(*) FILTER (hinted) AS recommended, count(*) FILTER (hinted AND considering = 'action:AF') AS agreed, count(*) FILTER (hinted AND considering = 'action:AF' AND outcome IS NOT NULL) AS judged, count(*) FILTER (hinted AND considering = 'action:AF' AND outcome = 'resolved') AS good FROM w",
    "three_valued": """
WITH t AS (SELECT o_orderstatus = 'F' AND CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority IN ('1-URGENT', '2-HIGH') END AS truth FROM orders)
SELECT coalesce(CAST(truth AS VARCHAR), 'unknown') AS truth, CASE WHEN truth IS NULL THEN 'priority' ELSE '' END AS unknown, count(*) AS orders FROM t GROUP BY ALL""",
    "observation_sites": f"""{PROSE}
SELECT 'p-data' AS pred, count(*) AS sites, count(DISTINCT t) AS texts, CAST(sum(length(t)) AS BIGINT) AS characters FROM clean WHERE length(trim(t)) > 0
UNION ALL SELECT 'p-long', count(*), count(DISTINCT t), CAST(sum(length(t)) AS BIGINT) FROM long_ WHERE length(trim(t)) > 0""",
    "distinct_text_calls": f"{PROSE}\nSELECT substr(sha256(t), 1, 16) AS sha, count(*) AS sites FROM answers GROUP BY t",
    "band_emission": f"{PROSE}\nSELECT coalesce({VALUE}, 'withheld') AS value, CAST(p AS DOUBLE) AS p, count(*) AS lines FROM answers GROUP BY ALL",
    "asof_observation": f"""{PROSE},
s AS (SELECT *, {VALUE} AS v FROM answers)
SELECT interaction, episode, seq, coalesce((SELECT max_by(e.v, e.seq) FROM s e WHERE e.episode = s.episode AND e.seq < s.seq AND e.v IS NOT NULL), 'unknown') AS value FROM s""",
    "redaction_preview": r"""
WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<email>', 'g'), '\+?\d[\d ()-]{7,}\d', '<phone>', 'g'), '\d{4,}', '<digits>', 'g') AS t FROM documents)
SELECT doc_id, CAST(length(t) AS INTEGER) AS length, CAST(length(regexp_replace(t, '<(email|phone|digits)>', '', 'g')) AS INTEGER) AS plain FROM c""",
    "lifecycle_merge": LIFECYCLE,
    "review_pace": """
WITH g AS (SELECT 'user-' || (user_id % 20) AS reviewer, date_part('epoch', ts) - date_part('epoch', lag(ts) OVER (PARTITION BY user_id % 20 ORDER BY ts)) AS gap FROM events)
SELECT reviewer, count(*) AS gaps, round(median(trunc(gap)), 3) AS median_seconds FROM g WHERE trunc(gap) > 0 AND trunc(gap) <= 6000 GROUP BY ALL""",
    "spread_sample": """
WITH p AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS place, count(*) OVER (PARTITION BY o_orderpriority) AS size FROM orders)
SELECT o_orderkey, o_orderpriority FROM p WHERE size <= 12 OR list_contains([CAST(floor(k * (size - 1) / 11 + 0.5) AS BIGINT) FOR k IN range(12)], place)""",
    "hash_sample": "SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer ORDER BY substr(sha256('s1' || chr(0) || CAST(c_custkey AS VARCHAR)), 1, 16), key LIMIT 50",
    "threshold_sweep": f"""
WITH g AS ({guard_stats('episode')}),
t(min_instances, support) AS (SELECT CAST(a AS INTEGER), CAST(b AS DOUBLE) FROM (VALUES (5), (30), (100)) x(a), (VALUES (0.3), (0.5), (0.7)) y(b))
SELECT min_instances, support, count(*) AS candidates, CAST(sum(n) AS BIGINT) AS kept FROM t JOIN g ON g.instances >= min_instances AND n / instances >= support GROUP BY ALL""",
    "timeline_runs": f"""{PROSE},
k AS (SELECT interaction, seq, role, CASE role WHEN 'user' THEN 'customer_utterance' WHEN 'assistant' THEN 'agent_utterance' WHEN 'system' THEN 'system' ELSE 'unknown' END AS kind FROM said),
n AS (SELECT *, CASE WHEN lag(kind) OVER w IS DISTINCT FROM kind THEN 1 ELSE 0 END AS new FROM k WINDOW w AS (PARTITION BY interaction ORDER BY seq, kind)),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY interaction ORDER BY seq, kind) AS BIGINT) AS run FROM n)
SELECT interaction, run, kind, count(*) AS turns FROM r GROUP BY ALL""",
}
