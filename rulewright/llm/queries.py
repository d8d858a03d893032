"""The queries of this subpackage for __spark_entry__.py, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_products

    return top_products(table(spark, sf_dir, "embeddings"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed_documents

    return packed_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import without_repeats

    found = without_repeats(table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, train
    from .sampling import remainder

    docs, part = table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 3)
    found = identify(docs, train(docs.where(part != 1)))
    return found.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sstable import read_shards, write_shards

    folder = write_shards(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return read_shards(spark, folder).drop("shard")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sampling import remainder
    from .toxicity import score, train

    docs, labels, part = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5)
    found = score(docs, train(docs, labels.where(part != 0)))
    predicted = (F.col("score") >= 0.5).cast("int")
    return found.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "score", predicted.alias("predicted"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judged

    found = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dialogue import conversation_reports

    return conversation_reports(table(spark, sf_dir, "conversations"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    coalesce(1 + length(translate(text, '0123456789!"#$%&()*+/:;<=>?@[\]^_`{|}~', '')) / nullif(length(text), 0), 1.0) AS quality,
    (CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS stop, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (
  SELECT *, (SELECT sum(source_size) FROM s) - coalesce(sum(stop) OVER (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heft FROM w),
f AS (SELECT *, stop * heft < rest * weight AS over_ FROM o),
level AS (SELECT CAST(max_by(rest, heft) AS DOUBLE) AS rest, CAST(max(heft) AS DOUBLE) AS heft FROM f WHERE NOT over_),
t AS (SELECT f.source, f.source_size, CASE WHEN over_ THEN CAST(stop AS DOUBLE) ELSE weight * level.rest / level.heft END AS target FROM f LEFT JOIN level ON TRUE),
k AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(u) / quality, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size > 0 THEN size * least(epochs + CASE WHEN before + size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END, 3) ELSE 0 END AS BIGINT) AS taken FROM k
"""

OP7_SQL = r"""
WITH words AS (
  SELECT doc_id, [w FOR w IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF w <> ''] AS ws FROM documents),
windows AS (
  SELECT doc_id, p, array_to_string(list_slice(ws, p, p + 34), ' ') AS win
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS p FROM words WHERE len(ws) >= 35)),
again AS (SELECT win FROM windows GROUP BY win HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, p + k AS i FROM windows JOIN again USING (win), (SELECT unnest(generate_series(0, 34)) AS k)),
placed AS (
  SELECT doc_id, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS i FROM words WHERE len(ws) > 0),
kept AS (
  SELECT p.doc_id, count(*) AS n, count(*) FILTER (g.i IS NOT NULL) AS gone, coalesce(string_agg(w, ' ' ORDER BY p.i) FILTER (g.i IS NULL), '') AS text
  FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""

#: The 256 entries of CRC-32's table follow from its polynomial.
CRC_SQL = """crc AS MATERIALIZED (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(CAST(b AS BIGINT), [CAST(k AS BIGINT) FOR k IN range(8)]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS b))),"""

OP11_SQL = (
    "WITH "
    + CRC_SQL
    + r"""
texts AS MATERIALIZED (
  SELECT row_number() OVER () AS r, d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT TRUE AS d, doc_id, text FROM documents UNION ALL SELECT FALSE, item_id, text FROM benchmark)),
placed AS (
  SELECT r, d, w AS w1, lead(w, 1) OVER (PARTITION BY r ORDER BY i) AS w2, lead(w, 2) OVER (PARTITION BY r ORDER BY i) AS w3
  FROM (SELECT r, d, unnest(w) AS w, unnest(range(len(w))) AS i FROM texts)),
grams AS MATERIALIZED (
  SELECT r, d, w1 AS g, count(*) AS n FROM placed GROUP BY ALL
  UNION ALL SELECT r, d, w1 || ' ' || w2, count(*) FROM placed WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT r, d, w1 || ' ' || w2 || ' ' || w3, count(*) FROM placed WHERE w3 IS NOT NULL GROUP BY ALL),
buckets AS MATERIALIZED (
  SELECT g, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT) FOR k IN range(length(h) // 2)]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b
  FROM (SELECT DISTINCT g, hex(g) AS h FROM grams), crc),
counts AS (SELECT b, sum(n) FILTER (d) AS s, sum(n) FILTER (NOT d) AS t FROM grams JOIN buckets USING (g) GROUP BY b),
totals AS (SELECT CAST(sum(s) AS DOUBLE) AS ss, CAST(coalesce(sum(t), 0) AS DOUBLE) AS tt FROM counts),
gains AS (
  SELECT b, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (ss + 10000) / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * (tt + 10000)))) AS BIGINT) AS gain FROM counts, totals),
weights AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM grams JOIN buckets USING (g) JOIN gains USING (b) WHERE d GROUP BY r),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS able,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM texts LEFT JOIN weights USING (r) WHERE d),
ranked AS (SELECT *, row_number() OVER (ORDER BY able DESC, score DESC, doc_id NULLS LAST, n_features) AS rank, 5 * sum(able::INT) OVER () // 100 AS most FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND rank <= most THEN rank END AS rank FROM ranked
"""
)

OP12_SQL = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
trusted AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1),
placed AS (SELECT r, unnest(w) AS w, unnest(range(len(w))) AS i FROM docs),
windows AS MATERIALIZED (
  SELECT r, i, win FROM (
    SELECT r, i, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p || ' ' || lead(w, 3) OVER p || ' ' || lead(w, 4) OVER p AS win
    FROM placed WINDOW p AS (PARTITION BY r ORDER BY i)) WHERE win IS NOT NULL),
again AS (SELECT r, win FROM windows GROUP BY r, win HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM windows JOIN again USING (r, win), (SELECT unnest(range(5)) AS k) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
chars AS (SELECT r, doc_id, unnest(c) AS c, unnest(range(len(c))) AS i FROM (SELECT r, doc_id, regexp_extract_all(text, '(?s).') AS c FROM docs)),
grams AS (SELECT r, doc_id, c || lead(c, 1) OVER p || lead(c, 2) OVER p AS g FROM chars WINDOW p AS (PARTITION BY r ORDER BY i)),
counted AS MATERIALIZED (SELECT r, doc_id, g, count(*) AS n FROM grams WHERE g IS NOT NULL GROUP BY ALL),
buckets AS (
  SELECT g, (unicode(g) * 1000006000009 + unicode(substr(g, 2, 1)) * 1000003 + unicode(substr(g, 3, 1))) % 65521 AS b FROM (SELECT DISTINCT g FROM counted)),
counts AS (
  SELECT b, CAST(sum(n) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (doc_id IN (SELECT doc_id FROM trusted)), 0) AS DOUBLE) AS t FROM counted JOIN buckets USING (g) GROUP BY b),
totals AS (SELECT sum(s) AS ss, sum(t) AS tt FROM counts),
gains AS (SELECT b, CASE WHEN tt > 0 THEN CAST(floor(1000000 * ln((t + 1) * (ss + 65521) / ((s + 1) * (tt + 65521)))) AS BIGINT) ELSE 0 END AS gain FROM counts, totals),
scores AS (SELECT r, sum(n * gain) AS gain, sum(n) AS n FROM counted JOIN buckets USING (g) JOIN gains USING (b) GROUP BY r),
found AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, coalesce(gain, 0) >= -50000 * coalesce(scores.n, 0) AS good
  FROM docs LEFT JOIN dups USING (r) LEFT JOIN covered USING (r) LEFT JOIN scores USING (r))
SELECT * EXCLUDE (good), n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, good AND NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS kept FROM found
"""

#: States are 1 to 4 here: nothing yet, after a system turn, after a user's, after an assistant's.
OP13_SQL = (
    "WITH RECURSIVE "
    + CRC_SQL
    + r"""
kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT) FOR k IN range(length(h) // 2)]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM (SELECT *, hex(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS h FROM conversations), crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM kinds WHERE kind <> 0)),
ordered AS MATERIALIZED (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM damaged),
faults AS MATERIALIZED (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '-' END AS initial,
    lag(CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '-' END) OVER (PARTITION BY c ORDER BY i) AS earlier
  FROM ordered),
back AS (
  SELECT DISTINCT c, n + 1 AS i, [0, 6, 3, 0] AS v FROM faults
  UNION ALL
  SELECT c, i, [least(w[1], 3 + w[3], 6 + w[4]), least(w[2], 3 + w[3], 6 + w[4]), least(w[3], 3 + w[4]), least(w[4], 3 + w[3])] FROM (
    SELECT f.c, f.i, [least(4 + v[s], CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 ELSE CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END + least(3 + v[CASE WHEN s = 3 THEN 4 ELSE 3 END],
        CASE WHEN initial = 's' AND s = 1 THEN v[2] WHEN initial = 'u' AND s <> 3 THEN v[3] WHEN initial = 'a' AND s = 3 THEN v[4] ELSE 1000000000 END) END) FOR s IN [1, 2, 3, 4]] AS w
    FROM back b JOIN faults f ON f.c = b.c AND f.i = b.i - 1)),
steps AS MATERIALIZED (
  SELECT b.c, b.i, b.v, coalesce(a.v, [0, 0, 0, 0]) AS after, fault, initial, role, text, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS pen
  FROM back b LEFT JOIN back a ON a.c = b.c AND a.i = b.i + 1 LEFT JOIN faults f ON f.c = b.c AND f.i = b.i),
walk AS (
  SELECT c, CAST(1 AS BIGINT) AS i, 1 AS s, '' AS audit, CAST([] AS VARCHAR[]) AS lines, CAST(0 AS BIGINT) AS cost FROM (SELECT DISTINCT c FROM faults)
  UNION ALL
  SELECT c, i + CASE WHEN e = 'I' THEN 0 ELSE 1 END, CASE WHEN e = 'D' THEN s WHEN e = 'K' AND initial = 's' THEN 2 WHEN s = 3 THEN 4 ELSE 3 END, audit || e,
    CASE WHEN e = 'D' THEN lines ELSE list_append(lines, CASE WHEN e = 'K' THEN role WHEN s = 3 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END) END,
    cost + CASE e WHEN 'D' THEN 4 WHEN 'I' THEN 3 WHEN 'K' THEN pen ELSE 3 + pen END
  FROM (
    SELECT w.*, d.initial, d.role, d.text, d.pen,
      CASE WHEN d.fault IS NOT NULL AND 4 + after[s] = v[s] THEN 'D' WHEN 3 + v[CASE WHEN s = 3 THEN 4 ELSE 3 END] = v[s] THEN 'I'
        WHEN pen + CASE WHEN initial = 's' AND s = 1 THEN after[2] WHEN initial = 'u' AND s <> 3 THEN after[3] WHEN initial = 'a' AND s = 3 THEN after[4] ELSE 1000000000 END = v[s] THEN 'K' ELSE 'R' END AS e
    FROM walk w JOIN steps d ON d.c = w.c AND d.i = w.i WHERE d.fault IS NOT NULL OR s IN (2, 3))),
ended AS (SELECT c, max_by(audit, length(audit)) AS audit, max_by(lines, length(audit)) AS lines, max_by(cost, length(audit)) AS cost FROM walk GROUP BY c),
sums AS (
  SELECT c, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY c)
SELECT k.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN (sums JOIN ended USING (c)) x ON x.conv_id IS NOT DISTINCT FROM k.conv_id
"""
)

SQL = {"op13_conversation_repair": OP13_SQL, "op12_quality_rules": OP12_SQL, "op11_importance_resampling": OP11_SQL, "op3_exact_top_k": OP3_SQL, "op5_mixing": OP5_SQL, "op7_substring_dedup": OP7_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
