"""One query ``opN_<name>`` for each operator, over its whole table, and DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronark.llm import _runtime, decontaminate, exact_dedup, filter_audit, hard_negatives, jaccard, language_id, line_dedup, mixing, pii, repeated_bytes, secrets, sharding, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(_runtime.crc_mod(F.col("doc_id"), 4) != 2))
    out = toxicity.score(docs, model)
    held_out = _runtime.crc_mod(F.col("doc_id"), 4) == 2
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(_table(spark, sf_dir, "documents"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, secrets.KINDS), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), key="op7")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.flag_copies(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "contaminated", "n_items", F.col("hits.item_id").alias("item_ids"), F.array_min("hits.distance").alias("distance"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = _runtime.crc_mod(F.col("doc_id"), 3) == 1
    model = language_id.train(docs.where(~held_out))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits", "accepted")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_bytes.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_ngram_jaccard, op3_sharding, op4_line_dedup, op5_toxicity,
        op6_secrets, op7_pii, op8_exact_dedup, op9_decontamination, op10_language_id,
        op11_hard_negatives, op12_filter_audit, op13_repeated_bytes,
    )
}

ORACLE_SQL = {
    "op2_ngram_jaccard": r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS shingle
  FROM words),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
least AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.x = d.doc_id
""",
    "op8_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
    "op11_hard_negatives": """
WITH used AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM used a JOIN used b ON a.vec_id % 50 = 0 AND b.vec_id IS DISTINCT FROM a.vec_id),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other NULLS LAST) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, n.other AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
WINDOW best AS (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.other NULLS LAST)
QUALIFY row_number() OVER best <= 3
""",
    "op12_filter_audit": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS copy
  FROM documents),
marked AS MATERIALIZED (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, list_concat(
    CASE WHEN len(w) < 200 THEN ['A'] ELSE [] END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN ['B'] ELSE [] END,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN ['C'] ELSE [] END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN ['D'] ELSE [] END, CASE WHEN copy THEN ['E'] ELSE [] END) AS fails
  FROM words LEFT JOIN (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id) USING (doc_id)),
counted AS MATERIALIZED (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM marked GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT f AS filter_order FROM letters
  UNION ALL SELECT filter_order || f FROM orders JOIN letters ON NOT contains(filter_order, f)),
steps AS (
  SELECT filter_order, CAST(s AS INTEGER) AS step, filter_order[s] AS f, string_split(filter_order[1:s - 1], '') AS earlier
  FROM orders, range(1, 6) r(s) WHERE length(filter_order) = 5),
removed AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (NOT list_has_any(fails, earlier) AND NOT list_contains(fails, f)), 0) AS kept,
    coalesce(sum(n) FILTER (NOT list_has_any(fails, earlier) AND list_contains(fails, f)), 0) AS removed,
    coalesce(sum(n) FILTER (list_has_any(fails, earlier) AND list_contains(fails, f)), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = [f]), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT list_has_any(fails, earlier) AND list_contains(fails, f)), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (NOT list_has_any(fails, earlier) AND list_contains(fails, f)), 0) AS toxic_lost
  FROM counted, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM removed
""",
    "op13_repeated_bytes": """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
starts AS (SELECT doc_id, unnest(range(CAST(length(x) / 2 AS BIGINT) - 99)) AS s, x FROM texts WHERE length(x) >= 200),
windows AS (SELECT doc_id, s, substr(x, 2 * s + 1, 200) AS w FROM starts),
late AS MATERIALIZED (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS k FROM windows) WHERE k > 1),
gaps AS (SELECT doc_id, s, s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS gap FROM late),
numbered AS (SELECT doc_id, s, sum(CASE WHEN gap IS NULL OR gap > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM gaps),
spans AS (SELECT doc_id, run, min(s) AS a, max(s) + 100 AS b FROM numbered GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next FROM spans),
kept AS (
  SELECT doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)) || CASE WHEN next IS NULL THEN substr(x, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS k,
    count(*) AS n, sum(b - a) AS removed
  FROM pieces JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(x) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
""",
}
