"""Queries over texts, news, macro vintages, the call ledger, decoders, progress, learning and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronark.functions import text
from chronark.operators import bars as B
from chronark.operators import graph, learning, ledger, macro, news, progress, similarity
from chronark.plans import adapters as A
from chronark.plans.registry import query
from chronark.sources import decode
from chronark.streaming import streams

# The SQL has its own copies of all word lists, so that a slip in the library's shows.
_STOP = """'the', 'and', 'for', 'with', 'from', 'that', 'this', 'their', 'there', 'into', 'over', 'after', 'before', 'once', 'again', 'since', 'than', 'then',
'was', 'were', 'are', 'has', 'have', 'had', 'its', 'his', 'her', 'will', 'not', 'but', 'all', 'any', 'new', 'now', 'out', 'off', 'own', 'per', 'says', 'said', 'say',
'amid', 'also', 'more', 'most', 'some', 'such', 'who', 'why', 'how', 'what', 'when', 'where', 'which', 'while', 'you'"""
_PARAMETERS = "['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'utm_id', 'fbclid', 'gclid', 'msclkid', 'mc_cid', 'mc_eid', 'ref', 'source', 'cmpid', 's_cid']"
_NORMAL = r"trim(regexp_replace(lower(strip_accents({c})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_STEM = (
    "CASE WHEN w LIKE '%ies' AND length(w) >= 7 THEN concat(left(w, -3), 'y') WHEN w LIKE '%ing' AND length(w) >= 7 THEN left(w, -3) "
    "WHEN w LIKE '%ed' AND length(w) >= 6 THEN left(w, -2) WHEN w LIKE '%es' AND length(w) >= 6 THEN left(w, -2) WHEN w LIKE '%s' AND length(w) >= 5 THEN left(w, -1) ELSE w END"
)
_FIRST = "regexp_extract(text, '^[^.\\n]*')"


def _tokens(compared: str) -> str:
    return f"""
t AS (SELECT doc_id AS seq, {_FIRST} AS title, coalesce({_NORMAL.format(c=compared)}, '') AS normalized FROM documents),
k AS (SELECT DISTINCT seq, {_STEM} AS token FROM (SELECT seq, unnest(string_split(normalized, ' ')) AS w FROM t) WHERE length(w) >= 3 AND w NOT IN ({_STOP})),
s AS (SELECT seq, list(token ORDER BY token) AS tokens FROM k GROUP BY seq)"""


_TOKENS, _HEADLINES = _tokens("text"), _tokens(_FIRST)


@query(f"WITH {_TOKENS} SELECT t.seq, normalized, coalesce(array_to_string(tokens, ' '), '') AS tokens FROM t LEFT JOIN s USING (seq)")
def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.news(spark, sf_dir).select("seq", "normalized", F.array_join(F.sort_array("tokens"), " ").alias("tokens"))


@query(r"SELECT doc_id AS seq, sha256(trim(regexp_replace(lower(strip_accents(concat_ws(' ', regexp_extract(text, '^[^.\n]*'), coalesce(text, '')))), '[^\p{L}\p{N}]+', ' ', 'g'))) AS content FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.news(spark, sf_dir).select("seq", text.content_hash(F.col("title"), F.col("body")).alias("content"))


@query(rf"""WITH u AS (SELECT page_id, 0 AS form, trim(url) AS u FROM pages UNION ALL SELECT page_id, 1, concat('HTTPS://WWW.X', page_id, '.com:8080/') FROM pages
  UNION ALL SELECT page_id, 2, concat('x', page_id, '.org/a%20b/?msclkid=1&s_cid=2&z=%41&igshid=3&b=+') FROM pages UNION ALL SELECT page_id, 3, concat('https://x.com', CASE WHEN page_id % 2 = 0 THEN '/p/' ELSE '' END, '?ref=a&ref_src=', page_id, '#frag') FROM pages),
f AS (SELECT *, regexp_extract(u, '^([A-Za-z]+)://', 1) AS s, regexp_extract(u, '^(?:[A-Za-z]+://([^/?#:]+)(?::[0-9]+)?)?([^?#]*)', 1) AS h, regexp_extract(u, '^(?:[A-Za-z]+://[^/?#]+)?([^?#]*)', 1) AS path, url_decode(replace(regexp_extract(u, '\?([^#]*)', 1), '+', '%2B')) AS q FROM u),
c AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: trim(x) <> '' AND NOT list_contains({_PARAMETERS}, lower(split_part(x, '=', 1))))) AS kept FROM f)
SELECT page_id, form, concat(CASE s WHEN '' THEN 'https' ELSE lower(s) END, '://', regexp_replace(lower(h), '^www\.', ''), url_decode(CASE WHEN length(path) > 1 THEN rtrim(path, '/') ELSE path END), CASE WHEN len(kept) > 0 THEN concat('?', array_to_string(kept, '&')) ELSE '' END) AS url FROM c""")
def canonicalize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's address, and three made from its id: a root path with a port, one without a scheme but with escapes, one with a fragment."""
    p, n = A.table(spark, sf_dir, "pages"), F.col("page_id").cast("string")
    forms = F.array(
        F.col("url"), F.concat(F.lit("HTTPS://WWW.X"), n, F.lit(".com:8080/")), F.concat(F.lit("x"), n, F.lit(".org/a%20b/?msclkid=1&s_cid=2&z=%41&igshid=3&b=+")),
        F.concat(F.lit("https://x.com"), F.when(F.col("page_id") % 2 == 0, "/p/").otherwise(""), F.lit("?ref=a&ref_src="), n, F.lit("#frag")),
    )
    return p.select("page_id", F.posexplode(forms).alias("form", "url")).select("page_id", "form", text.canonical_url(F.col("url")).alias("url"))


@query("SELECT min(doc_id) AS seq, source AS feed_id FROM documents GROUP BY source, doc_id % 700")
def dedup_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.dedup_url(A.news(spark, sf_dir)).select("seq", "feed_id")


@query(r"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id AS seq, sha256(trim(regexp_replace(lower(strip_accents(concat_ws(' ', regexp_extract(text, '^[^.\n]*'), coalesce(text, '')))), '[^\p{L}\p{N}]+', ' ', 'g'))) AS content FROM documents),
r AS (SELECT content, min(seq) AS seq FROM d GROUP BY content UNION ALL SELECT content, next FROM (SELECT content, (SELECT min(x.seq) FROM d x WHERE x.content = r.content AND x.seq > r.seq + 600) AS next FROM r) WHERE next IS NOT NULL)
SELECT seq, content FROM r""")
def dedup_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hours' window, so that later copies come back."""
    return news.dedup_content(A.news(spark, sf_dir).select("seq", "title", "body", "published_at"), hours=10).select("seq", "content")


@query(f"""WITH {_TOKENS}, f AS (SELECT token, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(0, CAST(length(hex(encode(token))) // 2 AS BIGINT)), lambda i: CAST(concat('0x', substr(hex(encode(token)), 2 * i + 1, 2)) AS UHUGEINT))),
  lambda h, c: (xor(h, c) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS h FROM (SELECT DISTINCT token FROM k)),
b AS (SELECT token, unnest(range(0, 64)) AS j, h FROM f), v AS (SELECT seq, j, sum(CASE WHEN (h >> CAST(j AS UHUGEINT)) % 2 = 1 THEN 1 ELSE -1 END) AS votes FROM k JOIN b USING (token) GROUP BY 1, 2),
s2 AS (SELECT seq, sum(CASE WHEN votes > 0 THEN CAST(power(2, j) AS HUGEINT) ELSE 0 END) AS bits, count(*) FILTER (WHERE votes > 0) AS ones FROM v GROUP BY 1)
SELECT t.seq, CAST(CASE WHEN coalesce(bits, 0) >= 9223372036854775808 THEN bits - 18446744073709551616 ELSE coalesce(bits, 0) END AS BIGINT) AS simhash, coalesce(ones, 0) AS ones FROM t LEFT JOIN s2 USING (seq)""")
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.news(spark, sf_dir)
    h = n.select("seq", text.simhash64("tokens").alias("simhash"))
    return h.select("seq", "simhash", text.hamming(F.col("simhash"), F.lit(0).cast("long")).alias("ones"))


@query(f"""WITH {_HEADLINES}, n AS (SELECT seq, len(tokens) AS n FROM s), c AS (SELECT a.seq AS a, b.seq AS b, count(*) AS c FROM k a JOIN k b ON a.token = b.token AND a.seq < b.seq GROUP BY 1, 2)
SELECT a, b, round(c / (x.n + y.n - c), 6) AS similarity FROM c JOIN n x ON x.seq = a JOIN n y ON y.seq = b WHERE c / (x.n + y.n - c) >= 0.45""")
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similarity.similar_pairs(A.headlines(spark, sf_dir).select("seq", "tokens"))
    return out.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_TOKENS}, n AS (SELECT seq, len(tokens) AS n FROM s), c AS (SELECT a.seq AS a, b.seq AS b, count(*) AS c FROM k a JOIN k b ON a.token = b.token AND b.seq < a.seq AND a.seq - b.seq <= 600 GROUP BY 1, 2)
SELECT a, b, round(c / (x.n + y.n - c), 6) AS similarity FROM c JOIN n x ON x.seq = a JOIN n y ON y.seq = b WHERE c / (x.n + y.n - c) >= 0.45""")
def recent_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline and summary of each item against those of ten hours: a minute lies between two items."""
    out = similarity.recent_pairs(A.news(spark, sf_dir).select("seq", "tokens", "published_at"), hours=10)
    return out.select("a", "b", F.round("similarity", 6).alias("similarity"))


def _clusters(first_stage: str) -> str:
    """SQL that walks headlines in order: (n, seq, leader). ``first_stage`` names the rows (seq) that reach the clusters."""
    return f"""np AS (SELECT seq, len(tokens) AS n FROM s), cp AS (SELECT a.seq AS a, b.seq AS b, count(*) AS c FROM k a JOIN k b ON a.token = b.token AND a.seq < b.seq GROUP BY 1, 2),
near AS (SELECT b AS seq, list(a ORDER BY a) AS keys, list(c / (x.n + y.n - c) ORDER BY a) AS sims FROM cp JOIN np x ON x.seq = a JOIN np y ON y.seq = b WHERE c / (x.n + y.n - c) >= 0.45 GROUP BY b),
walk AS MATERIALIZED (SELECT seq, 1767225600 + seq * 60 AS at_s, coalesce(keys, []) AS keys, coalesce(sims, []) AS sims, row_number() OVER (ORDER BY seq) AS n FROM {first_stage} LEFT JOIN near USING (seq)),
r AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS leader, CAST([] AS STRUCT(k BIGINT, l BIGINT)[]) AS leaders
  UNION ALL
  SELECT n, seq, coalesce(best.k, seq), CASE WHEN best IS NULL THEN list_append(leaders, CAST({{'k': seq, 'l': at_s}} AS STRUCT(k BIGINT, l BIGINT)))
    ELSE list_transform(leaders, lambda x: CASE WHEN x.k = best.k THEN CAST({{'k': x.k, 'l': greatest(x.l, at_s)}} AS STRUCT(k BIGINT, l BIGINT)) ELSE x END) END
  FROM (SELECT *, list_sort(list_transform(list_filter(leaders, lambda x: x.l >= at_s - 72 * 3600 AND list_contains(keys, x.k)), lambda x: {{'s': sims[list_position(keys, x.k)], 'l': x.l, 'm': -x.k, 'k': x.k}}), 'DESC')[1] AS best
    FROM (SELECT walk.n, walk.seq, at_s, keys, sims, leaders FROM r JOIN walk ON walk.n = r.n + 1)))"""


_COUNTED = "SELECT leader AS cluster_seq, count(*) AS source_count, min(1767225600 + r.seq * 60) AS first_at, max(1767225600 + r.seq * 60) AS last_at, arg_min(title, r.seq) AS title FROM r JOIN t ON t.seq = r.seq GROUP BY 1"


@query(f"WITH RECURSIVE {_HEADLINES}, {_clusters('t')} {_COUNTED}")
def cluster_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.headlines(spark, sf_dir)
    return news.cluster_counters(n, news.cluster(n)).withColumn("first_at", F.unix_seconds("first_at")).withColumn("last_at", F.unix_seconds("last_at"))


_KEPT = r"""u AS (SELECT doc_id AS seq FROM documents QUALIFY row_number() OVER (PARTITION BY source, doc_id % 700 ORDER BY doc_id) = 1),
h AS MATERIALIZED (SELECT doc_id AS seq, sha256(trim(regexp_replace(lower(strip_accents(concat_ws(' ', regexp_extract(text, '^[^.\n]*'), coalesce(text, '')))), '[^\p{L}\p{N}]+', ' ', 'g'))) AS content FROM documents JOIN u ON seq = doc_id),
q AS (SELECT content, min(seq) AS seq FROM h GROUP BY content UNION ALL SELECT content, next FROM (SELECT content, (SELECT min(x.seq) FROM h x WHERE x.content = q.content AND x.seq > q.seq + 4320) AS next FROM q) WHERE next IS NOT NULL)"""


@query(f"""WITH RECURSIVE {_HEADLINES}, {_KEPT}, {_clusters('q')}
SELECT 'NEW_CLUSTER' AS outcome, count(*) FILTER (WHERE seq = leader) AS n FROM r UNION ALL SELECT 'JOINED', count(*) FILTER (WHERE seq <> leader) FROM r
UNION ALL SELECT 'DUPLICATE', (SELECT count(*) FROM documents) - (SELECT count(*) FROM q) UNION ALL SELECT 'FETCHED', count(*) FROM documents UNION ALL SELECT 'FAILED_FEED', 0""")
def ingest_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an ingest of all news did: duplicates by address, then by content, then clusters of the rest; no feed failed."""
    n = A.headlines(spark, sf_dir)
    return news.ingest_counts(n, n.select("feed_id", F.lit(True).alias("ok")).distinct())


_HITS = """len(list_intersect(tokens, ['sec', 'regulator', 'lawsuit', 'court', 'ban', 'approval', 'compliance', 'legislation'])) AS reg,
len(list_intersect(tokens, ['fed', 'inflation', 'cpi', 'rate', 'fomc', 'gdp', 'unemployment', 'treasury', 'yield'])) AS mac,
len(list_intersect(tokens, ['hack', 'exploit', 'breach', 'stolen', 'vulnerability', 'attack'])) AS inc, len(list_intersect(tokens, ['listing', 'listed', 'delist', 'trading pair'])) AS lis,
len(list_intersect(tokens, ['upgrade', 'fork', 'mainnet', 'testnet', 'halving', 'merge'])) AS pro, len(list_intersect(tokens, ['raise', 'funding', 'series', 'investment', 'valuation'])) AS fun,
len(list_intersect(tokens, ['partnership', 'partners', 'collaboration', 'integration'])) AS par,
len(list_intersect(tokens, ['surge', 'rally', 'gain', 'approval', 'approved', 'record', 'growth', 'adoption', 'bullish', 'upgrade', 'partnership', 'inflow'])) AS p,
len(list_intersect(tokens, ['crash', 'plunge', 'hack', 'exploit', 'ban', 'lawsuit', 'rejected', 'delay', 'delayed', 'bearish', 'outflow', 'liquidation', 'fraud'])) AS n,
len(list_intersect(tokens, ['could', 'might', 'rumor', 'rumour', 'reportedly', 'speculation', 'may', 'expected'])) > 0 AS speculation"""


#: Words put before a document's text, by its id, so that all types, tones and ties occur.
_PUT = ("sec", "cpi", "hacks", "delist", "forks merge", "raised valuation", "partnership", "rumor surge", "ban fomc treasury", "crashed", "")


@query(f"""WITH {_tokens("concat((['" + "', '".join(_PUT) + "'])[doc_id % 11 + 1], '. ', coalesce(text, ''))")}, a AS (SELECT t.seq, coalesce(tokens, []) AS tokens FROM t LEFT JOIN s USING (seq)), h AS (SELECT seq, {_HITS} FROM a),
e AS (SELECT *, greatest(reg, mac, inc, lis, pro, fun, par) AS most, CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0.0 END AS sentiment FROM h),
y AS (SELECT *, CASE WHEN most = 0 THEN 'OTHER' WHEN reg = most THEN 'REGULATORY' WHEN mac = most THEN 'MACRO' WHEN inc = most THEN 'SECURITY_INCIDENT' WHEN lis = most THEN 'LISTING' WHEN pro = most THEN 'PROTOCOL' WHEN fun = most THEN 'FUNDING' ELSE 'PARTNERSHIP' END AS event_type FROM e)
SELECT seq, event_type, round(sentiment, 6) AS sentiment, speculation, round(least(0.5, (CASE WHEN event_type IN ('REGULATORY', 'MACRO', 'SECURITY_INCIDENT') THEN 0.45 WHEN event_type IN ('PROTOCOL', 'LISTING') THEN 0.35
  WHEN event_type = 'OTHER' THEN 0.15 ELSE 0.25 END + 0.1 * abs(sentiment)) * CASE WHEN speculation THEN 0.6 ELSE 1 END)::DOUBLE, 6) AS materiality FROM y""")
def extract_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, some with words of an event or tone before them."""
    n = A.news(spark, sf_dir)
    put = F.element_at(F.array(*map(F.lit, _PUT)), (F.col("seq") % len(_PUT) + 1).cast("int"))
    n = n.withColumn("normalized", text.normalize(F.concat_ws(". ", put, F.coalesce("body", F.lit("")))))
    out = news.analyze(n.withColumn("tokens", text.tokens(F.col("normalized"))))
    return out.select("seq", "event_type", F.round("sentiment", 6).alias("sentiment"), "speculation", F.round("materiality", 6).alias("materiality"))


@query(f"WITH {_TOKENS} SELECT DISTINCT seq, e AS entity_id FROM t, (VALUES ('the', 'A'), ('of the', 'B'), ('de la', 'C'), ('und', 'D'), ('en', 'E')) d(k, e) WHERE contains(concat(' ', normalized, ' '), concat(' ', k, ' '))")
def link_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame([("the", "A"), ("of the", "B"), ("de la", "C"), ("und", "D"), ("en", "E")], "keyword string, entity_id string")
    return news.link_entities(A.news(spark, sf_dir), d)


@query(f"""WITH d AS (SELECT concat('NEWS:', doc_id) AS object_id, {_FIRST} AS title, text, doc_id, CAST(1767225600 + doc_id * 60 AS BIGINT) AS valid_from FROM documents),
a AS (SELECT object_id, valid_from, unnest([{{'p': 'title', 'v': title}}, {{'p': 'summary', 'v': substr(text, length(title) + 1)}}, {{'p': 'url', 'v': concat('https://www.Example.com/n/', doc_id % 700, '/?utm_source=x&b=2&a=1')}},
  {{'p': 'publishedAt', 'v': strftime(to_timestamp(valid_from) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')}}, {{'p': 'timeHorizon', 'v': 'DAYS'}}, {{'p': 'sourceCount', 'v': '1'}}]) AS x FROM d)
SELECT object_id, x.p AS property, sha256(x.v) AS value, valid_from FROM a WHERE x.v IS NOT NULL""")
def write_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six of an article's ten properties, as digests; the others are those of ``extract_news``."""
    out = news.article_assertions(news.analyze(A.news(spark, sf_dir))).where("property NOT IN ('eventType', 'sentiment', 'materiality', 'speculation')")
    return out.select("object_id", "property", F.sha2("value", 256).alias("value"), F.unix_seconds("valid_from").alias("valid_from"))


_VINTAGES = """
o AS (SELECT CAST(o_custkey AS VARCHAR) AS series, CAST(date_trunc('year', o_orderdate) AS DATE) AS period, CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,4)) END AS value, CAST(o_orderdate AS DATE) AS vintage_from,
  lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey, date_trunc('year', o_orderdate) ORDER BY o_orderdate, o_orderkey) AS vintage_to FROM orders),
v AS (SELECT *, row_number() OVER (PARTITION BY series, period ORDER BY vintage_from, coalesce(vintage_to - 1, DATE '9999-12-31')) > 1 AS is_revision FROM o WHERE value IS NOT NULL)"""


@query(f"WITH {_VINTAGES} SELECT series, CAST(period AS VARCHAR) AS period, CAST(value AS DOUBLE) AS value, CAST(vintage_from AS VARCHAR) AS vintage_from, CAST(vintage_to AS VARCHAR) AS vintage_to, is_revision FROM v")
def vintage_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = macro.vintage_ranges(A.observations(spark, sf_dir))
    return out.select("series", F.col("period").cast("string").alias("period"), F.col("value").cast("double").alias("value"), F.col("vintage_from").cast("string").alias("vintage_from"), F.col("vintage_to").cast("string").alias("vintage_to"), "is_revision")


@query(f"WITH {_VINTAGES} SELECT series, CAST(period AS VARCHAR) AS period, CAST(value AS DOUBLE) AS value FROM v WHERE vintage_from <= DATE '1998-06-01' AND (vintage_to IS NULL OR DATE '1998-06-01' < vintage_to)")
def macro_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = macro.known_at(macro.vintage_ranges(A.observations(spark, sf_dir)), F.lit("1998-06-01").cast("date"))
    return out.select("series", F.col("period").cast("string").alias("period"), F.col("value").cast("double").alias("value"))


@query(f"WITH {_VINTAGES} SELECT series, CAST(max(period) AS VARCHAR) AS cursor, 4 * count(*) AS assertions, count(DISTINCT period) AS links FROM v GROUP BY series")
def sync_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, c = macro.sync_series(A.observations(spark, sf_dir))
    n = a.groupBy(F.split("object_id", ":")[1].alias("series")).agg(F.count(F.lit(1)).alias("assertions"))
    links = macro.observation_links(macro.vintage_ranges(A.observations(spark, sf_dir))).groupBy(F.split("to_id", ":")[1].alias("series")).agg(F.count(F.lit(1)).alias("links"))
    return c.join(n, "series").join(links, "series").select("series", F.col("cursor").cast("string").alias("cursor"), "assertions", "links")


_CALLS = """
c AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS data FROM conversations),
i AS (SELECT concat(conv_id, '-', turn) AS call_id, TIMESTAMP '2026-01-01' + to_seconds(conv_id * 7200 + turn * 60) AS moment, concat('P', conv_id % 4) AS purpose, data, text, length(data) // 4 AS tin, length(coalesce(text, '')) // 4 AS tout FROM c WHERE role = 'assistant'),
l AS (SELECT *, ((tin - tin // 2) * 150 + (tin // 2) * 75 + tout * 600 + 5) // 10 AS units FROM i)"""


@query(f"WITH {_CALLS} SELECT call_id, sha256(concat('Answer. ', data)) AS prompt_sha256, CAST(length(data) + 8 AS BIGINT) AS prompt_chars, units / 1e8 AS cost, CAST(length(text) AS BIGINT) AS kept FROM l")
def normalise_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.normalise(A.calls(spark, sf_dir))
    return out.select("call_id", "prompt_sha256", F.col("prompt_chars").cast("long").alias("prompt_chars"), F.col("cost").cast("double").alias("cost"), F.length("response_raw").cast("long").alias("kept"))


@query(f"WITH {_CALLS} SELECT purpose, round(sum(units) / 1e8 + 1e-9, 6) AS spend, count(*) AS calls FROM l WHERE moment >= TIMESTAMP '2026-01-01' AND moment <= TIMESTAMP '2026-01-20' GROUP BY 1")
def spend_by_purpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.spend_by_purpose(ledger.normalise(A.calls(spark, sf_dir)), F.expr("timestamp '2026-01-20 00:00:00'"))
    return out.select("purpose", F.round(F.col("spend").cast("double") + 1e-9, 6).alias("spend"), "calls")


@query(f"""WITH {_CALLS}, s AS (SELECT call_id, coalesce(sum(units) OVER (PARTITION BY date_trunc('month', moment) ORDER BY moment, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM l)
SELECT call_id, b >= 200000 AS refused FROM s""")
def budget_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.budget_gate(ledger.normalise(A.calls(spark, sf_dir)), "0.002").select("call_id", "refused")


@query(f"""WITH RECURSIVE {_CALLS}, n AS MATERIALIZED (SELECT *, date_trunc('month', moment) AS month, row_number() OVER (PARTITION BY date_trunc('month', moment) ORDER BY moment, call_id) AS k FROM l),
r AS (SELECT month, k, call_id, false AS refused, units AS spent FROM n WHERE k = 1
  UNION ALL SELECT n.month, n.k, n.call_id, r.spent >= 200000, r.spent + CASE WHEN r.spent >= 200000 THEN 0 ELSE n.units END FROM r JOIN n ON n.month = r.month AND n.k = r.k + 1)
SELECT call_id, refused FROM r""")
def budget_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.replay_budget(ledger.normalise(A.calls(spark, sf_dir)), 0.002)


_FIELDS = [ledger.Field("k", "INTEGER", True, 0, 50), ledger.Field("kind", "ENUM", values=("CLICK", "VIEW")), ledger.Field("flag", "BOOLEAN"), ledger.Field("tags", "TEXT_LIST")]


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events")
    fraction = F.when(F.col("event_id") % 7 == 0, F.regexp_replace("props", r"(-?\d+)", "$1.3")).otherwise(F.col("props"))
    odd = F.when(F.col("event_id") % 10 == 3, F.regexp_replace("props", "}", ', "flag": "true", "tags": "one"}')).when(F.col("event_id") % 10 == 5, F.regexp_replace(fraction, "}", ', "tags": [" two ", "", "three", null, 4, {"x": 1}]}')).when(F.col("event_id") % 10 == 4, F.lit('{"kind": "view"}')).otherwise(F.regexp_replace("props", "}", F.concat(F.lit(', "kind": "'), F.col("event_type"), F.lit('"}'))))
    return e.select("event_id", F.concat(F.lit("```json\n"), odd, F.lit("\n```")).alias("raw"))


@query("""WITH e AS (SELECT *, CAST(regexp_extract(props, '(-?\\d+)', 1) AS DOUBLE) + CASE WHEN event_id % 10 = 5 AND event_id % 7 = 0 THEN 0.3 ELSE 0 END AS x, event_id % 10 AS m FROM events)
SELECT event_id, CASE WHEN m <> 4 THEN round(least(greatest(x, 0), 50)) END AS k, CASE WHEN m = 4 THEN 'VIEW' WHEN m IN (3, 5) THEN NULL WHEN event_type IN ('click', 'view') THEN upper(event_type) END AS kind,
  CASE WHEN m = 3 THEN true END AS flag, CASE WHEN m = 3 THEN 'one' WHEN m = 5 THEN 'two,three,4' ELSE '' END AS tags, CASE WHEN m <> 4 AND (x < 0 OR x > 50) THEN 'k' ELSE '' END AS clamped,
  '' AS dropped, CASE WHEN m = 4 THEN 'missing: k' END AS error FROM e""")
def conform_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.conform(_responses(spark, sf_dir), _FIELDS)
    return out.select("event_id", "k", "kind", "flag", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ",").alias("tags"), F.array_join("clamped", ",").alias("clamped"), F.array_join("dropped", ",").alias("dropped"), "error")



_ANSWER = [
    ledger.Field("sentiment", "NUMBER", True, -1, 1), ledger.Field("materiality", "NUMBER", True, 0, 1), ledger.Field("event_type", "ENUM", values=(*news.EVENTS, "OTHER")), ledger.Field("time_horizon", "ENUM", values=("HOURS", "DAYS", "WEEKS", "MONTHS")),
    ledger.Field("speculation", "BOOLEAN"), ledger.Field("summary", "TEXT"), ledger.Field("entities", "TEXT_LIST"),
]


@query(f"""WITH {_TOKENS}, a AS (SELECT t.seq, coalesce(tokens, []) AS tokens FROM t LEFT JOIN s USING (seq)), h AS (SELECT seq, {_HITS} FROM a),
e AS (SELECT *, greatest(reg, mac, inc, lis, pro, fun, par) AS most, CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0.0 END AS sentiment FROM h),
y AS (SELECT *, CASE WHEN most = 0 THEN 'OTHER' WHEN reg = most THEN 'REGULATORY' WHEN mac = most THEN 'MACRO' WHEN inc = most THEN 'SECURITY_INCIDENT' WHEN lis = most THEN 'LISTING' WHEN pro = most THEN 'PROTOCOL' WHEN fun = most THEN 'FUNDING' ELSE 'PARTNERSHIP' END AS event_type FROM e),
f AS (SELECT *, least(0.5, (CASE WHEN event_type IN ('REGULATORY', 'MACRO', 'SECURITY_INCIDENT') THEN 0.45 WHEN event_type IN ('PROTOCOL', 'LISTING') THEN 0.35 WHEN event_type = 'OTHER' THEN 0.15 ELSE 0.25 END + 0.1 * abs(sentiment)) * CASE WHEN speculation THEN 0.6 ELSE 1 END)::DOUBLE AS materiality, seq % 6 AS m FROM y)
SELECT seq, CASE m WHEN 0 THEN 'MACRO' WHEN 3 THEN 'OTHER' ELSE event_type END AS event_type, round(CASE m WHEN 0 THEN 1 WHEN 3 THEN -0.5 ELSE sentiment END, 6) AS sentiment, round(CASE m WHEN 0 THEN 0.3 WHEN 3 THEN 0.9 ELSE materiality END, 6) AS materiality,
  CASE WHEN m IN (0, 3) THEN m = 0 ELSE speculation END AS speculation, CASE m WHEN 0 THEN 'WEEKS' ELSE 'DAYS' END AS time_horizon, CASE m WHEN 0 THEN 'ASSET:BTC,ASSET:ETH' ELSE '' END AS entities,
  sha256(CASE m WHEN 3 THEN 'Short.' ELSE substr(text, length({_FIRST}) + 1) END) AS summary, CASE WHEN m IN (0, 3) THEN 'model' ELSE 'heuristic' END AS extractor FROM f JOIN documents ON doc_id = seq""")
def news_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers on every news item: a full one, a short one, one that lacks a number and one without JSON; the last two fall back on the words."""
    n = A.news(spark, sf_dir)
    m = F.col("seq") % 6
    full = '{"sentiment": 2, "materiality": 0.3, "event_type": " macro ", "time_horizon": "weeks", "speculation": "TRUE", "entities": ["btc", "ASSET:eth", "bad symbol", "BTC"]}'
    raw = F.when(m == 0, full).when(m == 3, '{"sentiment": -0.5, "materiality": "0.9", "event_type": "party", "summary": "Short."}').when(m % 3 == 1, '{"sentiment": 0.1}').otherwise("none")
    answers = ledger.conform(n.select("seq", raw.alias("raw")), _ANSWER)
    words = news.analyze(n).withColumn("time_horizon", F.lit("DAYS")).withColumn("entities", F.array().cast("array<string>"))
    out = ledger.news_from_conformed(answers, words)
    return out.select("seq", "event_type", F.round("sentiment", 6).alias("sentiment"), F.round("materiality", 6).alias("materiality"), "speculation", "time_horizon", F.array_join("entities", ",").alias("entities"), F.sha2("summary", 256).alias("summary"), "extractor")


_LISTED = [
    ledger.Field("k", "INTEGER", True, 0, 50), ledger.Field("sure", "BOOLEAN"),
    ledger.Field("items", "OBJECT_LIST", True, fields=(ledger.Field("n", "NUMBER", True, 0, 100), ledger.Field("name", "TEXT"))),
]


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with a list of objects: none, an empty one, no list, one with broken and clamped items, one of the event itself."""
    e = A.table(spark, sf_dir, "events")
    m = F.col("event_id") % 10
    odd = '[{"n": 120, "name": "a"}, {"name": "b"}, 5, {"n": -3, "name": " c "}, {"n": "7"}, {"n": true}, {"n": null, "name": "d"}]'
    own = F.concat(F.lit('[{"n": '), (F.col("event_id") % 150).cast("string"), F.lit(', "name": "'), F.col("event_type"), F.lit('"}]'))
    items = F.when(m == 6, "[]").when(m == 7, odd).when(m == 8, '{"n": 1}').when(m != 9, own)
    put = F.concat(F.when(m < 5, ', "sure": " TRUE "').otherwise(', "sure": "yes"'), F.coalesce(F.concat(F.lit(', "items": '), items), F.lit("")), F.lit("}"))
    return e.select("event_id", F.concat(F.regexp_replace("props", r"\}$", ""), put).alias("raw"))


_LISTED_SQL = """e AS (SELECT event_id, event_type, event_id % 10 AS m, event_id % 150 AS n, CAST(regexp_extract(props, '(-?\\d+)', 1) AS DOUBLE) AS x FROM events),
c AS (SELECT event_id, m, round(least(greatest(x, 0), 50)) AS k, CASE WHEN m < 5 THEN true END AS sure, CASE WHEN m = 7 THEN '100.0:a,0.0: c ,7.0:' WHEN m IN (6, 8) THEN '' WHEN m <> 9 THEN concat(CAST(CAST(least(n, 100) AS DOUBLE) AS VARCHAR), ':', event_type) END AS items,
  CASE WHEN m = 9 THEN [] ELSE list_concat(CASE WHEN x < 0 OR x > 50 THEN ['k'] ELSE [] END, CASE WHEN m = 7 THEN ['items.n', 'items.n'] WHEN m NOT IN (6, 8) AND n > 100 THEN ['items.n'] ELSE [] END) END AS clamped,
  CASE WHEN m = 7 THEN ['items', 'items', 'items', 'items'] ELSE [] END AS dropped, CASE WHEN m = 9 THEN 'missing: items' END AS error FROM e)"""


@query(f"WITH {_LISTED_SQL} SELECT event_id, k, sure, items, array_to_string(clamped, ',') AS clamped, array_to_string(dropped, ',') AS dropped, error FROM c")
def conform_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A required list of objects whose items have a required number within bounds."""
    out = ledger.conform(_listed(spark, sf_dir), _LISTED)
    items = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["n"].cast("string"), F.coalesce(x["name"], F.lit("")))), ",")
    return out.select("event_id", "k", "sure", items.alias("items"), F.array_join("clamped", ",").alias("clamped"), F.array_join("dropped", ",").alias("dropped"), "error")


@query(f"WITH {_LISTED_SQL} SELECT violation, count(*) AS n FROM (SELECT unnest(list_concat(clamped, list_transform(dropped, lambda x: concat('dropped:', x)))) AS violation FROM c) GROUP BY 1")
def violation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each broken item and each clamped number counts."""
    return ledger.violation_report(ledger.conform(_listed(spark, sf_dir), _LISTED))


# epoch_ms rounds, which puts the last half millisecond of a minute into the next one; a price is rounded as the decimal that its text is
@query("""SELECT event_id // 50 AS body, CAST(epoch(date_trunc('minute', ts)) AS BIGINT) * 1000 AS open_ms, CAST(round(TRY_CAST(CAST(value AS VARCHAR) AS DECIMAL(24, 12)), 2) AS DOUBLE) AS close, user_id AS trade_count, ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 1 MINUTE AS is_final FROM events""")
def decode_klines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty events a landed body, each an array of text values."""
    e = A.table(spark, sf_dir, "events")
    ms = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 60000) * 60000
    v = F.col("value").cast("string")
    one = F.array(ms.cast("string"), v, v, v, v, v, (F.unix_millis(F.col("ts").cast("timestamp")) + 60000).cast("string"), v, F.col("user_id").cast("string"), v)
    raw = e.groupBy(F.expr("event_id div 50").alias("instrument_id")).agg(F.to_json(F.collect_list(one)).alias("body")).withColumn("timeframe", F.lit("1m"))
    out = decode.klines(raw, F.expr("timestamp '2024-01-15 00:00:00'"))
    return out.select(F.col("instrument_id").alias("body"), F.unix_millis("open_time").alias("open_ms"), F.round("close", 2).cast("double").alias("close"), F.col("trade_count").cast("long").alias("trade_count"), "is_final")


@query("""WITH r AS (SELECT p_partkey, unnest([{'t': 'BOOLEAN', 'raw': CASE p_size % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'FALSE' WHEN 2 THEN 'yes' END}, {'t': 'DECIMAL', 'raw': CASE WHEN p_size % 3 = 0 THEN concat(p_size, '.') ELSE concat(p_size, '.250') END},
  {'t': 'INTEGER', 'raw': CASE WHEN p_size % 5 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END}, {'t': 'DATE', 'raw': CASE WHEN p_size % 2 = 0 THEN '2026-01-05' ELSE '2026-02-06T10:20:30Z' END}, {'t': 'TIMESTAMP', 'raw': CASE WHEN p_size % 3 = 0 THEN 'today' ELSE '2026-02-06T10:20:30Z' END},
  {'t': 'STRING', 'raw': p_brand}, {'t': 'REFERENCE', 'raw': CASE WHEN p_size % 2 = 0 THEN '0000000A-0000-4000-8000-00000000000b' ELSE p_brand END}, {'t': 'JSON', 'raw': CASE WHEN p_size % 2 = 0 THEN '{"n": 1}' ELSE '{"n": ' END}], recursive := true) FROM part)
SELECT p_partkey, t AS data_type, raw, CASE WHEN t = 'STRING' THEN raw END AS value_text, CASE WHEN t IN ('DECIMAL', 'INTEGER') THEN TRY_CAST(raw AS DOUBLE) END AS value_numeric, CASE WHEN t = 'BOOLEAN' AND lower(raw) IN ('true', 'false') THEN lower(raw) = 'true' END AS value_bool,
  CAST(CASE WHEN t = 'DATE' THEN epoch(CAST(left(raw, 10) AS DATE)) WHEN t = 'TIMESTAMP' AND raw <> 'today' THEN epoch(TIMESTAMP '2026-02-06 10:20:30') END AS BIGINT) AS value_ts, CASE WHEN t = 'REFERENCE' AND length(raw) = 36 THEN raw END AS value_ref, CASE WHEN t = 'JSON' AND json_valid(raw) THEN raw END AS value_json,
  CASE WHEN raw IS NULL THEN 'NULL' WHEN t = 'BOOLEAN' AND lower(raw) NOT IN ('true', 'false') OR t = 'INTEGER' AND TRY_CAST(raw AS DOUBLE) IS NULL OR t = 'TIMESTAMP' AND raw = 'today' OR t = 'REFERENCE' AND length(raw) <> 36 OR t = 'JSON' AND NOT json_valid(raw) THEN 'NOT_A_VALUE' END AS reason FROM r""")
def value_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as eight raw values, one a type, some of them null or not of their type: the value or the reason of each."""
    n, brand = F.col("p_size"), F.col("p_brand")
    at = "2026-02-06T10:20:30Z"
    raw = {
        "BOOLEAN": F.when(n % 4 == 0, "true").when(n % 4 == 1, "FALSE").when(n % 4 == 2, "yes"), "DECIMAL": F.concat(n.cast("string"), F.when(n % 3 == 0, ".").otherwise(".250")), "INTEGER": F.when(n % 5 == 0, brand).otherwise(n.cast("string")),
        "DATE": F.when(n % 2 == 0, "2026-01-05").otherwise(at), "TIMESTAMP": F.when(n % 3 == 0, "today").otherwise(at), "STRING": brand,
        "REFERENCE": F.when(n % 2 == 0, "0000000A-0000-4000-8000-00000000000b").otherwise(brand), "JSON": F.when(n % 2 == 0, '{"n": 1}').otherwise('{"n": '),
    }
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("data_type"), v.alias("raw")) for t, v in raw.items())))
    out = decode.values(A.table(spark, sf_dir, "part").select("p_partkey", each.alias("v")).select("p_partkey", "v.*"))
    return out.withColumns({"value_numeric": F.col("value_numeric").cast("double"), "value_ts": F.unix_seconds("value_ts")})


@query("""WITH p AS (SELECT page_id, url, html, CASE WHEN page_id % 9 = 0 THEN 'DOCTYPE' WHEN page_id % 11 = 5 THEN 'BAD_XML' WHEN page_id % 2 = 1 AND page_id % 13 = 7 THEN 'NO_URL_OR_TITLE' END AS reason FROM pages WHERE trim(html) <> '')
SELECT page_id, CASE WHEN reason IS NULL OR reason = 'NO_URL_OR_TITLE' THEN concat('Page & ', page_id) END AS title, CASE WHEN reason IS NULL THEN url END AS url, CASE WHEN reason IS NULL OR reason = 'NO_URL_OR_TITLE' THEN sha256(trim(html)) END AS body,
  CAST(epoch(CASE WHEN reason IN ('DOCTYPE', 'BAD_XML') OR page_id % 2 = 0 AND page_id % 3 = 2 THEN TIMESTAMP '2026-01-06 00:00:00' WHEN page_id % 2 = 0 AND page_id % 3 = 1 THEN TIMESTAMP '2026-01-05 08:00:00' ELSE TIMESTAMP '2026-01-05 10:00:00' END) AS BIGINT) AS published_at, reason FROM p""")
def parse_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as an RSS or Atom body with its address and HTML, times of several kinds; some have a DOCTYPE, no end or no link of their own."""
    k = F.col("page_id")
    p = A.table(spark, sf_dir, "pages").where(F.trim("html") != "")
    u = F.regexp_replace(F.regexp_replace("url", "&", "&amp;"), "<", "&lt;")
    html = F.concat(F.lit("<![CDATA["), "html", F.lit("]]>"))
    when = F.when(k % 3 == 0, "Mon, 05 Jan 2026 10:00:00 GMT").when(k % 3 == 1, "Mon, 05 Jan 2026 10:00:00 +0200").otherwise("2026-01-05 10:00")
    rss = F.concat(F.lit("<rss><channel><title>All</title><item><title>Page &#38; "), k, F.lit("</title><link>"), u, F.lit("</link><content:encoded>"), html, F.lit("</content:encoded><pubDate>"), when, F.lit("</pubDate></item></channel></rss>"))
    rel = F.when(k % 13 == 7, "related").otherwise("alternate")
    atom = F.concat(F.lit('<feed><entry><title type="text">Page &amp; '), k, F.lit('</title><link rel="self" href="x"/><link rel="'), rel, F.lit('" href="'), u, F.lit('"/><content type="html">'), html, F.lit("</content><updated>2026-01-05T10:00:00Z</updated></entry></feed>"))
    cut = F.concat(F.lit("<rss><channel><item><title>Page"), html, F.lit("</item>"))
    body = F.when(k % 9 == 0, F.concat(F.lit("<!DOCTYPE x>"), rss)).when(k % 11 == 5, cut).when(k % 2 == 0, rss).otherwise(atom)
    out = decode.feeds(p.select(k.alias("feed_id"), F.expr("timestamp '2026-01-06 00:00:00'").alias("fetched_at"), body.alias("body")))
    return out.select(F.col("feed_id").alias("page_id"), "title", "url", F.sha2("body", 256).alias("body"), F.unix_seconds("published_at").alias("published_at"), "reason")


@query("""WITH a AS (SELECT user_id, event_id, event_type <> 'error' AS ok, value FROM events), g AS (SELECT user_id, max(event_id) FILTER (WHERE ok) AS last_ok FROM a GROUP BY 1)
SELECT a.user_id, max(value) FILTER (WHERE ok) AS watermark, count(*) FILTER (WHERE NOT ok AND event_id > coalesce(last_ok, -1)) AS consecutive_errors, arg_max(value, event_id) FILTER (WHERE ok) AS cursor
FROM a JOIN g USING (user_id) GROUP BY 1""")
def advance_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"), "value", F.col("event_type").alias("message"))
    w = progress.advance_watermarks(e, ["user_id"]).select("user_id", F.col("progress").alias("watermark"), "consecutive_errors")
    return w.join(progress.advance_cursors(e, ["user_id"]).select("user_id", F.col("progress").alias("cursor")), "user_id")


@query("""SELECT s_suppkey, lower(s_name) AS symbol, 'FOUND' AS status FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT NULL, concat('NONE', s_suppkey), 'NOT_FOUND' FROM supplier WHERE s_suppkey % 7 = 0""")
def select_configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers whose name is configured, in whatever case, and configured names that no supplier has."""
    s = A.table(spark, sf_dir, "supplier")
    configured = s.where("s_suppkey % 3 = 0").select(F.col("s_name").alias("symbol")).unionByName(s.where("s_suppkey % 7 = 0").select(F.concat(F.lit("none"), "s_suppkey").alias("symbol")))
    found, missing = B.select_configured(s.select("s_suppkey", F.lower("s_name").alias("symbol")), configured)
    return found.withColumn("status", F.lit("FOUND")).unionByName(missing.withColumn("status", F.lit("NOT_FOUND")), allowMissingColumns=True)


@query("""WITH r AS (SELECT ((doc_id * 37) % 100) / 100.0 AS c, CAST(quality AS DOUBLE) AS h FROM labels), p AS (SELECT c, h, least(greatest(c, 1e-6), 1 - 1e-6) AS q, CAST(least(9, floor(c * 10)) AS INTEGER) AS bucket FROM r)
SELECT bucket, count(*) AS n, round(avg(h), 6) AS hit_rate, round(avg((c - h) * (c - h)), 6) AS brier, round(avg(-(h * ln(q) + (1 - h) * ln(1 - q))), 5) AS log_loss FROM p GROUP BY 1""")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "labels").select((F.col("doc_id") * 37 % 100 / 100.0).alias("confidence"), F.col("quality").cast("double").alias("hit"))
    return learning.calibration(rows).select("bucket", "n", F.round("hit_rate", 6).alias("hit_rate"), F.round("brier", 6).alias("brier"), F.round("log_loss", 5).alias("log_loss"))


@query("""WITH r AS (SELECT concat('K', doc_id % 4) AS kind, concat('R', doc_id % 3) AS regime, CAST(quality AS DOUBLE) AS h FROM labels), b AS (SELECT avg(h) AS base FROM r)
SELECT kind, regime, n, round(hit / base, 6) AS lift FROM (SELECT kind, regime, count(*) AS n, avg(h) AS hit FROM r GROUP BY CUBE (kind, regime)), b WHERE n >= 25""")
def evidence_effectiveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "labels").select(F.concat(F.lit("K"), F.col("doc_id") % 4).alias("kind"), F.concat(F.lit("R"), F.col("doc_id") % 3).alias("regime"), F.col("quality").cast("double").alias("hit"))
    return learning.evidence_effectiveness(rows).select("kind", "regime", "n", F.round("lift", 6).alias("lift"))


@query("SELECT CASE WHEN s AND h THEN 'CORRECT' WHEN s THEN 'LUCKY' WHEN h THEN 'UNLUCKY' ELSE 'WRONG' END AS verdict, count(*) AS n FROM (SELECT quality = 1 AS s, toxic = 0 AS h FROM labels) GROUP BY 1")
def verdict_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "labels").groupBy(learning.verdict(F.col("quality") - 0.5, F.col("toxic") == 0).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]) AS s FROM q, embeddings WHERE vec_id <> query_id)
SELECT query_id, vec_id, round(s, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS k FROM s) WHERE k <= 10""")
def similar_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = A.table(spark, sf_dir, "embeddings")
    return learning.similar_objects(v, v.where("vec_id % 50 = 0"), 10).select("query_id", "vec_id", F.round("similarity", 5).alias("similarity"))


# streams, run to the end of what there is


def _streamed(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """The rows a stream appends until its source is read to the end, from a table in the shared folder."""
    at = f"{graph.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


@query("""WITH w AS (SELECT event_type AS instrument_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS o, value, event_id, ts FROM events)
SELECT instrument_id, o AS open_time, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, count(*) AS volume
FROM w GROUP BY 1, 2 HAVING o + 3600 <= (SELECT epoch(max(ts)) FROM events) - 600""")
def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = A.table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(kind).parquet(f"{sf_dir}/events.parquet*")
    e = e.select(F.col("event_type").alias("instrument_id"), F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_id").alias("seq"))
    return _streamed(spark, streams.stream_bars(e, 3600)).withColumn("open_time", F.unix_seconds("open_time"))
