"""Queries over catalogs, registers, counters, small text functions, list and link writes, and the streaming forms."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronark.functions import text
from chronark.operators import bars as B
from chronark.operators import bitemporal as bt
from chronark.operators import graph, ledger, news, progress, registers, temporal
from chronark.operators import query as qb
from chronark.plans import adapters as A
from chronark.plans.registry import query
from chronark.plans.write_queries import in_order
from chronark.plans.series_queries import B15, _signal_rows
from chronark.plans.text_queries import _COUNTED, _HEADLINES, _clusters, _streamed
from chronark.sources import decode
from chronark.streaming import streams


@query("SELECT 'EX' AS exchange, p_name AS symbol, p_brand AS base_asset, CASE p_size % 10 WHEN 0 THEN 'TRADING' WHEN 6 THEN 'DELISTED' WHEN 7 THEN 'DELISTED' WHEN 8 THEN 'UNKNOWN' WHEN 9 THEN 'UNKNOWN' ELSE 'HALT' END AS status, CASE WHEN p_size % 2 = 0 THEN p_size / 100 ELSE 1e-8 END AS tick_size, p_partkey AS body FROM part")
def decode_exchange_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.table(spark, sf_dir, "part")
    names = ("TRADING", "HALT", "BREAK", "AUCTION_MATCH", "PRE_TRADING", "POST_TRADING", "DELISTED", "END_OF_DAY", "CLOSE", "AUCTION")
    status = F.element_at(F.array(*map(F.lit, names)), (F.col("p_size") % 10 + 1).cast("int"))
    rule = F.when(F.col("p_size") % 2 == 0, F.array(F.create_map(F.lit("filterType"), F.lit("PRICE_FILTER"), F.lit("tickSize"), (F.col("p_size") / 100).cast("string")))).otherwise(F.array().cast("array<map<string,string>>"))
    one = F.struct(F.col("p_name").alias("symbol"), F.col("p_brand").alias("baseAsset"), F.lit("Q").alias("quoteAsset"), status.alias("status"), rule.alias("filters"))
    raw = p.select(F.col("p_partkey").cast("string").alias("exchange"), F.to_json(F.struct(F.array(one).alias("symbols"))).alias("body"))
    out = decode.exchange_info(raw)
    return out.select(F.lit("EX").alias("exchange"), "symbol", "base_asset", "status", F.col("tick_size").cast("double").alias("tick_size"), F.col("exchange").cast("long").alias("body"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS series, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, o_totalprice AS value FROM orders WHERE o_orderkey % 9 <> 0")
def decode_vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landed body for each customer; every ninth value is a dot."""
    day = F.col("o_orderdate").cast("date").cast("string")
    one = F.struct(day.alias("date"), F.when(F.col("o_orderkey") % 9 == 0, ".").otherwise(F.col("o_totalprice").cast("string")).alias("value"), day.alias("realtime_start"), F.lit("9999-12-31").alias("realtime_end"))
    raw = A.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("series")).agg(F.to_json(F.struct(F.collect_list(one).alias("observations"))).alias("body"))
    return decode.vintages(raw).select("series", F.col("date").cast("string").alias("date"), F.col("value").cast("double").alias("value"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS series, s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'Index' ELSE '' END AS units FROM supplier")
def decode_series_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct(F.col("s_name").alias("title"), F.when(F.col("s_suppkey") % 2 == 0, "Index").alias("units"))
    raw = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("series"), F.to_json(F.struct(F.array(one).alias("seriess"))).alias("body"))
    return decode.series_meta(raw).select("series", "title", "units")


@query("SELECT p_partkey AS symbol, p_brand AS base_asset, CASE WHEN p_partkey % 2 = 0 THEN 'HALT' ELSE 'TRADING' END AS status FROM part UNION ALL SELECT p_partkey + 1000000000, 'new', 'HALT' FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 = 0")
def register_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even parts come again as halted with another base asset, some under a new symbol."""
    p = A.table(spark, sf_dir, "part")
    row = lambda df, key, base, status: df.select(F.lit("X").alias("exchange"), key.alias("symbol"), base.alias("base_asset"), F.lit("Q").alias("quote_asset"), F.lit(status).alias("status"), F.lit(0.1).alias("tick_size"), F.lit(0.1).alias("step_size"), F.lit(0.0).alias("min_notional"))
    old = row(p, F.col("p_partkey"), F.col("p_brand"), "TRADING")
    even = p.where("p_partkey % 2 = 0")
    new = row(even, F.col("p_partkey"), F.lit("new"), "HALT").unionByName(row(even.where("p_partkey % 3 = 0"), F.col("p_partkey") + 1_000_000_000, F.lit("new"), "HALT"))
    return B.register_instruments(old, new).select("symbol", "base_asset", "status")


@query("SELECT url, any_value(CASE WHEN page_id % 2 = 0 THEN 'second' ELSE 'first' END) AS name FROM pages GROUP BY url, page_id")
def register_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.table(spark, sf_dir, "pages").select(F.col("url"), "page_id")
    keyed = p.withColumn("url", F.concat_ws("|", "page_id", "url"))
    old = keyed.select("url", F.lit("first").alias("name"), F.lit(True).alias("enabled"))
    new = keyed.where("page_id % 2 = 0").select("url", F.lit("second").alias("name"), F.lit(True).alias("enabled"))
    return progress.register_feeds(old, new).select(F.regexp_replace("url", r"^\d+\|", "").alias("url"), "name")


@query("""WITH g AS (SELECT user_id, max(event_id) FILTER (WHERE event_type <> 'error') AS last_ok FROM events GROUP BY 1)
SELECT user_id, max(event_id) AS last_attempt, last_ok AS last_success, count(*) FILTER (WHERE event_id > coalesce(last_ok, -1)) AS consecutive_errors FROM events JOIN g USING (user_id) GROUP BY user_id, last_ok""")
def feed_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"), "value", F.col("event_type").alias("message"))
    return progress.feed_health(e, ["user_id"]).select("user_id", "last_attempt", "last_success", "consecutive_errors")


@query(f"WITH {B15} SELECT instrument_id, strftime(to_timestamp(o) AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n FROM b GROUP BY 1, 2")
def monthly_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written in folders by timeframe and month and read again through the pruning predicate."""
    at = f"{graph.shared_dir(spark)}/bars-{uuid.uuid4().hex}"
    B.write_monthly(A.bars(spark, sf_dir, "15m", 900), at)
    rows = B.read_monthly(spark.read.parquet(at), F.expr("timestamp '2000-01-01 00:00:00'"), F.expr("timestamp '2100-01-01 00:00:00'"))
    return rows.groupBy("instrument_id", F.date_format("open_time", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'Party' AS type, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier")
def type_closure_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = A.projection(spark, sf_dir), A.catalog()
    out = None
    for t in ("Party", "Customer", "Supplier"):
        rows = p.where(F.col("type").isin(*c.descendants(t))).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("type"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT type, property, n FROM (SELECT 'Customer' AS type, unnest(['balance', 'name', 'segment', 'tags']) AS property, count(*) AS n FROM customer UNION ALL SELECT 'Supplier', unnest(['balance', 'name']), count(*) FROM supplier)")
def inherit_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own and inherited properties of every object's type."""
    c = A.catalog()
    defs = spark.createDataFrame([(t, p) for t in c.parents for p in sorted(c.properties(t))], "type string, property string")
    return A.projection(spark, sf_dir).join(F.broadcast(defs), "type").groupBy("type", "property").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT concat('C', c_custkey) AS object_id, CASE WHEN c_custkey % 7 <> 0 THEN 1 ELSE 0 END AS kept FROM customer")
def traverse_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only LOCATED_IN stays in the view."""
    places = A.places(spark, sf_dir)
    summary = qb.link_summary(A.links(spark, sf_dir), places)
    rows = A.parties(spark, sf_dir).where("type = 'Customer'").select("object_id").join(summary, "object_id", "left")
    out = qb.traverse(rows, ["LOCATED_IN"])
    return out.select("object_id", F.coalesce(F.size(F.map_keys("link_summary")), F.lit(0)).alias("kept"))


@query("SELECT concat('C', c_custkey) AS object_id FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 3 = 0")
def find_by_external_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.objects(spark, sf_dir)
    return bt.find_by_external_id(o, o.where("type = 'Customer' AND CAST(substring(object_id, 2) AS long) % 3 = 0").select("type", "external_id")).select("object_id")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey % 13 = 0) AS fresh FROM customer")
def find_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that were deleted are created anew, others are found."""
    o = A.objects(spark, sf_dir).where("type = 'Customer'")
    new = o.select(F.concat(F.lit("N"), "object_id").alias("object_id"), "type", "external_id", "exists_from", "recorded_at", F.lit(None).cast("timestamp").alias("deleted_at"))
    return bt.find_or_create(o, new).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("object_id").startswith("N")).alias("fresh"))


@query("""SELECT concat('C', c_custkey) AS object_id, CASE WHEN c_custkey % 2 = 0 THEN concat('N', c_nationkey) ELSE concat('N', c_nationkey, ',S', c_custkey % 3) END AS tags, CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 2 END AS versions FROM customer""")
def set_property_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even customers' tags shrink to the first one, the others' are written again unchanged."""
    v = A.object_values(spark, sf_dir).where("property = 'tags'").select(*bt.STATE)
    p = A.parties(spark, sf_dir).where("type = 'Customer'")
    when = F.expr("timestamp '2000-01-01 00:00:00'")
    lists = p.select("object_id", F.lit("tags").alias("property"), F.when(F.col("key") % 2 == 0, F.slice("tags", 1, 1)).otherwise(F.col("tags")).alias("elements"), when.alias("valid_from"), when.alias("recorded_at"))
    s = bt.set_lists(v, lists)
    open_ = F.when(temporal.is_current(), F.struct("ordinal", "value"))
    return s.groupBy("object_id").agg(F.array_join(F.sort_array(F.collect_list(open_)).getField("value"), ",").alias("tags"), F.count(F.lit(1)).cast("int").alias("versions"))


@query("SELECT concat('C', c_custkey) AS from_id, c_custkey % 7 = 0 OR c_custkey % 2 = 0 AND c_custkey % 300 < 100 AS ended FROM customer")
def unlink_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = A.links(spark, sf_dir).where("from_id LIKE 'C%'")
    ends = links.where("CAST(substring(from_id, 2) AS long) % 2 = 0").select("link_type", "from_id", "to_id", F.timestamp_seconds(F.lit(852076800 + 86400 * 100)).alias("until"))
    return bt.unlink_objects(links, ends).select("from_id", F.col("valid_to").isNotNull().alias("ended"))


@query("SELECT o_custkey AS object_id, 'SET_PROPERTY' AS op, count(*) AS n FROM (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS last FROM orders) WHERE last IS NULL OR last <> o_totalprice GROUP BY 1")
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry for each effective change of a bulk write."""
    a = A.price_assertions(spark, sf_dir).withColumn("recorded_at", F.col("valid_from"))
    none = spark.createDataFrame([], "object_id long, property string, ordinal int, value decimal(38,12), valid_from timestamp, valid_to timestamp, recorded_at timestamp, retracted_at timestamp")
    return bt.apply_assertions(none, a).log.groupBy("object_id", "op").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'Customer' AS type, count(*) AS objects, count(*) FILTER (WHERE c_custkey % 11 = 0) AS missing_balance FROM customer WHERE c_custkey % 13 <> 0 UNION ALL SELECT 'Supplier', count(*), 0 FROM supplier WHERE s_suppkey % 13 <> 0")
def missing_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.objects(spark, sf_dir)
    required = spark.createDataFrame([("Customer", "balance"), ("Supplier", "balance")], "type string, property string")
    without = registers.missing_required(o, A.object_values(spark, sf_dir), required).groupBy("type").agg(F.count(F.lit(1)).alias("missing_balance"))
    return registers.object_counts(o).join(without, "type", "left").select("type", "objects", F.coalesce("missing_balance", F.lit(0)).alias("missing_balance"))


@query("SELECT CASE WHEN copies > 1 AND doc_id > first THEN 'DUPLICATE' ELSE 'NEW' END AS outcome, count(*) AS n FROM (SELECT doc_id, count(*) OVER w AS copies, min(doc_id) OVER w AS first FROM documents WINDOW w AS (PARTITION BY source, doc_id % 700)) GROUP BY 1")
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.news(spark, sf_dir)
    new = news.dedup_url(n).select("seq", F.lit("NEW").alias("outcome"))
    return news.ingest_report(n.select("seq").join(new, "seq", "left").select(F.coalesce("outcome", F.lit("DUPLICATE")).alias("outcome")))


@query("""WITH v AS (SELECT doc_id, unnest(['sentiment', 'materiality', 'sourceCount', 'publishedAt', 'mood']) AS property FROM documents), r AS (SELECT doc_id, property, CASE property WHEN 'sentiment' THEN (doc_id % 31 - 15) / 10.0 WHEN 'materiality' THEN (doc_id % 23 - 4) / 10.0 END AS x FROM v)
SELECT property, violation, count(*) AS n FROM (SELECT property, CASE WHEN property = 'mood' THEN 'UNKNOWN_PROPERTY' WHEN property = 'sourceCount' THEN CASE WHEN doc_id % 4 = 0 THEN 'TYPE' END WHEN property = 'publishedAt' THEN CASE WHEN doc_id % 5 = 0 THEN 'TYPE' END
  WHEN x < CASE property WHEN 'sentiment' THEN -1 ELSE 0 END THEN 'MIN' WHEN x > 1 THEN 'MAX' END AS violation FROM r) WHERE violation IS NOT NULL GROUP BY 1, 2""")
def news_value_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of articles against the news schema: bounds of tone and weight, numbers, times, and a property that it doesn't have."""
    rules = news.ensure_schema(qb.Catalog({}, {})).value_rules(spark)
    d, k = A.table(spark, sf_dir, "documents"), F.col("doc_id")
    raws = {
        "sentiment": ((k % 31 - 15) / 10).cast("string"), "materiality": ((k % 23 - 4) / 10).cast("string"), "sourceCount": F.when(k % 4 == 0, "1.5").otherwise("3"),
        "publishedAt": F.when(k % 5 == 0, "soon").otherwise("2026-01-01T00:00:00Z"), "mood": F.lit("calm"),
    }
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("property"), raw.alias("raw")) for p, raw in raws.items()))).alias("v")
    found = bt.validate_values(d.select(F.lit("NewsArticle").alias("type"), each).select("type", "v.property", "v.raw"), rules)
    return found.select("property", F.explode("violations").alias("violation")).groupBy("property", "violation").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT concat('C', c_custkey) AS object_id, CAST(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal * 2 ELSE c_acctbal END AS DOUBLE) AS balance FROM customer WHERE c_custkey % 5 <> 0""")
def refresh_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even customers' balances doubled and every fifth was deleted; only these objects' rows of the projection are replaced."""
    p = A.parties(spark, sf_dir).where("type = 'Customer'").select("object_id", "key", "name", F.col("balance").cast("double").alias("balance"), F.lit(None).cast("timestamp").alias("deleted_at"))
    c = A.table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("object_id"), F.col("c_acctbal").cast("double").alias("balance"))
    before = c.where("true")
    touched = p.where("key % 2 = 0 OR key % 5 = 0").select("object_id")
    rebuilt = c.join(p.select("object_id", "key"), "object_id").select("object_id", (F.col("balance") * F.when(F.col("key") % 2 == 0, 2).otherwise(1)).alias("balance"))
    objects = p.select("object_id", F.when(F.col("key") % 5 == 0, F.expr("timestamp '1999-01-01 00:00:00'")).alias("deleted_at"))
    return qb.refresh(before, rebuilt, touched, objects).select("object_id", "balance")


@query(f"WITH RECURSIVE {_HEADLINES}, {_clusters('t')}, c AS ({_COUNTED}) SELECT cluster_seq, source_count, last_at, title FROM c WHERE last_at >= epoch(TIMESTAMP '2026-01-02') - 48 * 3600 ORDER BY last_at DESC, cluster_seq LIMIT 20")
def recent_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 20 clusters by latest publication of a day."""
    n = A.headlines(spark, sf_dir)
    c = news.cluster_counters(n, news.cluster(n))
    return news.recent_clusters(c, F.expr("timestamp '2026-01-02 00:00:00'"), 48, 20).select("cluster_seq", "source_count", F.unix_seconds("last_at").alias("last_at"), "title")


@query("""SELECT page_id, concat('NEWS:', page_id) AS external, CAST(page_id AS VARCHAR) AS display, CASE WHEN page_id % 2 = 0 THEN 'EX' END AS exchange, CASE WHEN page_id % 2 = 0 THEN concat('S:', page_id) END AS symbol,
  concat('ASSET:A', page_id % 10, ',ASSET:B2') AS entities, substr(url, 1, 20) || CASE WHEN length(url) > 20 THEN '...' ELSE '' END AS cut FROM pages""")
def text_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External ids, display names, exchange symbols, entity ids and cut texts."""
    p = A.table(spark, sf_dir, "pages")
    external = text.external_id("NEWS", F.col("page_id").cast("string"))
    pair = text.split_symbol(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("EX:S:"), "page_id")).otherwise(F.lit("none")))
    names = F.array(F.concat(F.lit("asset:a"), F.col("page_id") % 10), F.lit(" b2 "), F.lit("no good"), F.lit("B2"))
    return p.select("page_id", external.alias("external"), text.display_name(external).alias("display"), pair["exchange"].alias("exchange"), pair["symbol"].alias("symbol"), F.array_join(text.entity_ids(names, "ASSET:"), ",").alias("entities"), text.truncate(F.col("url"), 20, "...").alias("cut"))


@query("""WITH e AS (SELECT *, event_id % 10 AS m FROM events)
SELECT event_id AS seq, CASE WHEN m = 4 THEN 'OTHER' WHEN m IN (3, 5) OR event_type NOT IN ('click', 'view') THEN 'NONE' ELSE upper(event_type) END AS event_type, CASE WHEN m = 4 THEN 'heuristic' ELSE 'model' END AS extractor FROM e""")
def news_from_conformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with the required number give the analysis, the others fall back."""
    from chronark.plans.text_queries import _responses

    fields = [ledger.Field("k", "NUMBER", True), ledger.Field("kind", "ENUM", values=("CLICK", "VIEW"))]
    c = ledger.conform(_responses(spark, sf_dir), fields)
    c = c.select(F.col("event_id").alias("seq"), F.coalesce("kind", F.lit("NONE")).alias("event_type"), F.lit(0.0).alias("sentiment"), F.lit(None).cast("boolean").alias("speculation"), F.lit(0.5).alias("materiality"), "error")
    fallback = c.select("seq", F.lit("OTHER").alias("event_type"), F.lit(0.0).alias("sentiment"), F.lit(False).alias("speculation"), F.lit(0.1).alias("materiality"))
    return ledger.news_from_conformed(c, fallback).select("seq", "event_type", "extractor")


@query(f"""WITH {B15}, l AS (SELECT instrument_id, max(o) AS m FROM b WHERE is_final AND instrument_id <> 'view' GROUP BY 1)
SELECT DISTINCT b.instrument_id, coalesce(m + 900, CAST(epoch(TIMESTAMP '2024-01-20 10:00:00') AS BIGINT) - 200 * 900) AS since FROM b LEFT JOIN l USING (instrument_id)""")
def incremental_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One instrument has no final bar yet."""
    b = A.bars(spark, sf_dir, "15m", 900).withColumn("is_final", F.col("is_final") & (F.col("instrument_id") != "view"))
    return streams.resume_from(b, "15m", F.expr("timestamp '2024-01-20 10:07:00'")).select("instrument_id", F.unix_seconds("since").alias("since"))


def _with_rocksdb(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """``run`` with the state store that keyed state with timers needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return run()
    finally:
        spark.conf.set(name, before)


@query(r"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id AS seq, sha256(trim(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^\p{L}\p{N}]+', ' ', 'g'))) AS content FROM documents),
r AS (SELECT content, min(seq) AS seq FROM d GROUP BY content UNION ALL SELECT content, next FROM (SELECT content, (SELECT min(x.seq) FROM d x WHERE x.content = r.content AND x.seq > r.seq + 144) AS next FROM r) WHERE next IS NOT NULL)
SELECT seq, seq * 1800 AS published, content FROM r""")
def stream_dedup_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News half an hour apart without exact repeats within 72 hours; they land in three parts, and the stream goes on after each."""
    at = f"{graph.shared_dir(spark)}/news-{uuid.uuid4().hex}"
    d = A.table(spark, sf_dir, "documents")
    d = d.select(F.col("doc_id").alias("seq"), F.sha2(text.normalize(F.coalesce("text", F.lit(""))), 256).alias("content"), F.timestamp_seconds(F.lit(1767225600) + F.col("doc_id") * 1800).alias("published_at"))
    third = d.agg(F.max("seq")).first()[0] // 3 + 1
    for k in range(3):
        d.where(F.floor(F.col("seq") / third) == k).write.mode("append").parquet(f"{at}/in")
        kept = streams.stream_dedup(spark.readStream.schema(d.schema).parquet(f"{at}/in"), hours=72)
        _with_rocksdb(spark, lambda kept=kept: kept.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(d.schema).parquet(f"{at}/out").select("seq", (F.unix_seconds("published_at") - 1767225600).alias("published"), "content")


def _landed(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    """The folder where bars land, read as a stream."""
    return spark.readStream.schema(A.bars(spark, sf_dir, "15m", 900).withColumn("seq", F.lit(0).cast("long")).schema).parquet(at)


@query(f"""WITH {B15}, r AS (SELECT instrument_id, (o // 3600) * 3600 AS open_time, arg_max(close, o) AS close, count(*) AS c FROM b WHERE is_final GROUP BY 1, 2)
SELECT instrument_id, open_time, CAST(close AS DOUBLE) AS close FROM r WHERE c = 4""")
def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base bars land in two parts, the second one late: each batch is stored and rolls up the buckets it touches."""
    at = f"{graph.shared_dir(spark)}/rollup-{uuid.uuid4().hex}"
    bars = A.bars(spark, sf_dir, "15m", 900).withColumn("seq", F.lit(1).cast("long"))
    for late in (False, True):
        bars.where((F.xxhash64("instrument_id", "open_time") % 5 == 0) == late).write.mode("append").parquet(f"{at}/in")
        streams.sync(_landed(spark, sf_dir, f"{at}/in"), f"{at}/state", streams.stream_rollup(f"{at}/store", "15m", ["1h"]))
    out = spark.read.parquet(f"{at}/store").where("timeframe = '1h'")
    return out.select("instrument_id", F.unix_seconds("open_time").alias("open_time"), F.col("close").cast("double").alias("close"))


@query(f"""WITH {B15} SELECT instrument_id, o AS open_time, CAST(close AS DOUBLE) AS close, is_final, CAST((SELECT count(*) FROM b) AS BIGINT) AS rows_read FROM b""")
def sync_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars land in three parts, and each sync goes on where the last one stopped: the store, and how many rows all syncs have read."""
    at = f"{graph.shared_dir(spark)}/sync-{uuid.uuid4().hex}"
    bars = A.bars(spark, sf_dir, "15m", 900).withColumn("seq", F.unix_seconds("open_time"))
    read = 0
    for k in range(3):
        bars.where(F.pmod(F.xxhash64("instrument_id", "open_time"), F.lit(3)) == k).write.mode("append").parquet(f"{at}/in")
        for _ in range(2):  # the second finds nothing new
            read += streams.sync(_landed(spark, sf_dir, f"{at}/in"), f"{at}/state", lambda batch, _: streams.merge_bars(f"{at}/store", batch))
    out = spark.read.parquet(f"{at}/store")
    return out.select("instrument_id", F.unix_seconds("open_time").alias("open_time"), F.col("close").cast("double").alias("close"), "is_final", F.lit(read).cast("long").alias("rows_read"))


@query()
def stream_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate as state of a stream of hourly signal rows."""
    at = f"{graph.shared_dir(spark)}/gate-{uuid.uuid4().hex}"
    _signal_rows(spark, sf_dir).write.parquet(f"{at}/in")
    s = spark.readStream.schema(spark.read.parquet(f"{at}/in").schema).parquet(f"{at}/in")
    out = _with_rocksdb(spark, lambda: _streamed(spark, streams.stream_gate(s)))
    return out.withColumn("as_of", F.unix_seconds("as_of"))


@query("""WITH v AS (SELECT o_custkey, o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS gone, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS last FROM orders)
SELECT coalesce(gone < TIMESTAMP '1997-02-01', false) AS archived, strftime(CASE WHEN gone < TIMESTAMP '1997-02-01' THEN gone END, '%Y-%m') AS month, count(*) AS n FROM v GROUP BY 1, 2""")
def archive_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that ended more than 18 months before August 1998 go to an archive by month, the rest stay."""
    at = f"{graph.shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    o = A.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("valid_from"))
    v = o.withColumn("valid_to", F.lead("valid_from").over(W.partitionBy("o_custkey").orderBy("valid_from", "o_orderkey")))
    kept = registers.archive(v, "valid_to", F.expr("timestamp '1998-08-01 00:00:00' - interval 18 months"), at)
    gone = spark.read.parquet(at).groupBy(F.lit(True).alias("archived"), F.date_format("valid_to", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return gone.unionByName(kept.groupBy(F.lit(False).alias("archived"), F.lit(None).cast("string").alias("month")).agg(F.count(F.lit(1)).alias("n")))


_CLERKS = "a AS (SELECT concat('C', o_custkey) AS f, concat('K', o_orderkey % 50) AS t, CAST(epoch(o_orderdate) AS BIGINT) AS d, o_orderkey AS seq FROM orders)"


def _clerk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as links of customers to fifty clerks, in order of their dates."""
    o = A.table(spark, sf_dir, "orders")
    d = F.col("o_orderdate").cast("timestamp")
    order = F.unix_seconds(d) * 10_000_000 + F.col("o_orderkey")
    return o.select(F.lit("SERVED_BY").alias("link_type"), F.concat(F.lit("C"), "o_custkey").alias("from_id"), F.concat(F.lit("K"), F.col("o_orderkey") % 50).alias("to_id"), F.lit(1.0).alias("weight"), d.alias("valid_from"), d.alias("recorded_at"), order.alias("seq"))


def _links_out(links: DataFrame) -> DataFrame:
    return links.select("from_id", "to_id", F.unix_seconds("valid_from").alias("valid_from"), F.unix_seconds("valid_to").alias("valid_to"))


@query(f"WITH RECURSIVE {_CLERKS}, {in_order('t', 'x.f <> n.f')} SELECT f AS from_id, t AS to_id, d AS valid_from, until AS valid_to FROM out")
def link_one_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clerk has one customer at a time: half of the links are there before, the other half come on top of them."""
    a = _clerk_links(spark, sf_dir)
    middle = F.col("valid_from") < F.expr("timestamp '1995-06-01 00:00:00'")
    before = bt.link_objects(a.where(middle), "ONE_TO_MANY")
    return _links_out(bt.link_objects(a.where(~middle), "ONE_TO_MANY", state=before))


@query(f"WITH RECURSIVE {_CLERKS}, {in_order('1', '(x.f = n.f) <> (x.t = n.t)')} SELECT f AS from_id, t AS to_id, d AS valid_from, until AS valid_to FROM out")
def link_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clerk has one customer and a customer one clerk at a time."""
    return _links_out(bt.link_objects(_clerk_links(spark, sf_dir), "ONE_TO_ONE"))


@query(f"""WITH {_CLERKS}, b AS (SELECT f, t, d FROM a UNION ALL SELECT t, f, d FROM a) SELECT f AS from_id, t AS to_id, min(d) AS valid_from, CAST(NULL AS BIGINT) AS valid_to FROM b GROUP BY 1, 2""")
def link_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links both ways, each made once."""
    return _links_out(bt.link_objects(_clerk_links(spark, sf_dir), "MANY_TO_MANY", symmetric=True))


@query("SELECT p_partkey AS part, concat('EX:', p_partkey) AS ref, CASE WHEN p_partkey % 5 = 0 THEN 'UNKNOWN_INSTRUMENT' WHEN p_partkey % 5 = 1 THEN 'not EXCHANGE:SYMBOL' END AS reason, CASE WHEN p_partkey % 5 > 1 THEN p_brand END AS base_asset FROM part")
def find_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.table(spark, sf_dir, "part")
    there = p.where("p_partkey % 5 <> 0").select(F.lit("EX").alias("exchange"), F.col("p_partkey").cast("string").alias("symbol"), F.col("p_brand").alias("base_asset"))
    asked = p.select(F.when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("EX"), F.col("p_partkey"))).otherwise(F.concat(F.lit("EX:"), F.col("p_partkey"))).alias("ref"))
    out = registers.find_instruments(registers.list_instruments(there), asked)
    part = F.regexp_extract("ref", r"(\d+)$", 1).cast("long")
    return out.select(part.alias("part"), F.concat(F.lit("EX:"), part).alias("ref"), "reason", "base_asset")


@query("SELECT name, url FROM (SELECT s_name AS name, concat('https://', s_suppkey) AS url, s_suppkey AS k FROM supplier) WHERE k % 4 <> 0")
def enabled_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = A.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("https://"), "s_suppkey").alias("url"), (F.col("s_suppkey") % 4 != 0).alias("enabled"))
    return registers.enabled_feeds(f).select("name", "url")


@query("""WITH c AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 13 <> 0)
SELECT 'tags' AS property, 2 * count(*) AS open_values FROM c UNION ALL SELECT 'name', count(*) FROM c UNION ALL SELECT 'segment', count(*) FROM c UNION ALL SELECT 'balance', count(*) FROM c WHERE k % 11 <> 0""")
def open_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = registers.open_value_counts(A.objects(spark, sf_dir), A.object_values(spark, sf_dir))
    return out.where("type = 'Customer'").select("property", "open_values")


@query("SELECT o_orderkey AS commit_id, CAST(epoch(CASE WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '1999-01-01' ELSE o_orderdate END) AS BIGINT) AS recorded_at, o_orderkey % 3 <> 0 AND o_orderdate < TIMESTAMP '1999-01-01' AS backdated FROM orders")
def commit_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third commit declares no time of its own."""
    o = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit_id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate").cast("timestamp")).alias("declared_at"))
    c = registers.open_commits(o, F.expr("timestamp '1999-01-01 00:00:00'"))
    return registers.record(o.select("commit_id"), c).join(c.select("commit_id", "backdated"), "commit_id").select("commit_id", F.unix_seconds("recorded_at").alias("recorded_at"), "backdated")


@query("SELECT CASE WHEN c_custkey % 2 = 0 THEN 'CREATE_OBJECT' ELSE 'DELETE_OBJECT' END AS op, concat('C', c_custkey) AS object_id FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 13 <> 0 UNION ALL SELECT 'DELETE_OBJECT', concat('C', c_custkey) FROM customer WHERE c_custkey % 26 = 0")
def object_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd customers are there before and then deleted, even ones are made, some of them deleted already."""
    o = A.objects(spark, sf_dir).where("type = 'Customer'")
    odd = F.substring("object_id", 2, 20).cast("long") % 2 == 1
    after = bt.delete_objects(o, o.where(odd).select("object_id", F.expr("timestamp '1999-01-01 00:00:00'").alias("at")))
    return bt.object_log(o.where(odd), after)


@query("SELECT 'ADD_LINK' AS op, concat('C', c_custkey) AS from_id FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'CLOSE_LINK', concat('C', c_custkey) FROM customer WHERE c_custkey % 14 = 0 OR (c_custkey % 2 = 1 AND c_custkey % 7 <> 0)")
def link_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd customers' links are there before and then ended, even ones' are added, some of them ended already."""
    links = A.links(spark, sf_dir).where("from_id LIKE 'C%'")
    odd = F.substring("from_id", 2, 20).cast("long") % 2 == 1
    after = bt.unlink_objects(links, links.where(odd).select("link_type", "from_id", "to_id", F.expr("timestamp '1999-01-01 00:00:00'").alias("until")))
    return bt.link_log(links.where(odd), after).select("op", "from_id")


@query("SELECT concat('EX:', p_partkey) AS object_id, unnest(['base_asset', 'status']) AS property, unnest([p_brand, 'TRADING']) AS value FROM part")
def instrument_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.table(spark, sf_dir, "part")
    none = F.lit(None).cast("double")
    specs = p.select(F.lit("EX").alias("exchange"), F.col("p_partkey").alias("symbol"), F.col("p_brand").alias("base_asset"), F.lit(None).cast("string").alias("quote_asset"), F.lit("TRADING").alias("status"), none.alias("tick_size"), none.alias("step_size"))
    return B.instrument_assertions(specs, F.expr("timestamp '2026-01-01 00:00:00'")).select("object_id", "property", "value")


@query("""WITH c AS (SELECT c_custkey AS k, TIMESTAMP '1997-01-01' + to_days(CAST(c_custkey % 700 AS INTEGER)) AS since, TIMESTAMP '1997-01-01' + to_days(CAST(c_custkey % 300 AS INTEGER)) AS linked, c_nationkey FROM customer), t AS (SELECT TIMESTAMP '1998-06-01' AS t)
SELECT concat('C', k) AS object_id, CASE WHEN k % 3 = 0 THEN concat('Customer#', k) ELSE concat('X:C', k) END AS title, CASE WHEN linked <= t AND (k % 7 <> 0 OR t < linked + INTERVAL 100 DAY) THEN concat('N', c_nationkey) END AS place
FROM c, t WHERE since + to_days(CAST(k % 5 AS INTEGER)) <= t AND (k % 13 <> 0 OR t < since + INTERVAL 400 DAY)""")
def objects_with_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as of a day with inherited titles, which a third of them have, and where they were located."""
    t = F.expr("timestamp '1998-06-01 00:00:00'")
    o = A.objects(spark, sf_dir)
    v = A.object_values(spark, sf_dir).where("property = 'name' AND object_id LIKE 'C%' AND CAST(substring(object_id, 2) AS long) % 3 = 0").withColumn("value", F.concat(F.lit("Customer#"), F.substring("object_id", 2, 20)))
    titles = spark.createDataFrame([("Customer", "label", 1), ("Customer", "name", 0)], "type string, property string, depth int")
    places = A.places(spark, sf_dir).select("object_id", F.lit("Place").alias("type"), F.col("object_id").alias("external_id"), F.expr("timestamp '1990-01-01 00:00:00'").alias("exists_from"), F.expr("timestamp '1990-01-01 00:00:00'").alias("recorded_at"), F.lit(None).cast("timestamp").alias("deleted_at"))
    out = bt.objects_as_of(o.unionByName(places), v, t, titles=titles, links=A.links(spark, sf_dir))
    place = F.try_element_at(F.try_element_at("links", F.lit("LOCATED_IN")), F.lit(1))["to_external_id"]
    return out.where("object_id LIKE 'C%'").select("object_id", "title", place.alias("place"))
