"""The driver's tables in the shapes that the operators take (bars, property values, objects, links, news, vintages, calls)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronark.functions import text
from chronark.operators.query import Catalog, Property


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, timeframe: str, step: int) -> DataFrame:
    """Event values as bars: an instrument for each event type, and ALL. Some bars are not final."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("decimal(24,12)").alias("v"))
    e = e.withColumn("instrument_id", F.explode(F.array(F.lit("ALL"), F.col("event_type")))).withColumn("o", F.floor(F.unix_seconds("ts") / step) * step)
    b = e.groupBy("instrument_id", "o").agg(
        F.min_by("v", "event_id").alias("open"), F.max("v").alias("high"), F.min("v").alias("low"), F.max_by("v", "event_id").alias("close"),
        F.count(F.lit(1)).cast("decimal(30,12)").alias("volume"), F.sum("v").cast("decimal(30,12)").alias("quote_volume"), F.count(F.lit(1)).cast("int").alias("trade_count"),
        F.sum(F.when(F.col("user_id") % 2 == 0, F.col("v")).otherwise(0)).cast("decimal(30,12)").alias("taker_buy_base"),
    )
    return b.select("instrument_id", F.lit(timeframe).alias("timeframe"), F.timestamp_seconds("o").alias("open_time"), F.timestamp_millis((F.col("o") + step) * 1000 - 1).alias("close_time"), "open", "high", "low", "close", "volume", "quote_volume", "trade_count", "taker_buy_base", ((F.col("o") / step) % 37 != 5).alias("is_final"))


def price_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices as a customer's property over time, recorded up to 29 days late."""
    o = table(spark, sf_dir, "orders")
    start = F.col("o_orderdate").cast("timestamp")
    return o.select(
        F.col("o_custkey").alias("object_id"), F.lit("price").alias("property"), F.lit(0).alias("ordinal"), F.col("o_totalprice").cast("decimal(38,12)").alias("value"), F.lit("set").alias("op"),
        start.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), (start + F.make_dt_interval(F.col("o_orderkey") % 30)).alias("recorded_at"), F.col("o_orderkey").alias("seq"),
    )


def price_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property values with closed intervals; every 17th order was retracted 40 days after it began."""
    a = price_assertions(spark, sf_dir)
    nxt = F.lead("valid_from").over(W.partitionBy("object_id").orderBy("valid_from", "seq"))
    rows = a.withColumn("next", nxt)
    return rows.select("object_id", "property", "ordinal", "value", "valid_from", F.col("next").alias("valid_to"), "recorded_at", F.when(F.col("seq") % 17 == 0, F.col("valid_from") + F.expr("interval 40 days")).alias("retracted_at"), F.col("seq").alias("commit_id"))


def catalog() -> Catalog:
    """Party over Customer and Supplier: name, balance, and for customers a segment and tags."""
    c = Catalog({}, {})
    c.define_type("Party", abstract=True)
    c.define_type("Customer", "Party")
    c.define_type("Supplier", "Party")
    c.define_property("Party", Property("name", is_title=True))
    c.define_property("Party", Property("balance", "DECIMAL"))
    c.define_property("Customer", Property("segment", "ENUM"))
    c.define_property("Customer", Property("tags", "STRING", is_list=True))
    return c


def parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(object_id, type, external_id, created day, name, balance, segment, tags) of customers and suppliers; some have no balance."""
    c = table(spark, sf_dir, "customer").selectExpr("concat('C', c_custkey) AS object_id", "'Customer' AS type", "c_custkey AS key", "c_name AS name", "CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_acctbal AS decimal(38,12)) END AS balance", "c_mktsegment AS segment", "array(concat('N', c_nationkey), concat('S', c_custkey % 3)) AS tags")
    s = table(spark, sf_dir, "supplier").selectExpr("concat('S', s_suppkey) AS object_id", "'Supplier' AS type", "s_suppkey AS key", "s_name AS name", "CAST(s_acctbal AS decimal(38,12)) AS balance", "CAST(NULL AS string) AS segment", "CAST(NULL AS array<string>) AS tags")
    day = F.expr("timestamp_seconds(852076800 + 86400 * (key % 700))")
    return c.unionByName(s).withColumn("external_id", F.concat(F.lit("X:"), "object_id")).withColumn("since", day)


def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parties(spark, sf_dir).select("object_id", "type", "external_id", F.coalesce("name", "external_id").alias("title"), F.col("since").alias("updated_at"), "name", "balance", "segment", "tags")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object instances; every 13th was deleted 400 days after it began."""
    p = parties(spark, sf_dir)
    return p.select("object_id", "type", "external_id", F.col("since").alias("exists_from"), (F.col("since") + F.make_dt_interval(F.col("key") % 5)).alias("recorded_at"), F.when(F.col("key") % 13 == 0, F.col("since") + F.expr("interval 400 days")).alias("deleted_at"))


def object_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property values of the parties as text; balances are doubled 300 days later."""
    p = parties(spark, sf_dir)
    later = F.col("since") + F.expr("interval 300 days")
    none = F.lit(None).cast("timestamp")
    one = lambda name, ordinal, value, start, end: F.struct(F.lit(name).alias("property"), F.lit(ordinal).alias("ordinal"), value.cast("string").alias("value"), start.alias("valid_from"), end.alias("valid_to"))
    each = F.array(
        one("name", 0, F.col("name"), F.col("since"), none), one("balance", 0, F.col("balance"), F.col("since"), later), one("balance", 0, F.col("balance") * 2, later, none),
        one("segment", 0, F.col("segment"), F.col("since"), none), one("tags", 0, F.col("tags")[0], F.col("since"), none), one("tags", 1, F.col("tags")[1], F.col("since"), none),
    )
    rows = p.select("object_id", "key", F.explode(each).alias("v")).select("object_id", "key", "v.*").where("value IS NOT NULL")
    return rows.select("object_id", "property", "ordinal", "value", "valid_from", "valid_to", (F.col("valid_from") + F.make_dt_interval(F.col("key") % 5)).alias("recorded_at"), none.alias("retracted_at"), F.xxhash64("object_id", "valid_from").alias("commit_id"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOCATED_IN (party to nation, nation to region); every 7th customer's link has ended."""
    none = F.lit(None).cast("timestamp")
    c = table(spark, sf_dir, "customer").selectExpr("'LOCATED_IN' AS link_type", "concat('C', c_custkey) AS from_id", "concat('N', c_nationkey) AS to_id", "c_custkey AS k")
    s = table(spark, sf_dir, "supplier").selectExpr("'LOCATED_IN' AS link_type", "concat('S', s_suppkey) AS from_id", "concat('N', s_nationkey) AS to_id", "1 AS k")
    n = table(spark, sf_dir, "nation").selectExpr("'PART_OF' AS link_type", "concat('N', n_nationkey) AS from_id", "concat('R', n_regionkey) AS to_id", "1 AS k")
    start = F.expr("timestamp_seconds(852076800 + 86400 * (k % 300))")
    return c.unionByName(s).unionByName(n).select("link_type", "from_id", "to_id", F.lit(1.0).alias("weight"), start.alias("valid_from"), F.when((F.col("k") % 7 == 0), start + F.expr("interval 100 days")).otherwise(none).alias("valid_to"), start.alias("recorded_at"), none.alias("retracted_at"), F.col("k").cast("long").alias("commit_id"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets as objects."""
    n = table(spark, sf_dir, "nation").selectExpr("concat('N', n_nationkey) AS object_id", "n_name AS external_id")
    r = table(spark, sf_dir, "region").selectExpr("concat('R', r_regionkey) AS object_id", "r_name AS external_id")
    return n.unionByName(r).withColumn("deleted_at", F.lit(None).cast("timestamp"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as news: the first sentence is the headline, what follows the summary, the whole text the body; a minute apart.
    What is compared and analysed is headline and summary."""
    d = table(spark, sf_dir, "documents")
    title = F.regexp_extract("text", r"^[^.\n]*", 0)
    rows = d.select(F.col("doc_id").alias("seq"), F.col("source").alias("feed_id"), F.concat(F.lit("https://www.Example.com/n/"), F.col("doc_id") % 700, F.lit("/?utm_source=x&b=2&a=1")).alias("url"), title.alias("title"), F.col("text").alias("body"), F.timestamp_seconds(F.lit(1767225600) + F.col("doc_id") * 60).alias("published_at"), F.timestamp_seconds(F.lit(1767225660) + F.col("doc_id") * 60).alias("seen_at"))
    rows = rows.withColumn("summary", F.substr("body", F.length("title") + 1))
    return _with_tokens(rows)


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same news without summaries, as many feeds have them: headlines alone are compared."""
    return _with_tokens(news(spark, sf_dir).drop("normalized", "tokens").withColumn("summary", F.lit(None).cast("string")))


def _with_tokens(rows: DataFrame) -> DataFrame:
    return rows.withColumn("normalized", text.normalize(text.similarity_text(F.col("title"), F.col("summary")))).withColumn("tokens", text.tokens(F.col("normalized")))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as revised figures: a customer's orders of one year are vintages of that year's figure; every 23rd is unreadable."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").cast("string").alias("series"), F.trunc(F.col("o_orderdate").cast("date"), "year").alias("date"), F.when(F.col("o_orderkey") % 23 == 0, ".").otherwise(F.col("o_totalprice").cast("string")).alias("value"), F.col("o_orderdate").cast("date").alias("realtime_start"), F.col("o_orderkey").alias("k"))
    nxt = F.lead("realtime_start").over(W.partitionBy("series", "date").orderBy("realtime_start", "k"))
    return rows.select("series", "date", "value", "realtime_start", F.coalesce(F.date_sub(nxt, 1), F.lit("9999-12-31").cast("date")).alias("realtime_end"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as model calls: tokens are a quarter of the characters of the turn before and of the turn."""
    c = table(spark, sf_dir, "conversations")
    before = F.coalesce(F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    rows = c.withColumn("data", before).where("role = 'assistant'")
    t = lambda col: F.floor(F.length(col) / 4).cast("long")
    return rows.select(F.concat_ws("-", "conv_id", "turn").alias("call_id"), F.timestamp_seconds(F.lit(1767225600) + F.col("conv_id") * 7200 + F.col("turn") * 60).alias("occurred_at"), F.concat(F.lit("P"), F.col("conv_id") % 4).alias("purpose"), F.lit("Answer.").alias("instruction"), "data", F.col("text").alias("response_raw"), t(F.col("data")).alias("input_tokens"), (t(F.col("data")) - t(F.col("data")) % 2).alias("half"), t(F.coalesce("text", F.lit(""))).alias("output_tokens")).withColumn("cached_input_tokens", (F.col("half") / 2).cast("long")).drop("half")
