"""Queries of bulk writes that repeat keys and come late: lists, closings, retractions and links, as if one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronark.operators import bitemporal as bt
from chronark.plans import adapters as A
from chronark.plans.registry import query

# Each order writes its customer's list, recorded in order of order keys, whatever its date.
_WRITES = """w AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey AS q, CAST(epoch(o_orderdate) AS BIGINT) AS s,
  CASE WHEN o_orderkey % 7 = 0 THEN [] WHEN o_orderkey % 3 = 0 THEN [concat('P', o_orderkey % 4)] ELSE [concat('P', o_orderkey % 4), concat('S', o_orderkey % 2)] END AS e FROM orders)"""
_ROW = "STRUCT(o BIGINT, v VARCHAR, f BIGINT, t BIGINT, r BIGINT)"
_LISTS = f"""WITH RECURSIVE {_WRITES}, s AS (
  SELECT k, CAST(0 AS BIGINT) AS n, CAST([] AS {_ROW}[]) AS rows, CAST([] AS BIGINT[]) AS refused FROM w GROUP BY k
  UNION ALL
  SELECT k, n, CASE WHEN same OR clash THEN rows ELSE list_concat(after, list_transform(range(len(e)), lambda i: CAST({{'o': i, 'v': e[i + 1], 'f': s, 't': NULL, 'r': NULL}} AS {_ROW}))) END,
    CASE WHEN NOT same AND clash THEN list_append(refused, q) ELSE refused END
  FROM (SELECT *, len(list_filter(after, lambda x: x.r IS NULL AND x.o < len(e) AND (x.t IS NULL OR x.t > s))) > 0 AS clash
    FROM (SELECT *, list_transform(rows, lambda x: CASE WHEN x.r IS NULL AND x.o < greatest(len(opened), len(e)) AND x.f < s AND (x.t IS NULL OR x.t > s) THEN CAST({{'o': x.o, 'v': x.v, 'f': x.f, 't': s, 'r': NULL}} AS {_ROW})
        WHEN x.r IS NULL AND x.o < greatest(len(opened), len(e)) AND x.f = s AND x.t IS NULL THEN CAST({{'o': x.o, 'v': x.v, 'f': x.f, 't': NULL, 'r': q}} AS {_ROW}) ELSE x END) AS after,
        list_transform(opened, lambda x: x.v) = e AS same
      FROM (SELECT s.k, w.n, rows, refused, w.q, w.s, w.e, list_sort(list_filter(rows, lambda x: x.r IS NULL AND x.t IS NULL)) AS opened FROM s JOIN w ON w.k = s.k AND w.n = s.n + 1)))),
done AS (SELECT k, arg_max(rows, n) AS rows, arg_max(refused, n) AS refused FROM s GROUP BY k)"""


def _list_writes(spark: SparkSession, sf_dir: str) -> bt.Applied:
    o, key = A.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    put = lambda prefix, n: F.concat(F.lit(prefix), key % n)
    elements = F.when(key % 7 == 0, F.array().cast("array<string>")).when(key % 3 == 0, F.array(put("P", 4))).otherwise(F.array(put("P", 4), put("S", 2)))
    writes = o.select(F.col("o_custkey").alias("object_id"), F.lit("tags").alias("property"), elements.alias("elements"), F.col("o_orderdate").cast("timestamp").alias("valid_from"), F.timestamp_seconds(key).alias("recorded_at"), key.alias("seq"))
    state = A.price_values(spark, sf_dir).select(*bt.STATE).withColumn("value", F.col("value").cast("string")).where("property = 'tags'")
    return bt.apply_lists(state, writes)


@query(f"""{_LISTS} SELECT k AS object_id, x.o AS ordinal, x.v AS value, x.f AS valid_from, x.t AS valid_to, x.r AS retracted_at, CAST(NULL AS VARCHAR) AS reason FROM (SELECT k, unnest(rows) AS x FROM done)
UNION ALL SELECT k, i, e[i + 1], s, NULL, NULL, 'TEMPORAL_CONFLICT' FROM (SELECT k, s, e, unnest(range(len(e))) AS i FROM done JOIN w USING (k) WHERE list_contains(refused, q))""")
def list_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten lists a customer, many of them late: what each leaves, and those refused."""
    done = _list_writes(spark, sf_dir)
    seconds = lambda c: F.unix_seconds(c).alias(c)
    out = done.state.select("object_id", F.col("ordinal").cast("long").alias("ordinal"), "value", seconds("valid_from"), seconds("valid_to"), seconds("retracted_at"), F.lit(None).cast("string").alias("reason"))
    none = F.lit(None).cast("long")
    return out.unionByName(done.rejects.select("object_id", F.col("ordinal").cast("long").alias("ordinal"), "value", seconds("valid_from"), none.alias("valid_to"), none.alias("retracted_at"), "reason"))


@query(f"""{_LISTS}, x AS (SELECT k, unnest(rows) AS x FROM done)
SELECT k AS object_id, op, CAST(count(*) AS BIGINT) AS n FROM (SELECT k, 'SET_PROPERTY' AS op FROM x UNION ALL SELECT k, 'CLOSE_PROPERTY' FROM x WHERE x.t IS NOT NULL UNION ALL SELECT k, 'RETRACT_PROPERTY' FROM x WHERE x.r IS NOT NULL) GROUP BY 1, 2""")
def property_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lists set, ended and retracted, by customer."""
    return _list_writes(spark, sf_dir).log.groupBy("object_id", "op").agg(F.sum("n").alias("n"))


@query("""WITH v AS (SELECT o_custkey AS object_id, o_orderkey AS id, o_orderdate AS f, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS t, o_orderkey % 17 = 0 AS gone FROM orders),
c AS (SELECT o_custkey AS object_id, o_orderkey AS seq, o_orderdate + to_days(CAST(o_orderkey % 400 AS INTEGER)) AS until FROM orders WHERE o_custkey % 3 <> 0), r AS (SELECT object_id, arg_min(until, seq) AS retraction FROM c WHERE object_id % 3 = 1 GROUP BY 1)
SELECT object_id, id, CAST(epoch(CASE WHEN t IS NULL AND NOT gone AND object_id % 3 = 2 THEN (SELECT arg_min(until, seq) FROM c WHERE c.object_id = v.object_id AND until > v.f) ELSE t END) AS BIGINT) AS valid_to,
  CAST(epoch(CASE WHEN gone THEN f + INTERVAL 40 DAY WHEN t IS NULL AND object_id % 3 = 1 THEN retraction END) AS BIGINT) AS retracted_at FROM v LEFT JOIN r USING (object_id)""")
def close_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order closes its customer's price, or retracts it: of the many ends of a customer the first by order key that fits counts."""
    named = A.price_values(spark, sf_dir).withColumn("value", F.col("commit_id")).select(*bt.STATE)
    o = A.table(spark, sf_dir, "orders")
    ends = o.select(F.col("o_custkey").alias("object_id"), F.lit("price").alias("property"), (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.col("o_orderkey") % 400)).alias("until"), F.col("o_orderkey").alias("seq"))
    closed = bt.close_properties(named, ends.where("object_id % 3 = 2"))
    out = bt.retract_properties(closed, ends.where("object_id % 3 = 1").withColumnRenamed("until", "at"))
    return out.select("object_id", F.col("value").cast("long").alias("id"), F.unix_seconds("valid_to").alias("valid_to"), F.unix_seconds("retracted_at").alias("retracted_at"))


def _folded(group: str, order: str, other: str) -> str:
    """SQL of links that compete for ``group`` only, one after another: (f, t, d, until, reason)."""
    link = "STRUCT(f VARCHAR, t VARCHAR, d BIGINT, until BIGINT)"
    return f"""n AS (SELECT f, t, d, {group} AS g, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS n FROM a),
s AS (SELECT g, CAST(0 AS BIGINT) AS n, CAST([] AS {link}[]) AS links, CAST([] AS BIGINT[]) AS refused FROM n GROUP BY g
  UNION ALL
  SELECT g, n, CASE WHEN there OR clash THEN links ELSE list_append(after, CAST({{'f': f, 't': t, 'd': d, 'until': NULL}} AS {link})) END, CASE WHEN clash AND NOT there THEN list_append(refused, n) ELSE refused END
  FROM (SELECT *, len(list_filter(after, lambda x: x.f = f AND x.t = t AND (x.until IS NULL OR x.until > d))) > 0 AS clash
    FROM (SELECT s.g, n.n, f, t, d, links, refused, len(list_filter(links, lambda x: x.f = n.f AND x.t = n.t AND x.until IS NULL)) > 0 AS there,
      list_transform(links, lambda x: CASE WHEN x.until IS NULL AND x.d < n.d AND x.{other} <> n.{other} THEN CAST({{'f': x.f, 't': x.t, 'd': x.d, 'until': n.d}} AS {link}) ELSE x END) AS after
      FROM s JOIN n ON n.g = s.g AND n.n = s.n + 1))),
done AS (SELECT g, arg_max(links, n) AS links, arg_max(refused, n) AS refused FROM s GROUP BY g),
out AS (SELECT x.f AS f, x.t AS t, x.d AS d, x.until AS until, CAST(NULL AS VARCHAR) AS reason FROM (SELECT unnest(links) AS x FROM done)
  UNION ALL SELECT f, t, d, NULL, 'TEMPORAL_CONFLICT' FROM done JOIN n USING (g) WHERE list_contains(refused, n.n))"""


def in_order(group: str, competes: str) -> str:
    """SQL of links whose begin never decreases, one after another: (f, t, d, until). ``competes`` is on an open link x and the new one n."""
    link = "STRUCT(f VARCHAR, t VARCHAR, d BIGINT, until BIGINT)"
    return f"""n AS MATERIALIZED (SELECT f, t, d, {group} AS g, row_number() OVER (PARTITION BY {group} ORDER BY d, seq) AS n FROM a),
s AS (SELECT g, CAST(0 AS BIGINT) AS n, CAST([] AS {link}[]) AS opened, CAST([] AS {link}[]) AS closed FROM n GROUP BY g
  UNION ALL
  SELECT g, n, CASE WHEN there THEN opened ELSE list_append(list_filter(opened, lambda x: NOT (x.d < d AND ({competes.replace("n.", "")}))), CAST({{'f': f, 't': t, 'd': d, 'until': NULL}} AS {link})) END,
    CASE WHEN there THEN [] ELSE list_transform(list_filter(opened, lambda x: x.d < d AND ({competes.replace("n.", "")})), lambda x: CAST({{'f': x.f, 't': x.t, 'd': x.d, 'until': d}} AS {link})) END
  FROM (SELECT s.g, n.n, n.f, n.t, n.d, opened, len(list_filter(opened, lambda x: x.f = n.f AND x.t = n.t)) > 0 AS there FROM s JOIN n ON n.g = s.g AND n.n = s.n + 1)),
out AS (SELECT x.f AS f, x.t AS t, x.d AS d, x.until AS until FROM (SELECT unnest(closed) AS x FROM s UNION ALL SELECT unnest(o) FROM (SELECT arg_max(opened, n) AS o FROM s GROUP BY g)))"""


_SHOWN = "SELECT f AS from_id, t AS to_id, d AS valid_from, until AS valid_to, reason FROM out"


def _order_links(spark: SparkSession, sf_dir: str, clerks: int) -> DataFrame:
    o = A.table(spark, sf_dir, "orders")
    clerk = F.concat(F.lit("K"), F.col("o_orderkey") % clerks)
    return o.select(F.lit("SERVED_BY").alias("link_type"), F.concat(F.lit("C"), "o_custkey").alias("from_id"), clerk.alias("to_id"), F.lit(1.0).alias("weight"), F.col("o_orderdate").cast("timestamp").alias("valid_from"), F.timestamp_seconds("o_orderkey").alias("recorded_at"), F.col("o_orderkey").alias("seq"))


def _all_links(done: bt.Applied) -> DataFrame:
    cols = lambda df, until, reason: df.select("from_id", "to_id", F.unix_seconds("valid_from").alias("valid_from"), until.alias("valid_to"), reason.alias("reason"))
    out = cols(done.state, F.unix_seconds("valid_to"), F.lit(None).cast("string"))
    return out.unionByName(cols(done.rejects, F.lit(None).cast("long"), F.col("reason")))


@query(f"WITH RECURSIVE a AS (SELECT concat('C', o_custkey) AS f, concat('K', o_orderkey % 6) AS t, CAST(epoch(o_orderdate) AS BIGINT) AS d, o_orderkey AS seq FROM orders), {_folded('f', 'seq', 't')} {_SHOWN}")
def link_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer has one clerk at a time; links are recorded in order of order keys, so most come late."""
    return _all_links(bt.apply_links(_order_links(spark, sf_dir, 6), "MANY_TO_ONE"))


@query(f"""WITH RECURSIVE a AS (SELECT concat('C', o_custkey) AS f, concat('K', o_orderkey % 400) AS t, CAST(epoch(o_orderdate) AS BIGINT) AS d, o_orderkey AS seq FROM orders), {_folded('t', 'seq', 'f')} {_SHOWN}""")
def link_late_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clerk has one customer at a time; the first half of the orders is there before the rest is written."""
    links = _order_links(spark, sf_dir, 400)
    middle = links.agg(F.max("seq")).first()[0] // 2
    before = bt.apply_links(links.where(F.col("seq") <= middle), "ONE_TO_MANY")
    after = bt.apply_links(links.where(F.col("seq") > middle), "ONE_TO_MANY", state=before.state)
    return _all_links(bt.Applied(after.state, before.rejects.unionByName(after.rejects)))


@query("SELECT concat('C', o_custkey) AS from_id, CASE WHEN o_orderkey % 4 = 0 THEN 'SELF_LINK' END AS reason, count(*) AS n FROM (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT o_custkey, min(o_orderkey) * 4 + 1 FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY o_custkey) GROUP BY 1, 2")
def link_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth order links its customer to itself, which is refused; the others assert one link again and again."""
    links = _order_links(spark, sf_dir, 1)
    done = bt.apply_links(links.withColumn("to_id", F.when(F.col("seq") % 4 == 0, F.col("from_id")).otherwise(F.col("to_id"))), "MANY_TO_MANY")
    return done.state.select("from_id", F.lit(None).cast("string").alias("reason")).unionByName(done.rejects.select("from_id", "reason")).groupBy("from_id", "reason").agg(F.count(F.lit(1)).alias("n"))
