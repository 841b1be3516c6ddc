"""Queries over bitemporal facts, objects and links."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronark.operators import bitemporal as bt
from chronark.operators import query as qb
from chronark.operators import temporal
from chronark.plans import adapters as A
from chronark.plans.registry import query
from chronark.plans.write_queries import in_order

T = "timestamp '1998-01-01 00:00:00'"
_ASSERTED = """
a AS (SELECT o_custkey AS object_id, CAST(o_totalprice AS DECIMAL(18,4)) AS value, o_orderdate AS valid_from, o_orderkey AS seq,
  o_orderdate + to_days(CAST(o_orderkey % 30 AS INTEGER)) AS recorded_at FROM orders),
v AS (SELECT *, lead(valid_from) OVER (PARTITION BY object_id ORDER BY valid_from, seq) AS valid_to,
  CASE WHEN seq % 17 = 0 THEN valid_from + INTERVAL 40 DAY END AS retracted_at FROM a)"""
_KNOWN = "valid_from <= {t} AND (valid_to IS NULL OR {t} < valid_to) AND recorded_at <= {t} AND (retracted_at IS NULL OR retracted_at > {t})"


def _out(df: DataFrame, *cols: str) -> DataFrame:
    kinds = dict(df.dtypes)
    conv = lambda c: F.unix_seconds(c).alias(c) if kinds[c].startswith("timestamp") else F.col(c).cast("double").alias(c) if kinds[c].startswith("decimal") else F.col(c)
    return df.select(*map(conv, cols))


@query(f"WITH {_ASSERTED} SELECT object_id, CAST(value AS DOUBLE) AS value, CAST(epoch(valid_from) AS BIGINT) AS valid_from FROM v WHERE {_KNOWN.format(t=T)}")
def values_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: what was known at one instant, for every object in one plan."""
    return _out(A.price_values(spark, sf_dir).where(temporal.known_at(F.expr(T))), "object_id", "value", "valid_from")


@query(f"WITH {_ASSERTED} SELECT object_id, CAST(value AS DOUBLE) AS value FROM v WHERE valid_to IS NULL AND retracted_at IS NULL")
def current_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(bt.current_values(A.price_values(spark, sf_dir)), "object_id", "value")


@query(f"WITH {_ASSERTED} SELECT object_id, CAST(value AS DOUBLE) AS value FROM v WHERE valid_from <= {T} AND (valid_to IS NULL OR {T} < valid_to) AND retracted_at IS NULL")
def values_valid_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(A.price_values(spark, sf_dir).where(temporal.valid_at(F.expr(T))), "object_id", "value")


@query(f"""WITH {_ASSERTED}, i AS (SELECT DISTINCT o_custkey AS object_id, date_trunc('quarter', o_orderdate) + INTERVAL 17 DAY AS moment FROM orders)
SELECT object_id, CAST(epoch(moment) AS BIGINT) AS "at", CAST(value AS DOUBLE) AS value FROM i JOIN v USING (object_id) WHERE {_KNOWN.format(t='moment')}""")
def values_as_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer at 17 days into every quarter in which it ordered."""
    o = A.table(spark, sf_dir, "orders")
    at = o.select(F.col("o_custkey").alias("object_id"), (F.date_trunc("quarter", F.col("o_orderdate").cast("timestamp")) + F.expr("interval 17 days")).alias("at")).distinct()
    return _out(temporal.as_of_many(A.price_values(spark, sf_dir), at, ["object_id"]), "object_id", "at", "value")


@query(f"""WITH {_ASSERTED}, o AS (SELECT object_id, valid_from, seq, recorded_at, valid_from + to_days(CAST(seq % 50 AS INTEGER)) AS valid_to FROM a WHERE seq % 17 <> 0),
h AS (SELECT *, max(valid_to) OVER (PARTITION BY object_id ORDER BY valid_from, recorded_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM o)
SELECT count(*) AS overlapping, count(DISTINCT object_id) AS objects FROM h WHERE valid_from < m""")
def detect_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = A.price_values(spark, sf_dir).withColumn("valid_to", F.col("valid_from") + F.make_dt_interval((F.col("commit_id") % 50).cast("int")))
    return temporal.detect_overlaps(v, ["object_id"]).agg(F.count(F.lit(1)).alias("overlapping"), F.count_distinct("object_id").alias("objects"))


@query(f"""WITH {_ASSERTED} SELECT object_id, CAST(value AS DOUBLE) AS value, CAST(epoch(valid_from) AS BIGINT) AS valid_from, o_orderpriority AS actor, o_orderstatus AS reason,
  valid_to IS NULL AS is_open, retracted_at IS NOT NULL AS is_retracted FROM v JOIN orders ON o_orderkey = seq""")
def property_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = A.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS commit_id", "o_orderpriority AS actor", "o_orderstatus AS reason")
    return _out(bt.history(A.price_values(spark, sf_dir), commits), "object_id", "value", "valid_from", "actor", "reason", "is_open", "is_retracted")


@query("""WITH a AS (SELECT o_custkey AS object_id, CAST(o_totalprice AS DECIMAL(18,4)) AS value, o_orderdate AS valid_from, o_orderkey AS seq FROM orders),
c AS (SELECT *, lag(value) OVER w AS last FROM a WINDOW w AS (PARTITION BY object_id ORDER BY valid_from, seq)),
d AS (SELECT *, lead(valid_from) OVER (PARTITION BY object_id ORDER BY valid_from, seq) AS nxt FROM c WHERE last IS NULL OR last <> value)
SELECT object_id, CAST(value AS DOUBLE) AS value, CAST(epoch(valid_from) AS BIGINT) AS valid_from, CAST(epoch(CASE WHEN nxt > valid_from THEN nxt END) AS BIGINT) AS valid_to,
  CAST(epoch(CASE WHEN nxt = valid_from THEN nxt END) AS BIGINT) AS retracted_at FROM d""")
def set_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk apply of histories in order: windows only."""
    a = A.price_assertions(spark, sf_dir).withColumn("recorded_at", F.col("valid_from"))
    none = spark.createDataFrame([], "object_id long, property string, ordinal int, value decimal(38,12), valid_from timestamp, valid_to timestamp, recorded_at timestamp, retracted_at timestamp")
    return _out(bt.apply_assertions(none, a).state, "object_id", "value", "valid_from", "valid_to", "retracted_at")


_PRICE = "STRUCT(v DOUBLE, f BIGINT, t BIGINT, r BIGINT)"


@query(f"""WITH RECURSIVE {_ASSERTED}, w AS (SELECT object_id AS k, row_number() OVER (PARTITION BY object_id ORDER BY recorded_at, seq) AS n, seq AS q, CAST(epoch(recorded_at) AS BIGINT) AS at_s, CAST(epoch(valid_from) AS BIGINT) AS s, CAST(value AS DOUBLE) AS p FROM a),
o AS (SELECT object_id AS k, list(CAST({{'v': CAST(value AS DOUBLE), 'f': CAST(epoch(valid_from) AS BIGINT), 't': CAST(epoch(valid_to) AS BIGINT), 'r': CAST(epoch(retracted_at) AS BIGINT)}} AS {_PRICE})) AS rows FROM v WHERE object_id % 5 = 0 GROUP BY 1),
s AS (SELECT k, CAST(0 AS BIGINT) AS n, coalesce(rows, CAST([] AS {_PRICE}[])) AS rows, CAST([] AS BIGINT[]) AS refused FROM (SELECT DISTINCT k FROM w) LEFT JOIN o USING (k)
  UNION ALL
  SELECT k, n, CASE WHEN same OR clash THEN rows ELSE list_append(after, CAST({{'v': p, 'f': s, 't': NULL, 'r': NULL}} AS {_PRICE})) END, CASE WHEN NOT same AND clash THEN list_append(refused, q) ELSE refused END
  FROM (SELECT *, len(list_filter(after, lambda x: x.r IS NULL AND (x.t IS NULL OR x.t > s))) > 0 AS clash
    FROM (SELECT *, len(opened) = 1 AND coalesce(opened[1].v = p, false) AS same,
        list_transform(rows, lambda x: CASE WHEN x.r IS NULL AND x.f < s AND (x.t IS NULL OR x.t > s) THEN CAST({{'v': x.v, 'f': x.f, 't': s, 'r': NULL}} AS {_PRICE}) WHEN x.r IS NULL AND x.f = s AND x.t IS NULL THEN CAST({{'v': x.v, 'f': x.f, 't': NULL, 'r': at_s}} AS {_PRICE}) ELSE x END) AS after
      FROM (SELECT s.k, w.n, rows, refused, w.q, w.s, w.p, w.at_s, list_filter(rows, lambda x: x.r IS NULL AND x.t IS NULL) AS opened FROM s JOIN w ON w.k = s.k AND w.n = s.n + 1)))),
done AS (SELECT k, arg_max(rows, n) AS rows, arg_max(refused, n) AS refused FROM s GROUP BY k)
SELECT k AS object_id, x.v AS value, x.f AS valid_from, x.t AS valid_to, x.r AS retracted_at, CAST(NULL AS VARCHAR) AS reason FROM (SELECT k, unnest(rows) AS x FROM done)
UNION ALL SELECT k, p, s, NULL, NULL, 'TEMPORAL_CONFLICT' FROM done JOIN w USING (k) WHERE list_contains(refused, q)""")
def set_properties_unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk apply where records arrive late: out-of-order keys are folded, conflicts named."""
    done = bt.apply_assertions(A.price_values(spark, sf_dir).where("object_id % 5 = 0").select(*bt.STATE), A.price_assertions(spark, sf_dir))
    state = done.state.select("object_id", "value", "valid_from", "valid_to", "retracted_at", F.lit(None).cast("string").alias("reason"))
    refused = done.rejects.select("object_id", "value", "valid_from", "reason")
    return _out(state.unionByName(refused, allowMissingColumns=True), "object_id", "value", "valid_from", "valid_to", "retracted_at", "reason")


@query(f"""WITH {_ASSERTED} SELECT object_id, CAST(value AS DOUBLE) AS value, CAST(epoch(CASE WHEN valid_to IS NULL AND retracted_at IS NULL AND object_id % 2 = 0 AND valid_from < {T} THEN {T} ELSE valid_to END) AS BIGINT) AS valid_to,
  CAST(epoch(CASE WHEN valid_to IS NULL AND retracted_at IS NULL AND object_id % 2 = 1 THEN {T} ELSE retracted_at END) AS BIGINT) AS retracted_at FROM v""")
def close_and_retract(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = A.price_values(spark, sf_dir)
    ids = v.select("object_id", "property").distinct()
    closed = bt.close_properties(v, ids.where("object_id % 2 = 0").withColumn("until", F.expr(T)))
    return _out(bt.retract_properties(closed, ids.where("object_id % 2 = 1").withColumn("at", F.expr(T))), "object_id", "value", "valid_to", "retracted_at")


# objects


_PARTIES = """
p AS (SELECT concat('C', c_custkey) AS object_id, 'Customer' AS type, c_custkey AS key, c_name AS name, CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_acctbal AS DECIMAL(18,4)) END AS balance,
    c_mktsegment AS segment, concat('N', c_nationkey) AS t0, concat('S', c_custkey % 3) AS t1 FROM customer
  UNION ALL SELECT concat('S', s_suppkey), 'Supplier', s_suppkey, s_name, CAST(s_acctbal AS DECIMAL(18,4)), NULL, NULL, NULL FROM supplier),
o AS (SELECT *, TIMESTAMP '1997-01-01' + to_days(CAST(key % 700 AS INTEGER)) AS since FROM p),
x AS (SELECT *, since + to_days(CAST(key % 5 AS INTEGER)) AS rec, CASE WHEN key % 13 = 0 THEN since + INTERVAL 400 DAY END AS gone FROM o)"""
_SHOW = "object_id, name, CAST(balance AS DOUBLE) AS balance"


def _current(spark: SparkSession, sf_dir: str, type_: str, *where: qb.Where, search: str | None = None) -> DataFrame:
    """All that match: the page is a view of it."""
    q = qb.Query(type_, list(where), search=search)
    return _out(qb.query_current(A.projection(spark, sf_dir), q, A.catalog()).matching, "object_id", "name", "balance")


def _filters() -> None:
    cases = {
        "filter_eq": ("Customer", "segment = 'BUILDING'", [("segment", "EQ", "BUILDING")]), "filter_neq": ("Customer", "balance IS DISTINCT FROM 100", [("balance", "NEQ", 100)]),
        "filter_gt": ("Party", "balance > 5000", [("balance", "GT", 5000)]), "filter_gte_lt": ("Party", "balance >= 1000 AND balance < 2000.5", [("balance", "GTE", 1000), ("balance", "LT", "2000.5")]),
        "filter_lte": ("Supplier", "balance <= 1500", [("balance", "LTE", 1500)]), "filter_in": ("Customer", "segment IN ('BUILDING', 'MACHINERY')", [("segment", "IN", ["BUILDING", "MACHINERY"])]),
        "filter_contains": ("Party", "name ILIKE '%001%'", [("name", "CONTAINS", "001")]), "filter_starts_with": ("Party", "name ILIKE 'supplier#00000%'", [("name", "STARTS_WITH", "supplier#00000")]),
        "filter_is_null": ("Customer", "balance IS NULL", [("balance", "IS_NULL", None)]), "filter_is_not_null": ("Customer", "balance IS NOT NULL", [("balance", "IS_NOT_NULL", None)]),
        "list_contains": ("Customer", "t0 = 'N7' OR t1 = 'N7'", [("tags", "CONTAINS", "N7")]),
    }
    for name, (type_, cond, where) in cases.items():

        def f(spark: SparkSession, sf_dir: str, type_=type_, where=where) -> DataFrame:
            return _current(spark, sf_dir, type_, *(qb.Where(*w) for w in where))

        f.__name__ = name
        of = "" if type_ == "Party" else f"type = '{type_}' AND "
        query(f"WITH {_PARTIES} SELECT {_SHOW} FROM p WHERE {of}({cond})")(f)


_filters()


@query(f"WITH {_PARTIES} SELECT {_SHOW} FROM p WHERE name ILIKE '%er#0000000_1%'")
def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wildcards in a search stay wildcards."""
    return _current(spark, sf_dir, "Party", search="er#0000000_1")


@query(f"WITH {_PARTIES} SELECT {_SHOW} FROM p ORDER BY balance DESC NULLS LAST, object_id LIMIT 40 OFFSET 20")
def query_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = qb.Query("Party", order_by=[("balance", False)], limit=40, offset=20)
    return _out(qb.query_current(A.projection(spark, sf_dir), q, A.catalog()).rows, "object_id", "name", "balance")


@query(f"WITH {_PARTIES} SELECT type, count(*) AS total FROM p WHERE balance > 0 GROUP BY type")
def query_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = qb.Query("Party", [qb.Where("balance", "GT", 0)])
    return qb.query_current(A.projection(spark, sf_dir), q, A.catalog()).matching.groupBy("type").agg(F.count(F.lit(1)).alias("total"))


_T2 = "timestamp '1998-06-01 00:00:00'"
_AS_OF = f"""{_PARTIES},
there AS (SELECT *, CASE WHEN {_T2} < since + INTERVAL 300 DAY THEN balance WHEN since + INTERVAL 300 DAY + to_days(CAST(key % 5 AS INTEGER)) <= {_T2} THEN balance * 2 END AS b,
    CASE WHEN type = 'Customer' THEN [t0, t1] END AS tags
  FROM x WHERE since <= {_T2} AND rec <= {_T2} AND (gone IS NULL OR gone > {_T2}))"""


@query(f"WITH {_AS_OF} SELECT object_id, name, CAST(b AS DOUBLE) AS balance FROM there WHERE b > 4000")
def query_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = qb.Query("Party", [qb.Where("balance", "GT", 4000)], as_of=F.expr(_T2))
    return _out(qb.query_as_of(A.objects(spark, sf_dir), A.object_values(spark, sf_dir), q, A.catalog()).matching, "object_id", "name", "balance")


@query(f"WITH {_AS_OF} SELECT object_id, name, CAST(b AS DOUBLE) AS balance FROM there WHERE (t0 ILIKE '%n1%' OR t1 ILIKE '%n1%') AND b IS NOT NULL ORDER BY b, object_id LIMIT 30")
def query_as_of_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = qb.Query("Customer", [qb.Where("tags", "CONTAINS", "n1"), qb.Where("balance", "IS_NOT_NULL")], order_by=[("balance", True)], as_of=F.expr(_T2), limit=30)
    return _out(qb.query_as_of(A.objects(spark, sf_dir), A.object_values(spark, sf_dir), q, A.catalog()).rows, "object_id", "name", "balance")


@query(f"WITH {_AS_OF} SELECT object_id, name AS title, CAST(b AS DOUBLE) AS balance, array_to_string(tags, ',') AS tags FROM there")
def objects_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bt.objects_as_of(A.objects(spark, sf_dir), A.object_values(spark, sf_dir), F.expr(_T2))
    one = lambda n: F.try_element_at("data", F.lit(n))
    return out.select("object_id", "title", F.try_element_at(one("balance"), F.lit(1)).cast("double").alias("balance"), F.array_join(one("tags"), ",").alias("tags"))


@query(f"WITH {_AS_OF} SELECT object_id FROM there WHERE key % 3 = 0")
def snapshot_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.objects(spark, sf_dir)
    s = bt.Snapshot(o, A.object_values(spark, sf_dir), A.links(spark, sf_dir), F.expr(_T2))
    return s.find(o.where(F.substring("object_id", 2, 20).cast("long") % 3 == 0).select("type", "external_id")).select("object_id")


@query(f"WITH {_PARTIES}, l AS (SELECT c_custkey % 7 = 0 AS ended, concat('C', c_custkey) AS i, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT false, concat('S', s_suppkey), n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey) "
       "SELECT object_id, coalesce(name, concat('X:', object_id)) AS title, CAST(CASE WHEN gone IS NULL THEN balance * 2 END AS DOUBLE) AS balance, (SELECT n_name FROM l WHERE i = object_id AND NOT ended) AS place FROM x WHERE gone IS NULL")
def refresh_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projection rebuilt from values and links: live objects, typed columns, title, link summary."""
    places = A.places(spark, sf_dir).select("object_id", "external_id", "deleted_at")
    out = qb.project(A.objects(spark, sf_dir), A.object_values(spark, sf_dir), A.links(spark, sf_dir), A.catalog(), "Customer").select("object_id", "title", "balance")
    more = qb.project(A.objects(spark, sf_dir), A.object_values(spark, sf_dir), A.links(spark, sf_dir), A.catalog(), "Supplier").select("object_id", "title", "balance")
    summary = qb.link_summary(A.links(spark, sf_dir), places)
    both = out.unionByName(more).join(summary, "object_id", "left")
    return both.select("object_id", "title", F.col("balance").cast("double").alias("balance"), F.try_element_at(F.try_element_at("link_summary", F.lit("LOCATED_IN")), F.lit(1)).alias("place"))


@query(f"""WITH l AS (SELECT concat('C', c_custkey) AS from_id, n_name, TIMESTAMP '1997-01-01' + to_days(CAST(c_custkey % 300 AS INTEGER)) AS s, c_custkey % 7 = 0 AS e FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT concat('S', s_suppkey), n_name, TIMESTAMP '1997-01-02', false FROM supplier JOIN nation ON n_nationkey = s_nationkey
  UNION ALL SELECT concat('N', n_nationkey), r_name, TIMESTAMP '1997-01-02', false FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT from_id, n_name AS to_title, CAST(epoch(s) AS BIGINT) AS valid_from FROM l WHERE s <= TIMESTAMP '1997-08-01' AND (NOT e OR TIMESTAMP '1997-08-01' < s + INTERVAL 100 DAY)""")
def links_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = A.places(spark, sf_dir)
    out = bt.links_as_of(A.links(spark, sf_dir), places, places.select("object_id", F.col("external_id").alias("title")), F.expr("timestamp '1997-08-01 00:00:00'"))
    return _out(out, "from_id", "to_title", "valid_from")


@query("SELECT concat('N', n_nationkey) AS from_id, concat('PART_OF=', r_name) AS links FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT concat('S', s_suppkey), concat('LOCATED_IN=', n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey "
       "UNION ALL SELECT concat('C', c_custkey), concat('LOCATED_IN=', n_name) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 7 <> 0")
def group_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = A.places(spark, sf_dir)
    out = bt.group_links(bt.links_as_of(A.links(spark, sf_dir), places, places.select("object_id", F.col("external_id").alias("title")), None))
    return out.select("from_id", F.array_join(F.transform(F.map_entries("links"), lambda e: F.concat_ws("=", e["key"], e["value"]["to_title"][0])), ";").alias("links"))


@query("""WITH c AS (SELECT concat('C', c_custkey) AS s, c_nationkey AS n FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT concat('S', s_suppkey), s_nationkey FROM supplier)
SELECT s AS start_id, s AS object_id, 0 AS hops FROM (SELECT concat('C', c_custkey) AS s FROM customer UNION ALL SELECT concat('S', s_suppkey) FROM supplier)
UNION ALL SELECT s, concat('N', n), 1 FROM c UNION ALL SELECT s, concat('R', n_regionkey), 2 FROM c JOIN nation ON n = n_nationkey""")
def walk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.walk_links(A.links(spark, sf_dir), A.parties(spark, sf_dir).select("object_id"), 2)


@query(f"""WITH RECURSIVE a AS (SELECT o_custkey AS f, o_orderkey % 20 AS t, CAST(epoch(o_orderdate) AS BIGINT) AS d, o_orderkey AS seq FROM orders), {in_order('f', 'x.t <> n.t')}
SELECT CAST(f AS BIGINT) AS from_id, CAST(t AS BIGINT) AS to_id, d AS valid_from, until AS valid_to FROM out""")
def link_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's last used clerk: many to one, the next link closes the one before."""
    o = A.table(spark, sf_dir, "orders")
    d = F.col("o_orderdate").cast("timestamp")
    a = o.select(F.lit("SERVED_BY").alias("link_type"), F.concat(F.lit("C"), "o_custkey").alias("from_id"), F.concat(F.lit("K"), F.col("o_orderkey") % 20).alias("to_id"), F.lit(1.0).alias("weight"), d.alias("valid_from"), d.alias("recorded_at"), F.col("o_orderkey").alias("seq"))
    out = bt.link_objects(a, "MANY_TO_ONE")
    return _out(out.withColumn("from_id", F.substring("from_id", 2, 20).cast("long")).withColumn("to_id", F.substring("to_id", 2, 20).cast("long")), "from_id", "to_id", "valid_from", "valid_to")


@query(f"WITH {_PARTIES} SELECT object_id, CAST(epoch(coalesce(gone, CASE WHEN key % 2 = 0 THEN {_T2} END)) AS BIGINT) AS deleted_at FROM x")
def delete_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.objects(spark, sf_dir)
    even = o.where(F.substring("object_id", 2, 20).cast("long") % 2 == 0).select("object_id", F.expr(_T2).alias("at"))
    return _out(bt.delete_objects(o, even), "object_id", "deleted_at")


@query(f"""WITH {_PARTIES}, r AS (SELECT CASE WHEN key % 10 = 0 THEN 'ABSTRACT_TYPE' WHEN gone IS NULL AND key % 2 = 0 THEN 'DUPLICATE_OBJECT' WHEN name IS NULL OR balance IS NULL THEN 'MISSING_REQUIRED' ELSE 'OK' END AS reason FROM x)
SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def create_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parties created anew: every tenth as the abstract type, even ones already there."""
    p = A.parties(spark, sf_dir)
    new = p.select(F.when(F.col("key") % 10 == 0, "Party").otherwise(F.col("type")).alias("type"), "external_id", F.col("since").alias("valid_from"), F.col("key").alias("seq"))
    there = A.objects(spark, sf_dir).where(F.substring("object_id", 2, 20).cast("long") % 2 == 0)
    types = spark.createDataFrame([("Party", True), ("Customer", False), ("Supplier", False)], "type string, is_abstract boolean")
    required = spark.createDataFrame([(t, n) for t in ("Customer", "Supplier") for n in ("name", "balance")], "type string, property string")
    given = p.select("type", "external_id", F.explode(F.array(F.when(F.col("name").isNotNull(), "name"), F.when(F.col("balance").isNotNull(), "balance"))).alias("property")).where("property IS NOT NULL")
    ok, bad = bt.create_objects(there, new, types, required, given)
    return ok.select(F.lit("OK").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT CASE WHEN p_size > 40 THEN 'MAX' WHEN p_size < 5 THEN 'MIN' END AS a, CASE WHEN p_type NOT IN ('ECONOMY', 'STANDARD') THEN 'ENUM' END AS b,
  CASE WHEN length(p_name) > 9 THEN 'MAX_LENGTH' END AS c, CASE WHEN NOT regexp_full_match(p_name, '[a-z]+ [a-z]+') THEN 'PATTERN' END AS d FROM part)
SELECT violation, count(*) AS n FROM (SELECT unnest([concat('size:', a), concat('type:', b), concat('name:', c), concat('name:', d)]) AS violation FROM v) WHERE length(split_part(violation, ':', 2)) > 0 GROUP BY 1""")
def validate_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = None
    rules = spark.createDataFrame([
        ("Part", "size", "INTEGER", none, none, none, none, 5.0, 40.0), ("Part", "type", "ENUM", ["ECONOMY", "STANDARD"], none, none, none, none, none), ("Part", "name", "STRING", none, 1, 9, "[a-z]+ [a-z]+", none, none),
    ], "type string, property string, data_type string, enum_values array<string>, min_length int, max_length int, pattern string, min_value double, max_value double")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("property"), F.col(f"p_{n}").cast("string").alias("raw")) for n in ("size", "type", "name")))).alias("v")
    rows = A.table(spark, sf_dir, "part").select(F.lit("Part").alias("type"), each).select("type", "v.*")
    out = bt.validate_values(rows, rules).select("property", F.explode("violations").alias("v"))
    return out.groupBy(F.concat_ws(":", "property", "v").alias("violation")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) FILTER (WHERE l_discount > 0.05) AS too_much, count(*) FILTER (WHERE l_quantity * 1000 > l_extendedprice) AS too_cheap, count(*) AS lines FROM lineitem")
def check_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bt.check_invariants(A.table(spark, sf_dir, "lineitem"), {"too_much": F.col("l_discount") <= 0.05, "too_cheap": F.col("l_quantity") * 1000 <= F.col("l_extendedprice")})
    has = lambda n: F.count_if(F.array_contains("violations", n)).alias(n)
    return rows.agg(has("too_much"), has("too_cheap"), F.count(F.lit(1)).alias("lines"))


#: Rows of each kind made of an order's key (k) and price (p), alike in both engines; some break a rule.
_MADE = {
    "bar": (bt.BAR_RULES, "p AS open, p + 2 AS close, p + CASE WHEN k % 5 = 0 THEN 1 ELSE 3 END AS high, p - CASE WHEN k % 7 = 0 THEN -1 ELSE 1 END AS low, CASE WHEN k % 11 = 0 THEN -1 ELSE k END AS volume, 0 AS quote_volume, CASE WHEN k % 13 = 0 THEN NULL ELSE 1 END AS trade_count, k AS open_time, k + 1 - k % 2 AS close_time",
            {"high_is_highest": "k % 5 = 0", "low_is_lowest": "k % 7 = 0", "no_negative_volume": "k % 11 = 0", "closes_after_open": "k % 2 = 1"}),
    "value": (bt.TYPED_VALUE_RULES, "k AS valid_from, CASE WHEN k % 3 = 0 THEN NULL ELSE k + k % 2 END AS valid_to, k AS recorded_at, CASE WHEN k % 5 = 0 THEN k - 1 END AS retracted_at, (k % 12) / 10.0 AS confidence, CASE WHEN k % 4 = 0 THEN 'a' END AS value_text, CASE WHEN k % 4 < 2 THEN 1 END AS value_numeric, CASE WHEN k % 4 = 3 THEN true END AS value_bool, NULL AS value_ts, NULL AS value_json, NULL AS value_ref",
              {"valid_range": "k % 3 <> 0 AND k % 2 = 0", "retracted_after_recorded": "k % 5 = 0", "confidence": "k % 12 = 11", "one_value": "k % 4 IN (0, 2)"}),
    "link": (bt.LINK_RULES, "k AS valid_from, k + 1 AS valid_to, k AS recorded_at, k AS retracted_at, 1 AS confidence, k % 10 AS from_id, CASE WHEN k % 9 = 4 THEN NULL ELSE k % 6 END AS to_id", {"no_self_link": "k % 9 <> 4 AND k % 10 = k % 6"}),
    "news": (bt.NEWS_RULES, "(k % 13 - 6) / 5.0 AS sentiment, CASE WHEN k % 2 = 0 THEN (k % 14 - 1) / 10.0 END AS materiality", {"sentiment": "k % 13 IN (0, 12)", "materiality": "k % 14 IN (0, 12)"}),
    "vintage": (bt.VINTAGE_RULES, "CASE WHEN k % 6 <> 0 THEN p END AS value, k AS vintage_from, CASE WHEN k % 4 <> 0 THEN k + k % 3 END AS vintage_to", {"has_value": "k % 6 = 0", "vintage_order": "k % 4 <> 0 AND k % 3 = 0"}),
    "call": (bt.CALL_RULES, "k % 8 - 1 AS input_tokens, 5 AS output_tokens, k % 5 AS cached_input_tokens", {"tokens": "k % 8 = 0", "cached_within_input": "k % 5 > k % 8 - 1"}),
}


@query("WITH o AS (SELECT o_orderkey AS k FROM orders) " + " UNION ALL ".join(f"SELECT '{kind}' AS kind, k, concat_ws(' ', {', '.join(f'CASE WHEN {broken} THEN {chr(39)}{name}{chr(39)} END' for name, broken in made[2].items())}) AS violations FROM o" for kind, made in _MADE.items()))
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars, typed values, links, news, vintages and calls against all rules of their kind: the names of those that each row breaks."""
    o = A.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_totalprice AS p")
    out = None
    for kind, (rules, columns, _) in _MADE.items():
        rows = o.selectExpr("k", *(c.strip() for c in re.split(r",(?![^(]*\))", columns)))
        found = bt.check_invariants(rows, rules).select(F.lit(kind).alias("kind"), "k", F.array_join("violations", " ").alias("violations"))
        out = found if out is None else out.unionByName(found)
    return out


@query(f"""WITH {_ASSERTED}, u AS (SELECT object_id, recorded_at, seq FROM v UNION ALL SELECT o_custkey, o_orderdate, o_orderkey + 1000000000 FROM orders)
SELECT object_id, arg_max(seq, (recorded_at, seq)) AS last_commit FROM u GROUP BY 1""")
def last_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("from_id"), (F.col("o_orderkey") + 1_000_000_000).alias("commit_id"), F.col("o_orderdate").cast("timestamp").alias("recorded_at"))
    return qb.last_commit(A.price_values(spark, sf_dir), o).select("object_id", "last_commit")
