"""The catalog against data: specs of types, deprecated properties, checks of conditions, typed literals; and a ledger that only grows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronark.operators import graph, registers
from chronark.operators import query as qb
from chronark.plans import adapters as A
from chronark.plans.registry import query


@query("""WITH n AS (SELECT 'Customer' AS type, count(*) AS objects FROM customer WHERE c_custkey % 13 <> 0 UNION ALL SELECT 'Supplier', count(*) FROM supplier WHERE s_suppkey % 13 <> 0),
s AS (SELECT * FROM (VALUES ('Party', NULL, true, 3, 'balance:DECIMAL:3::false name:STRING:2::false'), ('Customer', 'Party', false, 4, 'balance:DECIMAL:3::false name:STRING:2::false segment:ENUM:2:4:false tags:STRING:3::true'),
  ('Supplier', 'Party', false, 1, 'balance:DECIMAL:3::false name:STRING:2::false')) t(type, parent, is_abstract, version, properties))
SELECT type, parent, is_abstract, version, properties, coalesce(objects, 0) AS objects FROM s LEFT JOIN n USING (type)""")
def type_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type with its own and inherited properties, versions after a deprecation, and how many objects live."""
    catalog = A.catalog()
    catalog.deprecate("Customer", "segment")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    shown = F.transform("properties", lambda p: F.concat_ws(":", p["name"], p["data_type"], text(p["since"]), text(p["deprecated_in"]), text(p["is_list"])))
    specs = catalog.specs(spark).withColumn("properties", F.array_join(shown, " "))
    return specs.join(registers.object_counts(A.objects(spark, sf_dir)), "type", "left").withColumn("objects", F.coalesce("objects", F.lit(0)))


@query("""SELECT concat('C', c_custkey) AS object_id, c_mktsegment AS value, 2 AS since, 4 AS deprecated_in FROM customer WHERE c_mktsegment IS NOT NULL""")
def deprecated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of properties that were deprecated: they stay readable, with the versions that brought and deprecated them."""
    catalog = A.catalog()
    catalog.deprecate("Customer", "segment")
    stamped = catalog.specs(spark).select("type", F.explode("properties").alias("p")).select("type", F.col("p.name").alias("property"), "p.since", "p.deprecated_in").where("deprecated_in IS NOT NULL")
    of = A.objects(spark, sf_dir).select("object_id", "type")
    return A.object_values(spark, sf_dir).join(of, "object_id").join(F.broadcast(stamped), ["type", "property"]).select("object_id", "value", "since", "deprecated_in")


_TYPES, _FIELDS = ("Party", "Customer", "Supplier", "Depot"), ("name", "balance", "segment", "tags", "colour")
_ASKED = (*qb.OPERATORS, "LIKE")


@query(f"""WITH r AS (SELECT o_orderkey AS k, {list(_TYPES)}[o_orderkey % 4 + 1] AS type, {list(_FIELDS)}[o_orderkey // 4 % 5 + 1] AS field, {list(_ASKED)}[o_orderkey // 20 % {len(_ASKED)} + 1] AS op, o_orderkey % 7 AS given FROM orders),
p AS (SELECT *, field IN ('name', 'balance') AND type <> 'Depot' OR field IN ('segment', 'tags') AND type = 'Customer' AS known, op IN ('IS_NULL', 'IS_NOT_NULL') AS bare FROM r)
SELECT k, type, field, op, CASE WHEN type = 'Depot' THEN 'type Depot' WHEN NOT known THEN concat('field ', type, '.', field) WHEN op = 'LIKE' THEN 'operator LIKE' WHEN NOT bare AND (given IN (0, 1) OR given = 2 AND op <> 'IN') THEN concat(op, ' needs a value')
  WHEN field = 'tags' AND NOT bare AND op NOT IN ('EQ', 'CONTAINS') THEN concat(op, ' on a list') WHEN op IN ('GT', 'GTE', 'LT', 'LTE') AND field IN ('name', 'segment') THEN concat(op, ' on ', CASE field WHEN 'name' THEN 'STRING' ELSE 'ENUM' END)
  WHEN op IN ('CONTAINS', 'STARTS_WITH') AND field = 'balance' THEN concat(op, ' on DECIMAL') END AS reason FROM p""")
def checked_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition made of each order's key, checked against the catalog: unknown names, operators that don't fit, values that lack."""
    k = F.col("o_orderkey")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.floor(k / n) % len(names) + 1).cast("int"))
    # no values, an empty list, a null, one
    given = F.when(k % 7 == 1, F.array().cast("array<string>")).when(k % 7 == 2, F.array(F.lit(None).cast("string"))).when(k % 7 > 2, F.array(F.lit("1")))
    requests = A.table(spark, sf_dir, "orders").select(k.alias("k"), pick(_TYPES, 1).alias("type"), pick(_FIELDS, 4).alias("field"), pick(_ASKED, 20).alias("op"), given.alias("values"))
    return qb.violations(requests, A.catalog()).drop("values")


@query("""SELECT o_orderkey, o_totalprice >= 150000.5 AS price, o_orderkey IN (1, 2, 300) AS key, o_orderdate < TIMESTAMP '1997-01-01' AS day, NOT (o_orderstatus = 'F') AS status, o_orderkey % 2 = 0 AS flag, o_orderpriority ILIKE '1%' AS priority FROM orders""")
def typed_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions whose values are text, each read as its field's type."""
    c = F.col
    tests = {
        "price": (c("o_totalprice").cast("decimal(38,12)"), "GTE", "150000.50", "DECIMAL"), "key": (c("o_orderkey").cast("decimal(38,12)"), "IN", ["1", "2.0", 300], "INTEGER"),
        "day": (c("o_orderdate").cast("timestamp"), "LT", "1997-01-01T00:00:00+00:00", "TIMESTAMP"), "status": (c("o_orderstatus"), "NEQ", "F", "ENUM"),
        "flag": (c("o_orderkey") % 2 == 0, "EQ", "TRUE", "BOOLEAN"), "priority": (c("o_orderpriority"), "STARTS_WITH", "1", "STRING"),
    }
    return A.table(spark, sf_dir, "orders").select("o_orderkey", *(qb.test(*asked).alias(name) for name, asked in tests.items()))


@query("""WITH r AS (SELECT concat_ws('-', conv_id, turn) AS call_id, conv_id % 2 AS part FROM conversations WHERE role = 'assistant')
SELECT call_id, part, 1 AS copies FROM r""")
def append_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that come in two parts: the second is added to the first, and nothing of that is written again."""
    at = f"{graph.shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    calls = A.calls(spark, sf_dir).select("call_id", (F.split_part("call_id", F.lit("-"), F.lit(1)).cast("long") % 2).alias("part"))
    for part in (0, 1):
        registers.append(calls.where(F.col("part") == part), at)
    return spark.read.parquet(at).groupBy("call_id", "part").agg(F.count(F.lit(1)).cast("int").alias("copies"))
