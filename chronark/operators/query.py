"""A small query builder over typed objects: filters, sort and paging on the current projection or as known at an instant.

A query is a dataclass that is checked against the catalog on the driver and then becomes DataFrame filters; it holds no SQL.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime
from decimal import Decimal
from typing import Any
from uuid import UUID

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronark.operators import temporal

ORDERED = {"DECIMAL", "INTEGER", "BOOLEAN", "TIMESTAMP", "DATE"}
TEXT = {"STRING", "TEXT", "ENUM"}
OPERATORS = ("EQ", "NEQ", "GT", "GTE", "LT", "LTE", "IN", "CONTAINS", "STARTS_WITH", "IS_NULL", "IS_NOT_NULL")
CARDINALITIES = ("ONE_TO_ONE", "ONE_TO_MANY", "MANY_TO_ONE", "MANY_TO_MANY")
DEFAULT_LIMIT, MOST = 50, 500
_SPARK = {"DECIMAL": "decimal(38,12)", "INTEGER": "decimal(38,12)", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp", "DATE": "timestamp"}


class NotFound(ValueError):
    """An unknown type or field."""


class SchemaViolation(ValueError):
    """An operator or value that a field's type doesn't allow."""


@dataclass
class Property:
    name: str
    data_type: str = "STRING"
    is_list: bool = False
    is_title: bool = False
    required: bool = False
    order: int = 0
    since: int = 1
    deprecated_in: int | None = None
    low: float | None = None
    high: float | None = None


@dataclass
class Link:
    name: str
    from_type: str
    to_type: str
    cardinality: str = "MANY_TO_MANY"
    symmetric: bool = False


@dataclass
class Catalog:
    """Types with their parents and own properties; the schema of the data, collected once."""

    parents: dict[str, str | None]
    own: dict[str, list[Property]]
    abstract: set[str] = field(default_factory=set)
    links: dict[str, Link] = field(default_factory=dict)
    versions: dict[str, int] = field(default_factory=dict)
    log: list[tuple[str, int, str]] = field(default_factory=list)

    def ancestry(self, type_: str) -> list[str]:
        if type_ not in self.parents:
            raise NotFound(f"type {type_}")
        out = [type_]
        while (up := self.parents[out[-1]]) is not None:
            out.append(up)
        return out

    def descendants(self, type_: str) -> list[str]:
        """The type and all below it."""
        return sorted(t for t in self.parents if type_ in self.ancestry(t))

    def properties(self, type_: str) -> dict[str, Property]:
        """Own and inherited properties; the most derived definition wins."""
        return {p.name: p for t in reversed(self.ancestry(type_)) for p in self.own.get(t, [])}

    def property(self, type_: str, name: str) -> Property:
        if (found := self.properties(type_).get(name)) is None:
            raise NotFound(f"field {type_}.{name}")
        return found

    def define_type(self, name: str, parent: str | None = None, abstract: bool = False) -> None:
        if not name[:1].isupper() or not name.isalnum():
            raise SchemaViolation(f"type name {name}")
        if name in self.parents:
            raise SchemaViolation(f"type {name} exists")
        if parent is not None and parent not in self.parents:
            raise NotFound(f"type {parent}")
        self.parents[name] = parent
        if abstract:
            self.abstract.add(name)
        self._changed(name, "DEFINE_TYPE")

    def _changed(self, type_: str, what: str) -> int:
        """The type's next version, noted in the log."""
        self.versions[type_] = self.versions.get(type_, 0) + 1
        self.log.append((type_, self.versions[type_], what))
        return self.versions[type_]

    def define_property(self, type_: str, p: Property, populated: bool = False) -> None:
        if p.required and populated:
            raise SchemaViolation("a populated type takes no new required property")
        if not p.name[:1].islower() or not p.name.isalnum():
            raise SchemaViolation(f"property name {p.name}")
        if p.is_title and any(q.is_title for q in self.own.get(type_, [])):
            raise SchemaViolation(f"{type_} has a title")
        self.ancestry(type_)
        if any(q.name == p.name for q in self.own.get(type_, [])):
            raise SchemaViolation(f"{type_}.{p.name} exists")
        p.since = self._changed(type_, f"DEFINE_PROPERTY {p.name}")
        self.own.setdefault(type_, []).append(p)

    def define_link(self, link: Link) -> None:
        if not re.fullmatch(r"[A-Z][A-Z0-9_]*", link.name):
            raise SchemaViolation(f"link name {link.name}")
        if link.name in self.links or link.cardinality not in CARDINALITIES:
            raise SchemaViolation(f"link {link.name}")
        self.ancestry(link.from_type), self.ancestry(link.to_type)
        self.links[link.name] = link
        self._changed(link.from_type, f"DEFINE_LINK {link.name}")

    def deprecate(self, type_: str, name: str) -> None:
        """A stamp: the property stays readable."""
        for p in self.own.get(type_, []):
            if p.name == name:
                p.deprecated_in = self._changed(type_, f"DEPRECATE {name}")
                return
        raise NotFound(f"field {type_}.{name}")

    def specs(self, spark: SparkSession) -> DataFrame:
        """(type, parent, is_abstract, version, properties): each type with its own and inherited properties in display order."""
        kind = "type string, parent string, is_abstract boolean, version int, properties array<struct<name:string,data_type:string,is_list:boolean,required:boolean,since:int,deprecated_in:int>>"
        rows = []
        for t, parent in self.parents.items():
            shown = sorted(self.properties(t).values(), key=lambda p: (p.order, p.name))
            rows.append((t, parent, t in self.abstract, self.versions.get(t, 1), [(p.name, p.data_type, p.is_list, p.required, p.since, p.deprecated_in) for p in shown]))
        return spark.createDataFrame(rows, kind)

    def value_rules(self, spark: SparkSession) -> DataFrame:
        """What ``bitemporal.validate_values`` asks of each type's own and inherited properties."""
        kind = "type string, property string, data_type string, enum_values array<string>, min_length int, max_length int, pattern string, min_value double, max_value double"
        rows = [(t, p.name, p.data_type, None, None, None, None, *(None if x is None else float(x) for x in (p.low, p.high))) for t in self.parents for p in self.properties(t).values()]
        return spark.createDataFrame(rows, kind)


@dataclass
class Where:
    name: str
    op: str
    value: Any = None


@dataclass
class Query:
    type: str
    where: list[Where] = field(default_factory=list)
    search: str | None = None
    order_by: list[tuple[str, bool]] = field(default_factory=list)
    as_of: Column | None = None
    limit: int = DEFAULT_LIMIT
    offset: int = 0

    def __post_init__(self) -> None:
        self.limit, self.offset = max(1, min(self.limit, MOST)), max(0, self.offset)


def literal(value: Any, data_type: str) -> Column:
    """A value as a constant of a property's type, from text too; what isn't of that type is refused before any plan."""
    try:
        if data_type in ("DECIMAL", "INTEGER"):
            return F.lit(str(Decimal(str(value)))).cast(_SPARK[data_type])
        if data_type == "BOOLEAN":
            return F.lit(value if isinstance(value, bool) else str(value).lower() == "true")
        if data_type in ("TIMESTAMP", "DATE") and isinstance(value, str):
            return F.lit(datetime.fromisoformat(value).isoformat()).cast("timestamp")
        if data_type == "REFERENCE":
            return F.lit(str(UUID(str(value))))
    except (ValueError, ArithmeticError) as e:
        raise SchemaViolation(f"{value} is no {data_type}") from e
    return F.lit(value).cast(_SPARK[data_type]) if data_type in _SPARK else F.lit(value)


def check(q: Query, catalog: Catalog) -> None:
    catalog.ancestry(q.type)
    for w in q.where:
        p = catalog.property(q.type, w.name)
        if w.op not in OPERATORS:
            raise SchemaViolation(f"operator {w.op}")
        if w.op not in ("IS_NULL", "IS_NOT_NULL") and (w.value is None or w.op == "IN" and not list(w.value)):
            raise SchemaViolation(f"{w.op} needs a value")
        if p.is_list:
            if w.op not in ("EQ", "CONTAINS", "IS_NULL", "IS_NOT_NULL"):
                raise SchemaViolation(f"{w.op} on a list")
        elif w.op in ("GT", "GTE", "LT", "LTE") and p.data_type not in ORDERED or w.op in ("CONTAINS", "STARTS_WITH") and p.data_type not in TEXT:
            raise SchemaViolation(f"{w.op} on {p.data_type}")
    for name, _ in q.order_by:
        if name not in ("title", "externalId", "updatedAt", "createdAt"):
            catalog.property(q.type, name)


def violations(requests: DataFrame, catalog: Catalog) -> DataFrame:
    """Conditions (type, field, op, values) with what ``check`` says of each as ``reason``, null if it may run.

    ``values`` is an array of text: no array, or a null in its first place, is no value, and IN needs one at least. Null names are unknown ones.
    """
    rows = [(t, p.name, p.data_type, p.is_list) for t in catalog.parents for p in catalog.properties(t).values()]
    known = requests.sparkSession.createDataFrame(rows, "type string, field string, __kind string, __list boolean")
    op, kind, shown = F.coalesce("op", F.lit("null")), F.col("__kind"), lambda c: F.coalesce(F.col(c), F.lit("null"))
    absent = F.when(op == "IN", F.coalesce(F.size("values"), F.lit(0)) <= 0).otherwise(F.try_element_at("values", F.lit(1)).isNull())
    wrong = op.isin("GT", "GTE", "LT", "LTE") & ~kind.isin(*sorted(ORDERED)) | op.isin("CONTAINS", "STARTS_WITH") & ~kind.isin(*sorted(TEXT))
    reason = (
        F.when(~F.coalesce(F.col("type").isin(*catalog.parents), F.lit(False)), F.concat(F.lit("type "), shown("type")))
        .when(kind.isNull(), F.concat(F.lit("field "), "type", F.lit("."), shown("field")))
        .when(~op.isin(*OPERATORS), F.concat(F.lit("operator "), op))
        .when(~op.isin("IS_NULL", "IS_NOT_NULL") & absent, F.concat(op, F.lit(" needs a value")))
        .when(F.col("__list") & ~op.isin("EQ", "CONTAINS", "IS_NULL", "IS_NOT_NULL"), F.concat(op, F.lit(" on a list")))
        .when(~F.col("__list") & wrong, F.concat(op, F.lit(" on "), kind))
    )
    # the schema is the driver's own: a row for each property of each type
    return requests.join(F.broadcast(known), ["type", "field"], "left").withColumn("reason", reason).drop("__kind", "__list")


def test(c: Column, op: str, value: Any, data_type: str, null_is_different: bool = True) -> Column:
    """One condition on a typed column. ``null_is_different``: NEQ holds for an absent value."""
    if op == "IN":
        return c.isin(*(literal(v, data_type) for v in value))
    v = literal(value, data_type) if value is not None else None
    return {
        "EQ": lambda: c == v, "NEQ": lambda: ~c.eqNullSafe(v) if null_is_different else c != v, "GT": lambda: c > v, "GTE": lambda: c >= v, "LT": lambda: c < v,
        "LTE": lambda: c <= v, "CONTAINS": lambda: c.ilike(f"%{value}%"), "STARTS_WITH": lambda: c.ilike(f"{value}%"), "IS_NULL": c.isNull, "IS_NOT_NULL": c.isNotNull,
    }[op]()


def _any(w: Where, p: Property, kind: str) -> Column:
    """Whether any of a property's text values meets a condition."""
    return F.exists(F.coalesce(F.col(w.name), F.array().cast("array<string>")), lambda x: F.coalesce(test(x.try_cast(kind), w.op, w.value, p.data_type, False), F.lit(False)))


def _typed(name: str, kind: str, is_list: bool) -> Column:
    return F.transform(name, lambda x: x.try_cast(kind)) if is_list else F.try_element_at(name, F.lit(1)).try_cast(kind)


@dataclass
class Result:
    """A page of rows, and all that match (``total`` counts them without the sort)."""

    rows: DataFrame
    matching: DataFrame

    def total(self) -> int:
        return self.matching.count()

    def has_more(self, q: Query) -> bool:
        return q.offset + q.limit < self.total()


def _paged(rows: DataFrame, q: Query, default: str, builtin: dict[str, str], tie: str | None) -> DataFrame:
    keys = q.order_by or [(default, True)]
    order = [(F.asc_nulls_last if up else F.desc_nulls_last)(builtin.get(name, name)) for name, up in keys]
    return rows.orderBy(*order, *([F.asc(tie)] if tie else [])).offset(q.offset).limit(q.limit)


def query_current(projection: DataFrame, q: Query, catalog: Catalog) -> Result:
    """Over the projection: (object_id, type, external_id, title, updated_at, a typed column for each property; arrays for lists)."""
    check(q, catalog)
    rows = projection.where(F.col("type").isin(*catalog.descendants(q.type)))
    for w in q.where:
        p = catalog.property(q.type, w.name)
        if p.is_list and w.op in ("EQ", "CONTAINS"):
            rows = rows.where(F.array_contains(w.name, literal(w.value, p.data_type)))
        else:
            rows = rows.where(test(F.col(w.name), w.op, w.value, p.data_type))
    if q.search:
        rows = rows.where(F.col("title").ilike(f"%{q.search}%"))
    return Result(_paged(rows, q, "title", {"externalId": "external_id", "updatedAt": "updated_at"}, "object_id"), rows)


def query_as_of(objects: DataFrame, values: DataFrame, q: Query, catalog: Catalog) -> Result:
    """As known at ``q.as_of``: one pivot of the values then known serves all conditions, sort keys and the view.

    ``values`` has text values; a condition holds if any element of a list meets it, NEQ needs a value. Search is for the
    current projection only.
    """
    check(q, catalog)
    names = [w.name for w in q.where] + [n for n, _ in q.order_by if n not in ("externalId", "createdAt")]
    there = objects.where(temporal.exists_at(q.as_of) & F.col("type").isin(*catalog.descendants(q.type)))
    known = values.where(temporal.known_at(q.as_of))
    shown = sorted(set(names) | {p for p in catalog.properties(q.type)})
    lists = [F.sort_array(F.collect_list(F.when(F.col("property") == n, F.struct("ordinal", "value")))).getField("value").alias(n) for n in shown]
    wide = known.where(F.col("property").isin(*shown)).groupBy("object_id").agg(*lists)
    rows = there.select("object_id", "type", "external_id", F.col("exists_from").alias("created_at")).join(wide, "object_id", "left")
    for w in q.where:
        p = catalog.property(q.type, w.name)
        kind = _SPARK.get(p.data_type, "string")
        if w.op in ("IS_NULL", "IS_NOT_NULL"):
            empty = F.coalesce(F.size(w.name) == 0, F.lit(True))
            rows = rows.where(empty if w.op == "IS_NULL" else ~empty)
        else:
            rows = rows.where(_any(w, p, kind))
    for n in shown:
        p = catalog.property(q.type, n)
        kind = _SPARK.get(p.data_type, "string")
        rows = rows.withColumn(n, _typed(n, kind, p.is_list))
    return Result(_paged(rows, q, "object_id", {"externalId": "external_id", "createdAt": "created_at"}, "object_id"), rows)


def run(q: Query, catalog: Catalog, projection: DataFrame, objects: DataFrame, values: DataFrame) -> Result:
    return query_current(projection, q, catalog) if q.as_of is None else query_as_of(objects, values, q, catalog)


# projection


def project(objects: DataFrame, values: DataFrame, links: DataFrame, catalog: Catalog, type_: str) -> DataFrame:
    """The current projection of a type: one row for each live object, typed property columns, title, link summary, last commit."""
    props = catalog.properties(type_)
    live = objects.where(F.col("deleted_at").isNull() & F.col("type").isin(*catalog.descendants(type_)))
    now = values.where(temporal.is_current())
    lists = [F.sort_array(F.collect_list(F.when(F.col("property") == n, F.struct("ordinal", "value")))).getField("value").alias(n) for n in props]
    wide = now.where(F.col("property").isin(*props)).groupBy("object_id").agg(*lists)
    rows = live.select("object_id", "type", "external_id").join(wide, "object_id", "left")
    for n, p in props.items():
        kind = _SPARK.get(p.data_type, "string")
        rows = rows.withColumn(n, _typed(n, kind, p.is_list))
    titles = [p.name for t in catalog.ancestry(type_) for p in catalog.own.get(t, []) if p.is_title]
    rows = rows.withColumn("title", F.coalesce(*titles, "external_id"))
    summary = link_summary(links, objects)
    return rows.join(summary, "object_id", "left").join(last_commit(values, links), "object_id", "left")


def link_summary(links: DataFrame, objects: DataFrame) -> DataFrame:
    """(object_id, link_summary map<link_type, array<external_id>>) over open links to live targets."""
    live = objects.where("deleted_at IS NULL").select(F.col("object_id").alias("to_id"), F.col("external_id").alias("to_external_id"))
    lists = links.where(temporal.is_current()).join(live, "to_id").groupBy("from_id", "link_type").agg(F.sort_array(F.collect_list("to_external_id")).alias("l"))
    return lists.groupBy(F.col("from_id").alias("object_id")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("link_type", "l")))).alias("link_summary"))


def last_commit(values: DataFrame, links: DataFrame) -> DataFrame:
    """(object_id, last_commit, updated_at): the latest commit over values and outgoing links."""
    both = values.select("object_id", "commit_id", "recorded_at").unionByName(links.select(F.col("from_id").alias("object_id"), "commit_id", "recorded_at"))
    return both.groupBy("object_id").agg(F.max_by("commit_id", F.struct("recorded_at", "commit_id")).alias("last_commit"), F.max("recorded_at").alias("updated_at"))


def refresh(projection: DataFrame, rebuilt: DataFrame, touched: DataFrame, objects: DataFrame) -> DataFrame:
    """``projection`` with the touched objects' rows replaced by ``rebuilt`` ones, deleted objects gone."""
    kept = projection.join(touched.select("object_id").distinct(), "object_id", "left_anti")
    both = kept.unionByName(rebuilt.join(touched.select("object_id").distinct(), "object_id", "left_semi"))
    return both.join(objects.where("deleted_at IS NOT NULL").select("object_id"), "object_id", "left_anti")


def traverse(projection: DataFrame, link_types: list[str]) -> DataFrame:
    """Only the requested link types stay in the view."""
    return projection.withColumn("link_summary", F.map_filter("link_summary", lambda k, v: k.isin(*link_types)))
