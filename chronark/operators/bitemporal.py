"""Reads and bulk writes of bitemporal property values and links.

Values: (object_id, property, ordinal, value, valid_from, valid_to, recorded_at, retracted_at, commit_id). A write is a table of
assertions with a sequence number; the result equals applying them one by one in (recorded_at, seq) order. Keys whose history
is monotone take windows only; others go through a fold of their own rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronark.operators import graph, ordered, temporal

KEY = ["object_id", "property", "ordinal"]
STATE = [*KEY, "value", "valid_from", "valid_to", "recorded_at", "retracted_at"]
#: Later than any end, and still a pandas time in nanoseconds.
_FAR = pd.Timestamp("2262-01-01")


# reads


def current_values(values: DataFrame) -> DataFrame:
    return values.where(temporal.is_current())


def objects_as_of(objects: DataFrame, values: DataFrame, t: Column, title_property: str = "name", titles: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """(object_id, external_id, title, data map<property, array<value>>) of objects that existed at ``t``, as known then.

    The title is the value at ``t`` of ``title_property`` or, with ``titles`` (type, property, depth), of the title property of the
    object's type or of the nearest type above it (largest depth) that has a value; else the external id. With ``links`` there is
    a column of them as of ``t``: map<link_type, array<target's id, title and weight>>.
    """
    known = values.where(temporal.known_at(t))
    lists = known.groupBy("object_id", "property").agg(F.sort_array(F.collect_list(F.struct("ordinal", "value"))).getField("value").alias("v"))
    maps = lists.groupBy("object_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("property", "v")))).alias("data"))
    there = objects.where(temporal.exists_at(t))
    out = there.join(maps, "object_id", "left")
    value = lambda name: F.try_element_at(F.try_element_at("data", name), F.lit(1))
    if titles is None:
        title = value(F.lit(title_property))
    else:
        names = titles.groupBy("type").agg(F.reverse(F.sort_array(F.collect_list(F.struct("depth", "property")))).getField("property").alias("names"))
        out = out.join(F.broadcast(names), "type", "left")
        title = F.try_element_at(F.filter(F.transform("names", value), lambda v: v.isNotNull()), F.lit(1))
    out = out.select("object_id", "external_id", F.coalesce(title, "external_id").alias("title"), "data")
    if links is None:
        return out
    grouped = group_links(links_as_of(links, objects, out.select("object_id", "title"), t))
    return out.join(grouped.withColumnRenamed("from_id", "object_id"), "object_id", "left")


def history(values: DataFrame, commits: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """All versions with who wrote them, newest first; retracted ones too."""
    rows = values.join(commits.select("commit_id", "actor", "reason", *(["source_id"] if sources is not None else [])), "commit_id")
    if sources is not None:
        rows = rows.join(F.broadcast(sources.select("source_id", F.col("name").alias("source_name"))), "source_id", "left")
    rows = rows.withColumn("is_open", F.col("valid_to").isNull()).withColumn("is_retracted", F.col("retracted_at").isNotNull())
    return rows.orderBy("object_id", "property", F.desc("valid_from"), F.desc("recorded_at"), "ordinal")


def links_as_of(links: DataFrame, objects: DataFrame, titles: DataFrame, t: Column | None) -> DataFrame:
    """Outgoing links (current if ``t`` is null) with the target's natural key and title."""
    rows = links.where(temporal.is_current() if t is None else temporal.known_at(t))
    to = objects.select(F.col("object_id").alias("to_id"), F.col("external_id").alias("to_external_id"))
    named = titles.select(F.col("object_id").alias("to_id"), F.col("title").alias("to_title"))
    return rows.join(to, "to_id").join(named, "to_id", "left").select("from_id", "link_type", "to_id", "to_external_id", F.coalesce("to_title", "to_external_id").alias("to_title"), "weight", "valid_from")


def group_links(links: DataFrame) -> DataFrame:
    """(from_id, links map<link_type, array<struct>>)."""
    lists = links.groupBy("from_id", "link_type").agg(F.sort_array(F.collect_list(F.struct("to_external_id", "to_title", "weight"))).alias("l"))
    return lists.groupBy("from_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("link_type", "l")))).alias("links"))


def find_by_external_id(objects: DataFrame, keys: DataFrame, t: Column | None = None) -> DataFrame:
    alive = objects.where(F.col("deleted_at").isNull() if t is None else temporal.exists_at(t))
    return alive.join(keys.select("type", "external_id").distinct(), ["type", "external_id"], "left_semi")


class Snapshot:
    """All reads pinned to one knowledge time."""

    def __init__(self, objects: DataFrame, values: DataFrame, links: DataFrame, t: Column):
        self.t, self._all_objects, self._all_values = t, objects, values
        self.objects, self.values, self.links = objects.where(temporal.exists_at(t)), values.where(temporal.known_at(t)), links.where(temporal.known_at(t))

    def views(self, title_property: str = "name") -> DataFrame:
        return objects_as_of(self._all_objects, self._all_values, self.t, title_property)

    def find(self, keys: DataFrame) -> DataFrame:
        return find_by_external_id(self._all_objects, keys, self.t)


def walk_links(links: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start_id, object_id, hops): what is reached over current links within ``depth`` hops, each object once per start."""
    edges = links.where(temporal.is_current()).select(F.col("from_id").alias("object_id"), F.col("to_id").alias("next_id")).distinct()
    frontier = starts.select(F.col("object_id").alias("start_id"), "object_id", F.lit(0).alias("hops")).distinct()
    seen = frontier
    for hop in range(1, depth + 1):
        reached = frontier.join(edges, "object_id").select("start_id", F.col("next_id").alias("object_id"), F.lit(hop).alias("hops")).distinct()
        frontier = reached.join(seen.select("start_id", "object_id"), ["start_id", "object_id"], "left_anti")
        seen = seen.union(frontier)
    return seen


# writes


@dataclass
class Applied:
    """State after the write, rejected assertions with a reason, and the change log."""

    state: DataFrame
    rejects: DataFrame
    log: DataFrame = field(default=None)


def monotone(assertions: DataFrame) -> DataFrame:
    """State from a history without updates out of order: each value lasts until the next one begins.

    A repeated value is no change; one that begins at the same instant retracts the one before. A column ``old``, if there is
    one, marks rows that were there before and come first.
    """
    rows = assertions if "old" in assertions.columns else assertions.withColumn("old", F.lit(False))
    w = W.partitionBy(*KEY).orderBy(F.desc("old"), "recorded_at", "seq")
    changed = rows.withColumn("last", F.lag(F.struct("value")).over(w)).where(F.col("last").isNull() | ~F.col("last.value").eqNullSafe(F.col("value"))).drop("last")
    nxt, rec = F.lead("valid_from").over(w), F.lead("recorded_at").over(w)
    out = changed.select(*KEY, "value", "valid_from", F.when(nxt > F.col("valid_from"), nxt).alias("valid_to"), "recorded_at", F.when(nxt == F.col("valid_from"), rec).alias("retracted_at"), "old")
    return out if "old" in assertions.columns else out.drop("old")


class _Values:
    """One key's rows, as its assertions (op set, close or retract) come one after another.

    Retracted rows can't change any more and go out at once; live ones are held in order of their start. They don't overlap, unless the
    state came so (``crossed``), so a write looks at the rows next to its own time, not at the key's whole history.
    """

    def __init__(self):
        self.starts: list = []
        self.rows: list[dict] = []
        self.crossed = False

    @staticmethod
    def _end(r: dict) -> pd.Timestamp:
        return _FAR if r["valid_to"] is None else r["valid_to"]

    def _hold(self, r: dict) -> None:
        at = bisect_right(self.starts, r["valid_from"])
        beside = self.rows[max(at - 1, 0) : at + 1]
        self.crossed |= r["valid_from"] >= self._end(r) or any(x["valid_from"] < self._end(r) and r["valid_from"] < self._end(x) for x in beside)
        self.starts.insert(at, r["valid_from"])
        self.rows.insert(at, r)

    def _drop_retracted(self, near: list[dict]) -> list[tuple]:
        gone = [r for r in near if r["retracted_at"] is not None]
        for r in gone:
            at = bisect_left(self.starts, r["valid_from"])
            while self.rows[at] is not r:
                at += 1
            del self.starts[at], self.rows[at]
        return [self._out(r, "state", None) for r in gone]

    def put(self, a: dict) -> list[tuple]:
        if a["op"] is None:  # a row of the state
            row = a | {"seq": None}
            if row["retracted_at"] is not None:
                return [self._out(row, "state", None)]
            self._hold(row)
            return []
        start, until, at = a["valid_from"], a["valid_to"], a["recorded_at"]
        opened = [r for r in (self.rows if self.crossed else self.rows[-1:]) if r["valid_to"] is None]
        if a["op"] == "retract":
            for r in opened:
                r["retracted_at"] = at
            return self._drop_retracted(opened) + [self._out(a, "log", "RETRACT_PROPERTY")] * bool(opened)
        if a["op"] == "close":
            hit = [r for r in opened if r["valid_from"] < until]
            for r in hit:
                r["valid_to"] = until
            return [self._out(a, "log", "CLOSE_PROPERTY")] * bool(hit)
        if len(opened) == 1 and opened[0]["value"] == a["value"] and until is None:
            return []
        i = bisect_right(self.starts, start)
        near = list(self.rows) if self.crossed else self.rows[max(i - 1, 0) : i + 1]
        undo = [(r, r["valid_to"]) for r in near]
        if until is None:
            for r in near:
                if r["valid_from"] < start < self._end(r):
                    r["valid_to"] = start
                elif r["valid_to"] is None and r["valid_from"] == start:
                    r["retracted_at"] = at
        stop = _FAR if until is None else until
        if start >= stop or any(r["retracted_at"] is None and r["valid_from"] < stop and start < self._end(r) for r in near):
            for r, to in undo:
                r["valid_to"], r["retracted_at"] = to, None
            return [self._out(a, "reject", "TEMPORAL_CONFLICT")]
        out = self._drop_retracted(near)
        self._hold(a | {"retracted_at": None})
        return [*out, self._out(a, "log", "SET_PROPERTY")]

    def end(self) -> list[tuple]:
        return [self._out(r, "state", None) for r in self.rows]

    @staticmethod
    def _out(r: dict, kind: str, reason: str | None) -> tuple:
        return (*(r.get(c) for c in STATE), r["seq"], kind, reason)


def apply_assertions(state: DataFrame, assertions: DataFrame) -> Applied:
    """Bulk change application: assertions (KEY, value, op, valid_from, valid_to, recorded_at, seq) onto ``state``.

    Only keys with assertions are touched. Keys whose assertions are plain open-ended sets in order, that start empty or with one
    open row before them, take the window form; the rest are folded, a key's rows streaming through one task.
    """
    a = assertions.select(*KEY, "value", "op", "valid_from", "valid_to", "recorded_at", "seq")
    touched = a.select(*KEY).distinct()
    untouched = state.select(*STATE).join(touched, KEY, "left_anti")
    old = state.select(*STATE).join(touched, KEY, "left_semi")
    w = W.partitionBy(*KEY).orderBy("recorded_at", "seq")
    late = (F.col("op") != "set") | F.col("valid_to").isNotNull() | F.coalesce(F.lag("valid_from").over(w) > F.col("valid_from"), F.lit(False))
    # a state is simple if all its rows have ended when the assertions begin, but for one that is open and began before
    begins = a.groupBy(*KEY).agg(F.min("valid_from").alias("begins"))
    reaches = F.col("retracted_at").isNull() & (F.coalesce("valid_to", "valid_from") > F.col("begins"))
    tangled = old.join(begins, KEY).groupBy(*KEY).agg(F.max(reaches).alias("reaches"), F.count_if(temporal.is_current()).alias("open")).where("reaches OR open > 1").select(*KEY)
    special = a.withColumn("late", late).where("late").select(*KEY).union(tangled).distinct()
    simple = old.join(special, KEY, "left_anti")
    first = simple.where(temporal.is_current()).select(*KEY, "value", "valid_from", "recorded_at", F.lit(0).cast("long").alias("seq"), F.lit(True).alias("old"))
    made = monotone(first.unionByName(a.join(special, KEY, "left_anti").select(*KEY, "value", "valid_from", "recorded_at", F.col("seq").cast("long").alias("seq"), F.lit(False).alias("old"))))
    plain = made.drop("old").unionByName(simple.where(~temporal.is_current()).select(*STATE))
    old = old.join(special, KEY, "left_semi")
    both = old.select(*STATE, F.lit(None).cast("string").alias("op"), F.lit(None).cast("long").alias("seq")).unionByName(a.join(special, KEY, "left_semi"), allowMissingColumns=True)

    kinds = dict(state.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in STATE), "seq long", "kind string", "reason string"])
    folded = graph.cut(ordered.fold(both, KEY, [F.col("op").isNotNull(), "recorded_at", "seq", "valid_from", "value"], _Values, schema))
    log = folded.where("kind = 'log'").select(*KEY, "value", "valid_from", "recorded_at", "seq", F.col("reason").alias("op"))
    log = log.unionByName(made.where("NOT old").select(*KEY, "value", "valid_from", "recorded_at", F.lit(None).cast("long").alias("seq"), F.lit("SET_PROPERTY").alias("op")))
    return Applied(untouched.unionByName(plain).unionByName(folded.where("kind = 'state'").select(*STATE)), folded.where("kind = 'reject'").select(*KEY, "value", "valid_from", "valid_to", "recorded_at", "seq", "reason"), log)


class _Lists:
    """One list property of an object: its rows, as list writes come one after another."""

    def __init__(self):
        self.rows: list[dict] = []

    def put(self, w: dict) -> list[tuple]:
        if w["elements"] is None:  # a row of the state
            self.rows.append(w)
            return []
        elements, start, at = list(w["elements"]), w["valid_from"], w["recorded_at"]
        live = [r for r in self.rows if r["retracted_at"] is None]
        opened = sorted((r for r in live if r["valid_to"] is None), key=lambda r: r["ordinal"])
        if [r["value"] for r in opened] == elements:
            return []
        undo = [(r, r["valid_to"], r["retracted_at"]) for r in live]
        reach = max(len(opened), len(elements))
        for r in live:
            if r["ordinal"] < reach:
                if r["valid_from"] < start and (r["valid_to"] is None or r["valid_to"] > start):
                    r["valid_to"] = start
                elif r["valid_from"] == start and r["valid_to"] is None:
                    r["retracted_at"] = at
        if any(r["retracted_at"] is None and r["ordinal"] < len(elements) and (r["valid_to"] is None or r["valid_to"] > start) for r in live):
            for r, to, gone in undo:
                r["valid_to"], r["retracted_at"] = to, gone
            return [self._out(w | {"ordinal": k, "value": v}, "reject", "TEMPORAL_CONFLICT") for k, v in enumerate(elements)]
        self.rows += [{**w, "ordinal": k, "value": v, "valid_to": None, "retracted_at": None} for k, v in enumerate(elements)]
        return []

    def end(self) -> list[tuple]:
        return [self._out(r, "state", None) for r in self.rows]

    @staticmethod
    def _out(r: dict, kind: str, reason: str | None) -> tuple:
        return (*(r.get(c) for c in STATE), r["seq"], kind, reason)


def apply_lists(state: DataFrame, lists: DataFrame) -> Applied:
    """Bulk list writes (object_id, property, elements, valid_from, recorded_at, seq) onto ``state``, as one by one in (recorded_at, seq) order.

    A list equal to what is open is no change; another one ends the open rows of all ordinals where it begins, or retracts those that began
    at the same instant. A late list that would overlap a later one is rejected. A null list counts as empty, null elements
    are values. Keys whose lists come in order, onto rows that began before or none, take windows: each list lasts until
    the next other one. The rest are folded, a key's rows streaming through one task. Keys without writes are left alone.
    """
    key = ["object_id", "property"]
    seq = F.col("seq").cast("long") if "seq" in lists.columns else F.lit(0).cast("long")
    writes = lists.select(*key, F.coalesce("elements", F.array().cast(dict(lists.dtypes)["elements"])).alias("elements"), "valid_from", "recorded_at", seq.alias("seq"))
    order = W.partitionBy(*key).orderBy("recorded_at", "seq", "valid_from", "elements")
    writes = writes.withColumn("late", F.coalesce(F.lag("valid_from").over(order) > F.col("valid_from"), F.lit(False)))
    spans = writes.groupBy(*key).agg(F.min("valid_from").alias("begins"), F.max("late").alias("late"))
    old = state.select(*STATE).join(spans, key, "left")
    untouched = old.where("begins IS NULL").select(*STATE)
    live = F.col("retracted_at").isNull()
    # rows that reach beyond the first write, or open ones of different times, are for the fold
    reaches = live & F.when(F.col("valid_to").isNull(), F.col("valid_from") > F.col("begins")).otherwise(F.col("valid_to") > F.col("begins"))
    odd = old.where("begins IS NOT NULL").groupBy(*key).agg(F.max(reaches).alias("odd"), F.count_if(live & F.col("valid_to").isNull()).alias("n"), F.max(F.when(live & F.col("valid_to").isNull(), F.col("ordinal"))).alias("top"))
    special = graph.cut(spans.join(odd, key, "left").where("late OR odd OR n <> coalesce(top, -1) + 1").select(*key))
    old = old.where("begins IS NOT NULL").select(*STATE)

    plain, was = writes.drop("late").join(special, key, "left_anti"), old.join(special, key, "left_anti")
    open_ = temporal.is_current()
    first = was.where(open_).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("ordinal", "value"))).getField("value").alias("elements"))
    both = first.select(*key, "elements", *(F.lit(None).cast("timestamp").alias(c) for c in ("valid_from", "recorded_at")), F.lit(None).cast("long").alias("seq"), F.lit(True).alias("old"))
    both = both.unionByName(plain.withColumn("old", F.lit(False)))
    order = W.partitionBy(*key).orderBy(F.desc("old"), "recorded_at", "seq", "valid_from", "elements")
    # before the first write, what is open is the list; without any it is empty
    last = F.coalesce(F.lag("elements").over(order), F.array().cast(dict(writes.dtypes)["elements"]))
    changed = both.withColumn("last", last).where(F.col("old") | ~F.col("last").eqNullSafe(F.col("elements"))).drop("last")
    changed = changed.withColumn("next", F.lead("valid_from").over(order)).withColumn("next_at", F.lead("recorded_at").over(order))
    ended = lambda begin: (F.when(F.col("next") > begin, F.col("next")).alias("valid_to"), F.when(F.col("next") == begin, F.col("next_at")).alias("retracted_at"))
    made = changed.where("NOT old").select(*key, F.posexplode("elements").alias("ordinal", "value"), "valid_from", "recorded_at", *ended(F.col("valid_from")))
    closing = was.where(open_).drop("valid_to", "retracted_at").join(changed.where("old").select(*key, "next", "next_at"), key, "left").select(*key, "ordinal", "value", "valid_from", "recorded_at", *ended(F.col("valid_from")))
    simple = made.select(*STATE).unionByName(closing.select(*STATE)).unionByName(was.where(~open_).select(*STATE))

    kinds = dict(state.dtypes)
    rows = old.join(special, key, "left_semi").select(*STATE, F.lit(None).cast("long").alias("seq"))
    rows = rows.unionByName(writes.drop("late").join(special, key, "left_semi"), allowMissingColumns=True)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in STATE), "seq long", "kind string", "reason string"])
    folded = graph.cut(ordered.fold(rows, key, [F.col("elements").isNotNull(), "recorded_at", "seq", "valid_from", "elements"], _Lists, schema))
    out = untouched.unionByName(simple).unionByName(folded.where("kind = 'state'").select(*STATE))
    return Applied(out, folded.where("kind = 'reject'").select(*KEY, "value", "valid_from", "recorded_at", "seq", "reason"), property_log(state, out))


def set_lists(state: DataFrame, lists: DataFrame) -> DataFrame:
    """The state after ``apply_lists``."""
    return apply_lists(state, lists).state


def _first_of(rows: DataFrame, value: str, fits: Callable[[Column], Column]) -> tuple[DataFrame, Column]:
    """The values asked for each key, in order of ``seq`` if there is one, else their own, and the first of them that ``fits``."""
    kinds = dict(rows.dtypes)
    order = F.col("seq").cast("long") if "seq" in kinds else F.lit(0).cast("long")
    asked = rows.groupBy("object_id", "property").agg(F.sort_array(F.collect_set(F.struct(order.alias("seq"), F.col(value).alias("at")))).getField("at").alias("asked"))
    return asked, F.try_element_at(F.filter("asked", fits), F.lit(1))


def close_properties(state: DataFrame, closings: DataFrame) -> DataFrame:
    """(object_id, property, until): open rows that began before get that end; of several ends of a key the first that is later than the
    row's start, by ``seq`` if the table has it, else the earliest. Null ends and keys close nothing."""
    asked, until = _first_of(closings.where("until IS NOT NULL"), "until", lambda u: u > F.col("valid_from"))
    rows = state.join(asked, ["object_id", "property"], "left")
    return rows.withColumn("valid_to", F.when(temporal.is_current(), F.coalesce(until, "valid_to")).otherwise(F.col("valid_to"))).select(*STATE)


def retract_properties(state: DataFrame, retractions: DataFrame) -> DataFrame:
    """(object_id, property, at): open rows are retracted; by the first of several retractions of a key, by ``seq`` if the table has it, else the earliest."""
    asked, at = _first_of(retractions.where("at IS NOT NULL"), "at", lambda _: F.lit(True))
    rows = state.join(asked, ["object_id", "property"], "left")
    return rows.withColumn("retracted_at", F.when(temporal.is_current(), at).otherwise(F.col("retracted_at"))).select(*STATE)


def property_log(before: DataFrame, after: DataFrame) -> DataFrame:
    """(op, KEY, valid_from, n): rows that writes set, ended or retracted, from the tables before and after them."""
    count = lambda df, sign: df.select(*KEY, "valid_from", F.lit(sign).alias("n"), F.when(F.col("valid_to").isNotNull(), sign).otherwise(0).alias("closed"), F.when(F.col("retracted_at").isNotNull(), sign).otherwise(0).alias("retracted"))
    rows = count(before, -1).unionByName(count(after, 1)).groupBy(*KEY, "valid_from").agg(*(F.sum(c).alias(c) for c in ("n", "closed", "retracted")))
    each = F.array(*(F.struct(F.lit(op).alias("op"), F.col(c).alias("n")) for op, c in (("SET_PROPERTY", "n"), ("CLOSE_PROPERTY", "closed"), ("RETRACT_PROPERTY", "retracted"))))
    return rows.select(*KEY, "valid_from", F.explode(each).alias("x")).where("x.n > 0").select("x.op", *KEY, "valid_from", "x.n")


def create_objects(objects: DataFrame, new: DataFrame, types: DataFrame, required: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason) of (type, external_id, ...): abstract types, taken keys and missing required properties are out.

    ``types`` (type, is_abstract), ``required`` (type, property), ``given`` (type, external_id, property).
    """
    key = ["type", "external_id"]
    rows = new.join(F.broadcast(types.select("type", "is_abstract")), "type", "left")
    taken = objects.where("deleted_at IS NULL").select(*key, F.lit(True).alias("taken")).distinct()
    rows = rows.join(taken, key, "left").withColumn("nth", F.row_number().over(W.partitionBy(*key).orderBy("valid_from", "seq")))
    missing = new.select(*key).distinct().join(F.broadcast(required), "type").join(given.select(*key, "property").distinct(), [*key, "property"], "left_anti")
    missing = missing.groupBy(*key).agg(F.sort_array(F.collect_list("property")).alias("missing"))
    rows = rows.join(missing, key, "left")
    reason = F.when(F.col("is_abstract").isNull(), "UNKNOWN_TYPE").when(F.col("is_abstract"), "ABSTRACT_TYPE").when(F.col("taken") | (F.col("nth") > 1), "DUPLICATE_OBJECT").when(F.size("missing") > 0, "MISSING_REQUIRED")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason IS NULL").select(*new.columns), rows.where("reason IS NOT NULL").select(*new.columns, "reason")


def find_or_create(objects: DataFrame, new: DataFrame) -> DataFrame:
    """All live objects, and those of ``new`` whose key none has."""
    live = objects.where("deleted_at IS NULL")
    fresh = new.dropDuplicates(["type", "external_id"]).join(live.select("type", "external_id"), ["type", "external_id"], "left_anti")
    return live.unionByName(fresh, allowMissingColumns=True)


def delete_objects(objects: DataFrame, deletions: DataFrame) -> DataFrame:
    """(object_id, at): stamped as deleted, unless they were before."""
    rows = objects.join(deletions.groupBy("object_id").agg(F.min("at").alias("at")), "object_id", "left")
    return rows.withColumn("deleted_at", F.coalesce("deleted_at", "at")).select(*objects.columns)


LINK = ("link_type", "from_id", "to_id", "weight", "valid_from", "valid_to", "recorded_at", "retracted_at")


class _Links:
    """Links that compete for sources or targets, as assertions come one after another."""

    def __init__(self, of_source: bool, of_target: bool, symmetric: bool):
        self.of_source, self.of_target, self.symmetric = of_source, of_target, symmetric
        self.open: dict[tuple, dict] = {}
        #: Open links of each source and target that may have one only: (start, a number, pair), in order.
        self.by: dict[tuple, list[tuple]] = {}
        self.added = 0
        #: Last ends of pairs that a later row may begin before.
        self.ended: dict[tuple, pd.Timestamp] = {}
        self.most = 1000

    def _sides(self, pair: tuple) -> list[tuple]:
        return [("from", pair[0])] * self.of_source + [("to", pair[1])] * self.of_target

    def _add(self, r: dict) -> None:
        pair = (r["from_id"], r["to_id"])
        self.added += 1
        self.open[pair] = r | {"nth": self.added}
        for side in self._sides(pair):
            insort(self.by.setdefault(side, []), (r["valid_from"], self.added, pair))

    def _close(self, pair: tuple, at: pd.Timestamp, ahead: pd.Timestamp | None) -> tuple:
        r = self.open.pop(pair)
        for side in self._sides(pair):
            held = self.by[side]
            del held[bisect_left(held, (r["valid_from"], r["nth"]))]
            if not held:
                del self.by[side]
        self._end(pair, at, ahead)
        return self._out(r | {"valid_to": at}, "state", None)

    def _end(self, pair: tuple, at: pd.Timestamp, ahead: pd.Timestamp | None) -> None:
        """Holds an end if a row to come begins before it (``ahead`` is the earliest begin of these), and drops those that none does any more."""
        if ahead is None or at <= ahead:
            return
        self.ended[pair] = max(at, self.ended.get(pair, at))
        if len(self.ended) > self.most:
            self.ended = {p: to for p, to in self.ended.items() if to > ahead}
            self.most = 1000 + 2 * len(self.ended)

    def put(self, a: dict) -> list[tuple]:
        pair, start, ahead = (a["from_id"], a["to_id"]), a["valid_from"], a["ahead"]
        if a["old"]:
            if a["retracted_at"] is None and a["valid_to"] is None and pair not in self.open:
                self._add(a)
                return []
            if a["retracted_at"] is None and a["valid_to"] is not None:
                self._end(pair, a["valid_to"], ahead)
            return [self._out(a, "state", None)]
        if pair in self.open:
            return []
        back = pair[::-1]
        new = [pair, back] if self.symmetric and back not in self.open else [pair]
        if any(p in self.ended and self.ended[p] > start for p in new):
            return [self._out(a, "reject", "TEMPORAL_CONFLICT")]
        out = []
        for side in self._sides(pair):
            held = self.by.get(side, ())
            out += [self._close(p, start, ahead) for _, _, p in held[: bisect_left(held, (start,))]]
        for f, t in new:
            self._add(a | {"from_id": f, "to_id": t, "valid_to": None, "retracted_at": None})
        return out

    def end(self) -> list[tuple]:
        return [self._out(r, "state", None) for r in self.open.values()]

    @staticmethod
    def _out(r: dict, kind: str, reason: str | None) -> tuple:
        return (*(r[c] for c in LINK), r["seq"], kind, reason)


def apply_links(assertions: DataFrame, cardinality: str, symmetric: bool = False, state: DataFrame | None = None) -> Applied:
    """Links of each type after assertions (link_type, from_id, to_id, weight, valid_from, recorded_at, seq), as one by one in (recorded_at, seq) order.

    A link that is open is not asserted again. Where a source may have one target (ONE_TO_ONE, MANY_TO_ONE), or a target one
    source (ONE_TO_ONE, ONE_TO_MANY), a link ends the other open ones of its source or target that began before it; those that begin later or
    at the same instant stay open. A link to itself is rejected (SELF_LINK), and one that would overlap an ended link of the same pair
    (TEMPORAL_CONFLICT). Symmetric types get the reverse link too, unless it is open; it ends no other. ``state`` holds links from before.

    Where the links of a source or target come in order, windows on either side tell which are open, and nothing is gathered. What competes with
    a late link is folded: the rows of a source, a target, a pair or, one to one, of all that compete with each other,
    stream through a task, which holds the open links and the last ends of pairs that a row to come begins before.
    """
    order = ["recorded_at", "seq", "valid_from", "from_id", "to_id"]
    asserted = assertions.select("link_type", "from_id", "to_id", "weight", "valid_from", "recorded_at", F.col("seq").cast("long").alias("seq"))
    selfs = asserted.where("from_id = to_id")
    none = F.lit(None).cast("timestamp")
    new = asserted.where("from_id <> to_id").select(*LINK[:5], none.alias("valid_to"), "recorded_at", none.alias("retracted_at"), "seq", F.lit(False).alias("old"))
    old = (state if state is not None else new.limit(0)).select(*LINK, F.lit(None).cast("long").alias("seq"), F.lit(True).alias("old"))
    of_source = cardinality in ("ONE_TO_ONE", "MANY_TO_ONE")
    of_target = cardinality in ("ONE_TO_ONE", "ONE_TO_MANY")
    sides = [["link_type", "from_id"]] * of_source + [["link_type", "to_id"]] * of_target or [["link_type", "from_id", "to_id"]]
    if symmetric and (of_source or of_target or state is not None):
        rows, special = new.unionByName(old), None
    else:
        if symmetric:
            new = new.unionByName(new.select(*(F.col({"from_id": "to_id", "to_id": "from_id"}.get(c, c)).alias(c) for c in new.columns))).dropDuplicates(["link_type", "from_id", "to_id", "seq"])
        rows = new.unionByName(old)
        # in doubt: a side's link that begins before the one before it; links from before that share a side; ended links of the pair
        current = temporal.is_current()
        doubt = F.lit(False)
        for side in sides:
            over = W.partitionBy(*side).orderBy(F.desc("old"), *order)
            before = F.lag(F.struct("valid_from", "from_id", "to_id", "old")).over(over)
            other = (before["from_id"] != F.col("from_id")) | (before["to_id"] != F.col("to_id"))
            doubt = doubt | F.coalesce((before["valid_from"] > F.col("valid_from")) & (~F.col("old") | other) | before["old"] & F.col("old"), F.lit(False))
        live = rows.where(current).withColumn("doubt", doubt)
        ended = old.where("retracted_at IS NULL AND valid_to IS NOT NULL").groupBy("link_type", "from_id", "to_id").agg(F.max("valid_to").alias("ended"))
        live = live.join(ended, ["link_type", "from_id", "to_id"], "left").withColumn("doubt", F.col("doubt") | F.coalesce(F.col("ended") > F.col("valid_from"), F.lit(False))).drop("ended")
        special = graph.cut(live.where("doubt").select("link_type", "from_id", "to_id").distinct())
    group = {(True, False): F.array("link_type", "from_id"), (False, True): F.array("link_type", "to_id")}.get((of_source, of_target), F.array("link_type", F.least("from_id", "to_id"), F.greatest("from_id", "to_id")))
    competing = of_source and of_target or symmetric and (of_source or of_target)

    def grouped(rows: DataFrame) -> DataFrame:
        """Rows with all that competes with them, directly or not, in one ``group``."""
        if not competing:
            return rows.withColumn("group", group)
        tag = (lambda c, _: F.concat_ws("\u0001", "link_type", c)) if symmetric else (lambda c, side: F.concat_ws("\u0001", F.lit(side), "link_type", c))
        found = graph.components(rows.select(tag("from_id", "F").alias("a"), tag("to_id", "T").alias("b")).distinct()).withColumnRenamed("component", "found")
        rows = rows.withColumn("node", tag("from_id", "F")).join(found, "node", "left")
        return rows.withColumn("group", F.array(F.coalesce("found", "node"))).drop("node", "found")

    def split(rows: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of the groups that hold none of these pairs, and of those that do."""
        rows = graph.cut(grouped(rows))
        groups = rows.join(pairs, ["link_type", "from_id", "to_id"], "left_semi").select("group").distinct()
        return rows.join(groups, "group", "left_anti"), rows.join(groups, "group", "left_semi")

    plain = None
    if special is None:
        rows = graph.cut(grouped(rows))
    else:
        plain, rows = (rows, rows.limit(0).withColumn("group", group)) if special.isEmpty() else split(rows, special)
        if of_source or of_target:
            plain = _told(plain.drop("group"), sides)
            stuck = graph.cut(plain.where("added IS NULL").select("link_type", "from_id", "to_id").distinct())
            if not stuck.isEmpty():
                plain, more = split(plain, stuck)
                rows = rows.unionByName(more.drop("added"))
    schema = "link_type string, from_id string, to_id string, weight double, valid_from timestamp, valid_to timestamp, recorded_at timestamp, retracted_at timestamp, seq long, kind string, reason string"
    names = [f"{c} {dict(rows.dtypes)[c]}" if c in LINK else f"{c} {t}" for c, t in (x.split() for x in schema.split(", "))]
    folded = graph.cut(ordered.fold(rows.withColumn("group", F.col("group").cast("string")), ["group"], [~F.col("old"), *order], lambda: _Links(of_source, of_target, symmetric), ", ".join(names), F.when(~F.col("old"), F.col("valid_from"))))
    out = folded.where("kind = 'state'").select(*LINK)
    if plain is not None:
        out = out.unionByName(_windowed_links(plain, sides) if of_source or of_target else _first_links(plain))
    reject = lambda df, reason: df.select("link_type", "from_id", "to_id", "weight", "valid_from", "recorded_at", "seq", reason.alias("reason"))
    rejects = reject(folded.where("kind = 'reject'"), F.col("reason")).unionByName(reject(selfs, F.lit("SELF_LINK")))
    return Applied(out, rejects)


#: Rounds after which links that still wait for others are folded.
ROUNDS = 24


def _told(rows: DataFrame, sides: list[list[str]]) -> DataFrame:
    """Links that come in order, with ``added``: false where the pair is open already, null where ``ROUNDS`` rounds couldn't tell.

    After a pair's first link it is open, until a link that is added on one of its sides begins later than it. So all first links are added. A later
    one waits; it is added if on its sides a link before it that is added begins later than the pair's last one that may be. If none of
    those that wait is, they may still be by each other: through a link of a pair whose open link isn't told yet, or one that such a link
    may bring about. Where that leads nowhere, a link isn't added. Only what waits goes on to the next round, with what was added before it.
    """
    order = (F.desc("old"), "recorded_at", "seq", "valid_from", "from_id", "to_id")
    before = lambda *key: W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    latest = lambda which, *key: F.max(F.when(F.expr(which), F.col("valid_from"))).over(before(*key))
    pair, names = ("link_type", "from_id", "to_id"), [f"side{n}" for n in range(len(sides))]
    later = lambda than, got: F.coalesce(F.greatest(F.lit(False), *(c > F.col(than) for c in got)), F.lit(False))
    kept = [*LINK, "seq", "old"]
    # by source, so that pairs and sources need no other shuffle
    rows = rows.withColumn("live", temporal.is_current()).repartition("link_type", "from_id")
    rows = rows.withColumn("first", F.col("live") & latest("live", *pair).isNull())
    rows = graph.cut(rows.withColumns({"was": latest("first", *pair)} | {c: latest("first", *side) for c, side in zip(names, sides, strict=True)}))
    told = rows.where("first OR NOT live").select(*kept, F.col("first").alias("added"))
    waiting = rows.where("live AND NOT first").select(*kept, "was", *names, F.lit(False).alias("maybe"))
    for _ in range(ROUNDS):
        w = waiting.withColumn("may", F.greatest("was", latest("true", *pair)))
        w = w.withColumn("now", later("may", map(F.col, names))).withColumn("maybe_now", F.col("maybe") | F.col("now") | (F.col("may") > F.col("was")))
        w = w.withColumn("next", ~F.col("now") & (F.col("maybe_now") | later("was", (latest("maybe_now", *side) for side in sides))))
        w = w.withColumns({f"{c}_now": F.greatest(c, latest("now", *side)) for c, side in (("was", pair), *zip(names, sides, strict=True))})
        w = graph.cut(w)
        n, now, more = w.agg(F.count(F.lit(1)), F.count_if("now"), F.count_if(F.col("next") & ~F.col("maybe"))).first()
        if not n:
            break
        if now:
            told = told.unionByName(w.where("now").select(*kept, F.lit(True).alias("added")))
            waiting = w.where("NOT now").select(*kept, *(F.col(f"{c}_now").alias(c) for c in ("was", *names)), F.lit(False).alias("maybe"))
        elif more:
            waiting = w.select(*kept, "was", *names, F.col("next").alias("maybe"))
        else:
            told = told.unionByName(w.where("NOT next").select(*kept, F.lit(False).alias("added")))
            waiting = w.where("next").select(*kept, "was", *names, F.lit(False).alias("maybe"))
    return told.unionByName(waiting.select(*kept, F.lit(None).cast("boolean").alias("added")))


def _windowed_links(rows: DataFrame, sides: list[list[str]]) -> DataFrame:
    """Links that come in order, of which it is told which are ``added``: each ends with the next that begins later on either side."""
    done, rows = rows.where(~temporal.is_current()), rows.where("added")
    ends = []
    for side in sides:
        ends.append(f"end_{side[-1]}")
        # from the last begin to the first: a frame to the end would be read anew for every row
        later = W.partitionBy(*side).orderBy(F.unix_micros("valid_from").desc()).rangeBetween(W.unboundedPreceding, -1)
        rows = rows.withColumn(ends[-1], F.min("valid_from").over(later))
    end = F.least(*map(F.col, ends)) if len(ends) > 1 else F.col(ends[0])
    return rows.withColumn("valid_to", end).select(*LINK).unionByName(done.select(*LINK))


def _first_links(rows: DataFrame) -> DataFrame:
    """The first of each pair's links, which nothing ends."""
    done, rows = rows.where(~temporal.is_current()), rows.where(temporal.is_current())
    nth = F.row_number().over(W.partitionBy("link_type", "from_id", "to_id").orderBy(F.desc("old"), "recorded_at", "seq", "valid_from", "from_id", "to_id"))
    return rows.withColumn("nth", nth).where("nth = 1").select(*LINK).unionByName(done.select(*LINK))


def link_objects(assertions: DataFrame, cardinality: str, symmetric: bool = False, state: DataFrame | None = None) -> DataFrame:
    """The links after ``apply_links``."""
    return apply_links(assertions, cardinality, symmetric, state).state


def unlink_objects(links: DataFrame, ends: DataFrame, symmetric: bool = False) -> DataFrame:
    """(link_type, from_id, to_id, until): open links that began before get that end, both directions if symmetric; of several
    ends of one link, the earliest that is later than its start."""
    e = ends.select("link_type", "from_id", "to_id", "until")
    if symmetric:
        e = e.union(e.select("link_type", "to_id", "from_id", "until"))
    e = e.groupBy("link_type", "from_id", "to_id").agg(F.sort_array(F.collect_set("until")).alias("untils"))
    rows = links.join(e, ["link_type", "from_id", "to_id"], "left")
    until = F.try_element_at(F.filter("untils", lambda u: u > F.col("valid_from")), F.lit(1))
    return rows.withColumn("valid_to", F.when(temporal.is_current(), F.coalesce(until, "valid_to")).otherwise(F.col("valid_to"))).select(*links.columns)


def object_log(before: DataFrame, after: DataFrame) -> DataFrame:
    """(op, object_id): objects that a write made or deleted, from the tables before and after it."""
    was = before.select("object_id", F.lit(True).alias("was"), F.col("deleted_at").alias("was_deleted"))
    rows = after.select("object_id", "deleted_at").join(was, "object_id", "left")
    made, gone = F.when(F.col("was").isNull(), "CREATE_OBJECT"), F.when(F.col("deleted_at").isNotNull() & F.col("was_deleted").isNull(), "DELETE_OBJECT")
    return rows.select(F.explode(F.array_compact(F.array(made, gone))).alias("op"), "object_id")


def link_log(before: DataFrame, after: DataFrame) -> DataFrame:
    """(op, link_type, from_id, to_id, valid_from): links that a write added, closed or retracted."""
    key = ["link_type", "from_id", "to_id", "valid_from"]
    was = before.select(*key, F.lit(True).alias("was"), F.col("valid_to").alias("was_to"), F.col("retracted_at").alias("was_retracted"))
    rows = after.select(*key, "valid_to", "retracted_at").join(was, key, "left")
    kinds = F.array(
        F.when(F.col("was").isNull(), "ADD_LINK"), F.when(F.col("valid_to").isNotNull() & F.col("was_to").isNull(), "CLOSE_LINK"),
        F.when(F.col("retracted_at").isNotNull() & F.col("was_retracted").isNull(), "RETRACT_LINK"),
    )
    return rows.select(F.explode(F.array_compact(kinds)).alias("op"), *key)


def check_invariants(rows: DataFrame, rules: dict[str, Column | str]) -> DataFrame:
    """``rows`` with ``violations``: the names of the rules, Columns or SQL, that don't hold (null counts as holding)."""
    tests = {name: F.expr(rule) if isinstance(rule, str) else rule for name, rule in rules.items()}
    return rows.withColumn("violations", F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in tests.items()))))


BAR_RULES = {
    "high_is_highest": "high >= greatest(open, close, low)", "low_is_lowest": "low <= least(open, close, high)",
    "no_negative_volume": "volume >= 0 AND quote_volume >= 0 AND trade_count >= 0", "closes_after_open": "close_time > open_time",
}
VALUE_RULES = {"valid_range": "valid_from < valid_to", "retracted_after_recorded": "retracted_at >= recorded_at", "confidence": "confidence BETWEEN 0 AND 1"}
_TYPED = ("value_text", "value_numeric", "value_bool", "value_ts", "value_json", "value_ref")
#: For values in a column for each kind, as ``decode.values`` makes them.
TYPED_VALUE_RULES = VALUE_RULES | {"one_value": f"{' + '.join(f'int({c} IS NOT NULL)' for c in _TYPED)} = 1"}
LINK_RULES = VALUE_RULES | {"no_self_link": "from_id <> to_id"}
NEWS_RULES = {"sentiment": "sentiment BETWEEN -1 AND 1", "materiality": "materiality BETWEEN 0 AND 1"}
VINTAGE_RULES = {"has_value": "value IS NOT NULL", "vintage_order": "vintage_from < vintage_to"}
CALL_RULES = {"tokens": "input_tokens >= 0 AND output_tokens >= 0", "cached_within_input": "cached_input_tokens <= input_tokens"}


def validate_values(rows: DataFrame, properties: DataFrame) -> DataFrame:
    """Rows (type, property, raw) with ``violations``: unknown property, type mismatch, enum, length, pattern, bounds.

    ``properties``: (type, property, data_type, enum_values, min_length, max_length, pattern, min_value, max_value).
    """
    p = rows.join(F.broadcast(properties), ["type", "property"], "left")
    raw, kind = F.col("raw"), F.col("data_type")
    number = raw.try_cast("decimal(38,12)")
    well = (
        F.when(kind == "DECIMAL", number.isNotNull()).when(kind == "INTEGER", number.isNotNull() & (number == F.floor(number)))
        .when(kind == "BOOLEAN", raw.isin("true", "false")).when(kind == "TIMESTAMP", raw.try_cast("timestamp").isNotNull()).when(kind == "DATE", raw.try_cast("date").isNotNull())
        .when(kind == "JSON", F.try_parse_json(raw).isNotNull()).when(kind == "REFERENCE", raw.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).otherwise(F.lit(True))
    )
    tests = {
        "UNKNOWN_PROPERTY": kind.isNotNull(), "NULL_VALUE": raw.isNotNull(), "TYPE": well, "ENUM": (kind != "ENUM") | F.array_contains("enum_values", raw),
        "MIN_LENGTH": F.length(raw) >= F.col("min_length"), "MAX_LENGTH": F.length(raw) <= F.col("max_length"),
        "PATTERN": F.col("pattern").isNull() | F.regexp_like(raw, F.concat(F.lit("^(?:"), F.col("pattern"), F.lit(")$"))),
        "MIN": number >= F.col("min_value"), "MAX": number <= F.col("max_value"),
    }
    return check_invariants(p, tests).select(*rows.columns, "violations")
