"""The ledger of model calls: normalisation, cost, spend, budget, and responses made to fit a declared schema."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronark.functions import text

MOST_CHARS, MARKER = 16_000, "...[truncated]"


def normalise(calls: DataFrame) -> DataFrame:
    """Prompt hash and size, cost, texts cut to 16 000 characters; from (call_id, instruction, data, response_raw, *_tokens)."""
    prompt = F.concat_ws(" ", "instruction", "data")
    cost = text.call_cost(F.col("input_tokens"), F.col("cached_input_tokens"), F.col("output_tokens"))
    return calls.withColumn("prompt_sha256", F.sha2(prompt, 256)).withColumn("prompt_chars", F.length(prompt)).withColumn("cost", cost).withColumn("response_raw", text.truncate(F.col("response_raw"), MOST_CHARS, MARKER)).drop("instruction", "data")


def spend_by_purpose(calls: DataFrame, now: Column) -> DataFrame:
    """Month-to-date cost of each purpose (UTC month of ``now``)."""
    return calls.where((F.col("occurred_at") >= F.date_trunc("month", now)) & (F.col("occurred_at") <= now)).groupBy("purpose").agg(F.sum("cost").alias("spend"), F.count(F.lit(1)).alias("calls"))


def budget_gate(calls: DataFrame, limit: str) -> DataFrame:
    """``calls`` with ``refused``: the month's cost before the call had reached the limit. For ledgers of accepted calls.

    Costs are first summed by day, so a task orders one day's calls, not a month's.
    """
    rows = calls.withColumn("month", F.date_trunc("month", "occurred_at")).withColumn("day", F.to_date("occurred_at"))
    days = rows.groupBy("month", "day").agg(F.sum("cost").alias("of_day"))
    days = days.withColumn("before_day", F.coalesce(F.sum("of_day").over(W.partitionBy("month").orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("day", "before_day")
    within = F.coalesce(F.sum("cost").over(W.partitionBy("month", "day").orderBy("occurred_at", "call_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("within", within).join(days, "day")
    return rows.withColumn("spent_before", F.col("before_day") + F.col("within")).withColumn("refused", F.col("spent_before") >= F.lit(limit).cast("decimal(20,8)")).drop("month", "day", "within", "before_day")


def replay_budget(calls: DataFrame, limit: float | str) -> DataFrame:
    """(call_id, refused): like ``budget_gate`` where refused calls cost nothing. Costs are never negative: up to the call with
    which a month's limit is reached none is refused, and after it all are, so both say the same of every call."""
    return budget_gate(calls, str(limit)).select("call_id", "refused")


# conforming


@dataclass
class Field:
    """kind: NUMBER, INTEGER, TEXT, BOOLEAN, ENUM, TEXT_LIST or OBJECT_LIST."""

    name: str
    kind: str
    required: bool = False
    low: float | None = None
    high: float | None = None
    values: tuple[str, ...] = ()
    fields: tuple[Field, ...] = ()

    def check(self, nested: bool = False) -> None:
        if self.kind == "ENUM" and not self.values:
            raise ValueError(f"{self.name}: an enum needs values")
        if (self.low is not None or self.high is not None) and self.kind not in ("NUMBER", "INTEGER"):
            raise ValueError(f"{self.name}: bounds are for numbers")
        if self.kind == "OBJECT_LIST":
            if nested:
                raise ValueError(f"{self.name}: one level of nesting only")
            for f in self.fields:
                f.check(True)


@dataclass
class Conformed:
    """A value made to fit its field, null if it can't, and whether a bound changed it."""

    value: Column
    clamped: Column = field(default_factory=lambda: F.lit(False))


def _is(v: Column, *kinds: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike(f"^({'|'.join(kinds)})"), F.lit(False))


def _raw(v: Column, f: Field) -> Column:
    """What a variant column holds for one field of any kind but lists of objects, as ``_scalar`` takes it; a column or array of its own, so that
    it is read once."""
    if f.kind in ("NUMBER", "INTEGER"):
        return F.when(~_is(v, "BOOLEAN", "OBJECT", "ARRAY"), F.try_variant_get(v, "$", "double"))
    if f.kind in ("BOOLEAN", "ENUM"):
        return F.lower(F.trim(F.try_variant_get(v, "$", "string")))
    if f.kind == "TEXT_LIST":
        plain = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda e: ~_is(e, "OBJECT", "ARRAY", "VOID"))
        listed = F.filter(F.transform(plain, lambda e: F.trim(F.try_variant_get(e, "$", "string"))), lambda t: t != "")
        alone = F.when(_is(v, "OBJECT"), F.array().cast("array<string>")).when(~_is(v, "ARRAY", "VOID"), F.array(F.try_variant_get(v, "$", "string")))
        return F.when(_is(v, "ARRAY"), listed).otherwise(alone)
    return F.try_variant_get(v, "$", "string")


def _scalar(raw: Column, f: Field) -> Conformed:
    """What ``_raw`` found, made to fit its field."""
    if f.kind in ("NUMBER", "INTEGER"):
        x = F.when(~F.isnan(raw) & (F.abs(raw) < float("inf")), raw)
        held = x
        if f.low is not None:
            held = F.greatest(held, F.when(x.isNotNull(), F.lit(float(f.low))))
        if f.high is not None:
            held = F.least(held, F.when(x.isNotNull(), F.lit(float(f.high))))
        # first within bounds, then rounded: what the bound changes is reported, what rounding changes isn't
        return Conformed(F.rint(held) if f.kind == "INTEGER" else held, F.coalesce(held != x, F.lit(False)))
    if f.kind == "BOOLEAN":
        return Conformed(F.when(raw == "true", True).when(raw == "false", False))
    if f.kind == "ENUM":
        return Conformed(F.coalesce(*(F.when(raw == value.lower(), F.lit(value)) for value in f.values)))
    return Conformed(raw)


def _tried(v: Column, f: Field) -> Column:
    """Each element of a list of objects as (item, broken, clamped names): what isn't a list counts as an empty one."""

    def read(x: Column) -> Column:
        return F.struct(_is(x, "OBJECT").alias("is_object"), *(_raw(F.try_variant_get(x, f"$.{g.name}", "variant"), g).alias(f"r{k}") for k, g in enumerate(f.fields)))

    def fit(x: Column) -> Column:
        parts = {g.name: _scalar(x[f"r{k}"], g) for k, g in enumerate(f.fields)}
        broken = ~x["is_object"]
        for g in f.fields:
            if g.required:
                broken = broken | parts[g.name].value.isNull()
        clamped = F.array_compact(F.array(*(F.when(c.clamped, F.lit(f"{f.name}.{n}")) for n, c in parts.items())))
        return F.struct(F.struct(*(c.value.alias(n) for n, c in parts.items())).alias("item"), broken.alias("broken"), clamped.alias("clamped"))

    listed = F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array().cast("array<variant>"))
    return F.transform(F.transform(listed, read), fit)


def _items(tried: Column, f: Field) -> tuple[Column, Column, Column]:
    """(items, clamped names, a name for each item dropped) of what ``_tried`` found."""
    good = F.transform(F.filter(tried, lambda x: ~x["broken"]), lambda x: x["item"])
    dropped = F.transform(F.filter(tried, lambda x: x["broken"]), lambda _: F.lit(f.name))
    return good, F.flatten(F.transform(tried, lambda x: x["clamped"])), dropped


def conform(responses: DataFrame, fields: list[Field], raw: str = "raw") -> DataFrame:
    """``responses`` with a typed column for each field, ``clamped`` and ``dropped`` names, and ``error`` if a required one is missing.

    Numbers are clamped to their bounds, integers rounded, enums matched whatever their case, a single value taken for a list; a
    scalar that doesn't fit counts as absent. Of a list of objects, items that aren't objects or miss a required field are dropped, one name
    each in ``dropped``; what bounds change in an item is reported as list.field. An empty list is a value, and anything but a list
    counts as an empty list of objects. With an error nothing is reported as clamped or dropped.
    """
    for f in fields:
        f.check()
    doc = F.try_parse_json(text.extract_json(F.col(raw)))
    # step by step, each in columns of its own: what several columns are made of is read once
    rows = responses.withColumn("__doc", doc)
    rows = rows.withColumns({f"__v{k}": F.try_variant_get("__doc", f"$.{f.name}", "variant") for k, f in enumerate(fields)})
    there = [F.col(f"__v{k}").isNotNull() & ~F.coalesce(F.is_variant_null(f"__v{k}"), F.lit(False)) for k in range(len(fields))]
    held = [F.when(there[k], F.col(f"__v{k}")) for k in range(len(fields))]
    rows = rows.withColumns({f"__r{k}": F.when(there[k], _tried(F.col(f"__v{k}"), f)) if f.kind == "OBJECT_LIST" else _raw(held[k], f) for k, f in enumerate(fields)})
    none = F.array().cast("array<string>")
    out, clamped, dropped, missing = [], [none], [none], []
    for k, f in enumerate(fields):
        r = F.col(f"__r{k}")
        if f.kind == "OBJECT_LIST":
            good, of_items, lost = _items(r, f)
            value = F.when(r.isNotNull(), good)
            clamped.append(F.when(r.isNotNull(), of_items).otherwise(none))
            dropped.append(F.when(r.isNotNull(), lost).otherwise(none))
        else:
            c = _scalar(r, f)
            value = c.value
            clamped.append(F.when(c.clamped, F.array(F.lit(f.name))).otherwise(none))
        out.append(value.alias(f.name))
        if f.required:
            missing.append(F.when(value.isNull(), F.lit(f.name)))
    absent = F.array_compact(F.array(*missing)) if missing else none
    error = F.when(F.col("__doc").isNull(), "not JSON").when(F.size(absent) > 0, F.concat(F.lit("missing: "), F.array_join(absent, ",")))
    made = rows.select(*responses.columns, *out, F.concat(*clamped).alias("clamped"), F.concat(*dropped).alias("dropped"), error.alias("error"))
    ok = lambda c: F.when(F.col("error").isNull(), F.col(c)).otherwise(none)
    return made.withColumn("clamped", ok("clamped")).withColumn("dropped", ok("dropped"))


def news_from_conformed(conformed: DataFrame, fallback: DataFrame, key: str = "seq") -> DataFrame:
    """Analyses from conformed responses with their defaults; where there is an error, the fallback's with its own extractor name.

    What the answer may leave out defaults: the event to OTHER, the horizon to DAYS, speculation to false, the summary to the item's own
    (the fallback's ``summary``). Symbols become entity ids, unknown forms are dropped. ``summary``, ``time_horizon`` and ``entities`` are
    returned if both tables have them.
    """
    cols = ["event_type", "sentiment", "speculation", "materiality"]
    cols += [c for c in ("summary", "time_horizon", "entities") if c in conformed.columns and c in fallback.columns]
    joined = conformed.join(fallback.select(key, *(F.col(c).alias(f"f_{c}") for c in cols)), key, "left")
    bad = F.col("error").isNotNull()
    own = {c: F.col(c) for c in cols} | {
        "event_type": F.coalesce("event_type", F.lit("OTHER")), "speculation": F.coalesce("speculation", F.lit(False)),
    }
    if "summary" in cols:
        own["summary"] = F.coalesce("summary", "f_summary")
    if "time_horizon" in cols:
        own["time_horizon"] = F.coalesce("time_horizon", F.lit("DAYS"))
    if "entities" in cols:
        own["entities"] = text.entity_ids(F.coalesce("entities", F.array().cast("array<string>")), "ASSET:")
    return joined.select(key, *(F.when(bad, F.col(f"f_{c}")).otherwise(own[c]).alias(c) for c in cols), F.when(bad, "heuristic").otherwise("model").alias("extractor"))


def violation_report(conformed: DataFrame) -> DataFrame:
    """(violation, n): how often each field was clamped or dropped."""
    names = F.concat("clamped", F.transform("dropped", lambda x: F.concat(F.lit("dropped:"), x)))
    return conformed.select(F.explode(names).alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))
