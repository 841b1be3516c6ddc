"""Decoders of landed payloads: one column of raw bodies in, typed rows out; what can't be read is left out or named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def klines(raw: DataFrame, now: Column, until: Column | None = None) -> DataFrame:
    """Bars from JSON arrays of [openMs, o, h, l, c, volume, closeMs, quote, trades, takerBuy, ...]; final if closed before ``now``."""
    rows = raw.select("instrument_id", "timeframe", F.explode(F.from_json("body", "array<array<string>>")).alias("k")).where(F.size("k") >= 10)
    price, amount = "decimal(24,12)", "decimal(30,12)"
    ms = lambda i: F.timestamp_millis(F.col("k")[i].try_cast("long"))
    out = rows.select(
        "instrument_id", "timeframe", ms(0).alias("open_time"), ms(6).alias("close_time"), *(F.col("k")[i].try_cast(price).alias(c) for i, c in enumerate(("open", "high", "low", "close"), 1)),
        F.col("k")[5].try_cast(amount).alias("volume"), F.col("k")[7].try_cast(amount).alias("quote_volume"), F.col("k")[8].try_cast("long").alias("trade_count"), F.col("k")[9].try_cast(amount).alias("taker_buy_base"),
    ).where("open_time IS NOT NULL AND close IS NOT NULL")
    if until is not None:
        out = out.where(F.col("open_time") < until)
    return out.withColumn("is_final", F.col("close_time") < now)


def exchange_info(raw: DataFrame) -> DataFrame:
    """Instrument specs from {"symbols": [...]}: rules picked from each filters array, with defaults."""
    kind = "struct<symbols:array<struct<symbol:string,baseAsset:string,quoteAsset:string,status:string,filters:array<map<string,string>>>>>"
    s = raw.select("exchange", F.explode(F.from_json("body", kind)["symbols"]).alias("s")).select("exchange", "s.*")
    pick = lambda types, name, default: F.coalesce(F.try_element_at(F.transform(F.filter("filters", lambda f: f["filterType"].isin(*types)), lambda f: f[name]), F.lit(1)).try_cast("decimal(24,12)"), F.lit(default).cast("decimal(24,12)"))
    status = F.when(F.col("status") == "TRADING", "TRADING").when(F.col("status").isin("HALT", "BREAK", "AUCTION_MATCH", "PRE_TRADING", "POST_TRADING"), "HALT").when(F.col("status").isin("DELISTED", "END_OF_DAY"), "DELISTED").otherwise("UNKNOWN")
    return s.select("exchange", "symbol", F.col("baseAsset").alias("base_asset"), F.col("quoteAsset").alias("quote_asset"), status.alias("status"), pick(("PRICE_FILTER",), "tickSize", "0.00000001").alias("tick_size"), pick(("LOT_SIZE",), "stepSize", "0.00000001").alias("step_size"), pick(("MIN_NOTIONAL", "NOTIONAL"), "minNotional", "0").alias("min_notional"))


_DATES = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm z")
_TEXTS = lambda *names: ",".join(f"`{n}`:array<string>" for n in names)
_ITEM = f"array<struct<{_TEXTS('link', 'title', 'description', 'content:encoded', 'pubDate', 'dc:date')}>>"
_ENTRY = f"array<struct<link:array<struct<_href:string,_rel:string>>,{_TEXTS('id', 'title', 'summary', 'content', 'published', 'updated')}>>"


def feeds(raw: DataFrame) -> DataFrame:
    """(feed_id, url, title, summary, body, published_at, reason) from RSS items, in a channel or beside it, else Atom entries.

    Bodies are read by Spark's XML parser; those that declare a DOCTYPE are refused and those that are no XML are named, each as one row
    without item. An item needs a url and a title. Its time is the fetch's if it has none with a zone. A body's items come by time, those that lack
    something last.
    Markup within an element stays as it is written.
    """
    # a declaration stands before the first element; in an item's text it is text
    refused = F.coalesce(F.col("body").rlike(r"^\s*(?:<\?[^>]*\?>\s*|<!--(?:(?!-->)[\s\S])*+-->\s*)*<!DOCTYPE"), F.lit(False))
    kind = f"channel array<struct<item:{_ITEM}>>, item {_ITEM}, entry {_ENTRY}, __corrupt string"
    parsed = F.from_xml(F.when(~F.col("refused"), F.col("body")), kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"})
    rows = raw.select("feed_id", "fetched_at", "body", refused.alias("refused")).withColumn("x", parsed)
    none = lambda kind: F.array().cast(kind)
    items = F.concat(F.coalesce(F.flatten(F.filter(F.transform("x.channel", lambda c: c["item"]), lambda i: i.isNotNull())), none(_ITEM)), F.coalesce("x.item", none(_ITEM)))
    rows = rows.select("feed_id", "fetched_at", "refused", (F.col("body").isNull() | F.col("x.__corrupt").isNotNull()).alias("bad"), items.alias("items"), F.coalesce("x.entry", none(_ENTRY)).alias("entries"))

    def first(x: Column, *names: str) -> Column:
        """The text of the first of these elements that has any."""
        texts = (F.regexp_replace(F.try_element_at(x[n], F.lit(1)), r"^[\x00-\x20]+|[\x00-\x20]+$", "") for n in names)
        return F.coalesce(*(F.when(t != "", t) for t in texts))

    def time(x: Column, *names: str) -> Column:
        when = first(x, *names)
        day = F.regexp_replace(when, "^[A-Za-z]{3}, *", "")
        zoned = F.when(when.rlike(r"^\d{4}-\d\d-\d\dT.*(?:Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(when))
        return F.coalesce(*(F.try_to_timestamp(day, F.lit(p)) for p in _DATES), zoned, F.col("fetched_at"))

    def read(x: Column, i: Column, url: Column, summary: str, body: tuple, times: tuple) -> Column:
        lacks = url.isNull() | first(x, "title").isNull()
        return F.struct(lacks.alias("lacks"), time(x, *times).alias("published_at"), i.alias("i"), url.alias("url"), first(x, "title").alias("title"), first(x, summary).alias("summary"), first(x, *body).alias("body"))

    href = lambda x: F.try_element_at(F.filter(x["link"], lambda k: (F.coalesce(k["_rel"], F.lit("")).isin("", "alternate")) & (F.trim(k["_href"]) != "")), F.lit(1))["_href"]
    rss = F.transform("items", lambda x, i: read(x, i, first(x, "link"), "description", ("content:encoded", "description"), ("pubDate", "dc:date")))
    atom = F.transform("entries", lambda x, i: read(x, i, F.coalesce(href(x), first(x, "id")), "summary", ("content", "summary"), ("published", "updated")))
    found = F.array_sort(F.when(F.size("items") > 0, rss).otherwise(atom))
    # what was refused or couldn't be read has a row too
    found = F.when(F.col("refused") | F.col("bad"), F.array(F.lit(None))).otherwise(found)
    out = rows.select("feed_id", "fetched_at", "refused", "bad", F.explode(found).alias("n"))
    reason = F.when(F.col("refused"), "DOCTYPE").when(F.col("bad"), "BAD_XML").when(F.col("n.lacks"), "NO_URL_OR_TITLE")
    return out.select("feed_id", *(F.col(f"n.{c}") for c in ("url", "title", "summary", "body")), F.coalesce("n.published_at", "fetched_at").alias("published_at"), reason.alias("reason"))


def vintages(raw: DataFrame) -> DataFrame:
    """Raw observations of {"observations": [...]}; those without a number are left out."""
    kind = "struct<observations:array<struct<date:string,value:string,realtime_start:string,realtime_end:string>>>"
    o = raw.select("series", F.explode(F.from_json("body", kind)["observations"]).alias("o")).select("series", "o.*")
    dates = [F.col(c).try_cast("date").alias(c) for c in ("date", "realtime_start", "realtime_end")]
    return o.select("series", dates[0], "value", *dates[1:]).where("date IS NOT NULL AND realtime_start IS NOT NULL AND trim(value) NOT IN ('', '.') AND try_cast(value AS decimal(38,12)) IS NOT NULL")


def series_meta(raw: DataFrame) -> DataFrame:
    """The first element of {"seriess": [...]}, with defaults."""
    first = F.try_element_at(F.from_json("body", "struct<seriess:array<struct<id:string,title:string,units:string,frequency:string>>>")["seriess"], F.lit(1))
    return raw.select("series", F.coalesce(first["id"], "series").alias("id"), F.coalesce(first["title"], "series").alias("title"), F.coalesce(first["units"], F.lit("")).alias("units"), F.coalesce(first["frequency"], F.lit("")).alias("frequency"))


def values(rows: DataFrame) -> DataFrame:
    """Raw text values (raw, data_type) in typed columns, one of them set, with a reason where none is."""
    raw, kind = F.col("raw"), F.col("data_type")
    day = F.coalesce(raw.try_cast("date"), F.to_date(raw.try_cast("timestamp"))).cast("timestamp")
    typed = {
        "value_text": F.when(kind.isin("STRING", "TEXT", "ENUM"), raw), "value_numeric": F.when(kind.isin("DECIMAL", "INTEGER"), raw.try_cast("decimal(38,12)")),
        "value_bool": F.when(kind == "BOOLEAN", F.when(F.lower(raw) == "true", True).when(F.lower(raw) == "false", False)), "value_ts": F.when(kind == "TIMESTAMP", raw.try_cast("timestamp")).when(kind == "DATE", day),
        "value_ref": F.when((kind == "REFERENCE") & raw.rlike("(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), raw), "value_json": F.when((kind == "JSON") & F.try_parse_json(raw).isNotNull(), raw),
    }
    out = rows.withColumns(typed)
    return out.withColumn("reason", F.when(raw.isNull(), "NULL").when(F.coalesce(*(F.col(c).cast("string") for c in typed)).isNull(), "NOT_A_VALUE"))
