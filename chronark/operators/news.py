"""News: exact duplicates, clusters of near-equal headlines, events, sentiment and entities by fixed word lists."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronark.functions import text
from chronark.operators import graph, similarity
from chronark.operators.query import Catalog, Link, Property

WINDOW_H = 72
THRESHOLD = similarity.THRESHOLD
#: Keywords of event types, as they are compared with stemmed tokens. Ties go to the type listed first.
EVENTS = {
    "REGULATORY": ("sec", "regulator", "lawsuit", "court", "ban", "approval", "compliance", "legislation"),
    "MACRO": ("fed", "inflation", "cpi", "rate", "fomc", "gdp", "unemployment", "treasury", "yield"),
    "SECURITY_INCIDENT": ("hack", "exploit", "breach", "stolen", "vulnerability", "attack"),
    "LISTING": ("listing", "listed", "delist", "trading pair"),
    "PROTOCOL": ("upgrade", "fork", "mainnet", "testnet", "halving", "merge"),
    "FUNDING": ("raise", "funding", "series", "investment", "valuation"),
    "PARTNERSHIP": ("partnership", "partners", "collaboration", "integration"),
}
#: Materiality before tone and speculation.
BASE = {
    "REGULATORY": 0.45, "MACRO": 0.45, "SECURITY_INCIDENT": 0.45, "PROTOCOL": 0.35, "LISTING": 0.35,
    "FUNDING": 0.25, "PARTNERSHIP": 0.25, "MARKET_MOVE": 0.25, "OPINION": 0.15, "OTHER": 0.15,
}
#: Words of tone and of speculation.
POSITIVE = ("surge", "rally", "gain", "approval", "approved", "record", "growth", "adoption", "bullish", "upgrade", "partnership", "inflow")
NEGATIVE = ("crash", "plunge", "hack", "exploit", "ban", "lawsuit", "rejected", "delay", "delayed", "bearish", "outflow", "liquidation", "fraud")
SPECULATIVE = ("could", "might", "rumor", "rumour", "reportedly", "speculation", "may", "expected")


def ensure_schema(catalog: Catalog) -> Catalog:
    """``catalog`` with the types and links that articles and macro figures need, where they are missing; tone and weight of an article have bounds."""
    wanted = {
        "Asset": [Property("name", is_title=True), Property("symbol")],
        "NewsArticle": [
            Property("title", is_title=True), Property("url"), Property("publishedAt", "TIMESTAMP"), Property("summary", "TEXT"), Property("eventType"), Property("timeHorizon"),
            Property("sentiment", "DECIMAL", low=-1, high=1), Property("materiality", "DECIMAL", low=0, high=1), Property("speculation", "BOOLEAN"), Property("sourceCount", "INTEGER"),
        ],
        "MacroIndicator": [Property("title", is_title=True), Property("units")],
        "MacroObservation": [Property("label", is_title=True), Property("period", "DATE"), Property("value", "DECIMAL"), Property("revision", "BOOLEAN")],
    }
    for name, properties in wanted.items():
        if name not in catalog.parents:
            catalog.define_type(name)
            for p in properties:
                catalog.define_property(name, p)
    for link in (Link("MENTIONS", "NewsArticle", "Asset"), Link("OBSERVATION_OF", "MacroObservation", "MacroIndicator", "MANY_TO_ONE")):
        if link.name not in catalog.links:
            catalog.define_link(link)
    return catalog


def dedup_url(items: DataFrame) -> DataFrame:
    """The first item of each (feed, canonical url) in arrival order."""
    key = items.withColumn("canonical", text.canonical_url(F.col("url")))
    return key.withColumn("nth", F.row_number().over(W.partitionBy("feed_id", "canonical").orderBy("seq"))).where("nth = 1").drop("nth")


def dedup_content(items: DataFrame, hours: int = WINDOW_H) -> DataFrame:
    """Items whose content no accepted item of the last ``hours`` had, in arrival order.

    An item is dropped if the newest accepted publication isn't older than the window. An item later than all before it by more
    than the window is accepted whatever came before: there a content's items are split, and only the times of each part, where
    it has several, are folded.
    """
    items = items.withColumn("content", text.content_hash(F.col("title"), F.coalesce("body", F.lit(""))))
    window = F.expr(f"interval {hours} hours")
    arrival = W.partitionBy("content").orderBy("seq")
    rows = items.select("content", "seq", "published_at").withColumn("newest", F.max("published_at").over(arrival.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("free", (F.col("newest").isNull() | (F.col("newest") < F.col("published_at") - window)).cast("int"))
    rows = rows.withColumn("part", F.sum("free").over(arrival)).withColumn("size", F.count(F.lit(1)).over(W.partitionBy("content", "part")))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        newest, keep = None, []
        for at in pdf["published_at"]:
            ok = newest is None or newest < at - pd.Timedelta(hours=hours)
            keep.append(ok)
            if ok:
                newest = at if newest is None else max(newest, at)
        return pdf.loc[keep, ["content", "seq"]]

    kinds = dict(items.dtypes)
    several = rows.where("size > 1").select("content", "part", "seq", "published_at").groupBy("content", "part").applyInPandas(fold, f"content string, seq {kinds['seq']}")
    return items.join(rows.where("size = 1").select("content", "seq").unionByName(several), ["content", "seq"], "left_semi").select(*items.columns)


#: Rows of a part after which the neighbours of its sets are sent anew; sets and leaders that can't matter any more are forgotten then.
EPOCH = 4096


class _Live:
    """The clusters of one part that may still get items, while these pass in arrival order."""

    def __init__(self, seconds: float):
        self.seconds = seconds
        self.leaders: dict[int, list[int]] = {}
        self.last: dict[int, float] = {}
        self.near: dict[int, list[tuple[int, float]]] = {}

    def put(self, seq: int, at: float, of: int) -> int:
        """The leader of the cluster that an item of set ``of`` joins: the most similar alive, of equal ones the newest, else its own."""
        alive = [(s, self.last[k], -k) for other, s in [(of, 1.0), *self.near.get(of, ())] for k in self.leaders.get(other, ()) if self.last[k] >= at - self.seconds]
        if alive:
            leader = -max(alive)[2]
            self.last[leader] = max(self.last[leader], at)
            return leader
        self.last[seq] = at
        self.leaders.setdefault(of, []).append(seq)
        return seq

    def forget(self, oldest: float) -> None:
        """Drops what no item published at ``oldest`` or later can join, and the neighbours."""
        self.near.clear()
        for of, leaders in list(self.leaders.items()):
            stay = [k for k in leaders if self.last[k] >= oldest - self.seconds]
            for k in set(leaders) - set(stay):
                del self.last[k]
            if stay:
                self.leaders[of] = stay
            else:
                del self.leaders[of]


def _fold(hours: float):
    """Items of whole parts, in arrival order: batch after batch, only live clusters are held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, epoch, live = None, None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if (r.component, r.part) != part:
                    part, epoch, live = (r.component, r.part), 0, _Live(hours * 3600)
                if r.epoch != epoch:
                    epoch = r.epoch
                    live.forget(r.oldest)
                if r.near is not None:
                    live.near[r.set] = [(int(x["b"]), float(x["similarity"])) for x in r.near]
                out.append((r.seq, live.put(r.seq, r.at, r.set)))
            yield pd.DataFrame(out, columns=["seq", "cluster_seq"])

    return run


def cluster(items: DataFrame, threshold: float = THRESHOLD, hours: int = WINDOW_H) -> DataFrame:
    """(seq, cluster_seq): each item joins the most similar cluster by its first member's tokens that still gets items, or founds one.

    Equal token sets are one node. Of similar sets, those stay that may meet in a group that still gets items
    (``similarity.reachable_pairs``). Clusters lie within components of what is similar, and a component is split where all that arrives
    later is also published later than all before by more than the window: no leader lives across. A part passes one task
    in arrival order, which holds live clusters only. Items without tokens found clusters of their own.
    """
    rows = items.select("seq", F.array_sort(F.array_distinct("tokens")).alias("tokens"), F.unix_seconds("published_at").cast("double").alias("at"))
    sets = graph.cut(rows.where(F.size("tokens") > 0).groupBy("tokens").agg(F.min("seq").alias("set")))
    placed = graph.cut(rows.join(sets, "tokens").select("seq", "at", "set"))
    pairs = graph.cut(similarity.reachable_pairs(placed, sets, threshold, hours))
    near = pairs.groupBy(F.col("a").alias("of")).agg(F.collect_list(F.struct("b", "similarity")).alias("near"))
    found = graph.components(pairs)
    placed = placed.join(found.select(F.col("node").alias("set"), "component"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    arrival = W.partitionBy("component").orderBy("seq")
    # what comes later is read from the end: a frame to the end would be read anew for every row
    later = W.partitionBy("component").orderBy(F.desc("seq")).rowsBetween(W.unboundedPreceding, W.currentRow)
    newest, oldest = F.max("at").over(arrival.rowsBetween(W.unboundedPreceding, -1)), F.min("at").over(later)
    placed = placed.withColumn("newest", newest).withColumn("oldest", oldest)
    placed = placed.withColumn("free", F.coalesce(F.col("oldest") > F.col("newest") + hours * 3600, F.lit(False)).cast("int")).withColumn("part", F.sum("free").over(arrival))
    placed = placed.withColumn("epoch", F.floor((F.row_number().over(W.partitionBy("component", "part").orderBy("seq")) - 1) / EPOCH))
    nth = F.row_number().over(W.partitionBy("component", "part", "epoch", "set").orderBy("seq"))
    placed = placed.withColumn("of", F.when(nth == 1, F.col("set"))).join(near, "of", "left").select("component", "part", "epoch", "seq", "at", "oldest", "set", "near")
    out = placed.repartition("component", "part").sortWithinPartitions("component", "part", "seq").mapInPandas(_fold(hours), "seq long, cluster_seq long")
    return out.unionByName(rows.where(F.size("tokens") == 0).select("seq", F.col("seq").alias("cluster_seq")))


def cluster_counters(items: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_seq, source_count, first_at, last_at, title of the earliest)."""
    rows = items.join(clusters, "seq")
    return rows.groupBy("cluster_seq").agg(F.count(F.lit(1)).alias("source_count"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"), F.min_by("title", F.struct("published_at", "seq")).alias("title"))


def recent_clusters(counters: DataFrame, now: Column, hours: int, k: int) -> DataFrame:
    return counters.where(F.col("last_at") >= now - F.expr(f"interval {hours} hours")).orderBy(F.desc("last_at"), "cluster_seq").limit(k)


def _hits(tokens: Column, words: tuple[str, ...]) -> Column:
    return F.size(F.array_intersect(tokens, F.array(*map(F.lit, words))))


def analyze(items: DataFrame) -> DataFrame:
    """``items`` (with tokens) plus event_type, sentiment, speculation and materiality."""
    t = F.col("tokens")
    hits = [_hits(t, words) for words in EVENTS.values()]
    most = F.greatest(*hits)
    event = F.coalesce(*(F.when((h == most) & (h > 0), F.lit(name)) for name, h in zip(EVENTS, hits, strict=True)), F.lit("OTHER"))
    pos, neg = _hits(t, POSITIVE), _hits(t, NEGATIVE)
    sentiment = F.when(pos + neg > 0, (pos - neg) / (pos + neg)).otherwise(0.0)
    speculative = _hits(t, SPECULATIVE) > 0
    base = F.element_at(F.create_map(*(F.lit(x) for kv in BASE.items() for x in kv)), F.col("event_type"))
    rows = items.withColumn("event_type", event).withColumn("sentiment", sentiment).withColumn("speculation", speculative)
    return rows.withColumn("materiality", F.least(F.lit(0.5), (base + 0.1 * F.abs("sentiment")) * F.when(F.col("speculation"), 0.6).otherwise(1.0)))


def link_entities(items: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(seq, entity_id): keywords (one word or several) found as whole words in the normalized title, distinct.

    The title's word n-grams up to the longest keyword meet the dictionary in an equi-join. Each word is put behind the n-gram that ends
    before it, so a text of any length is split and passed once for each number of words.
    """
    words = F.split("normalized", " ")
    longest, n = dictionary.agg(F.coalesce(F.max(F.size(F.split("keyword", " "))), F.lit(1)), F.count(F.lit(1))).first()
    known = dictionary.select("keyword", "entity_id")
    # a dictionary of any usual size goes to the n-grams, so that these need no shuffle
    known = F.broadcast(known) if n <= 100_000 else known
    of_length = [words]
    for k in range(2, longest + 1):
        # the last ones have no word to follow: they become null
        of_length.append(F.zip_with(of_length[-1], F.slice(words, k, 1 << 30), lambda gram, word: F.concat(gram, F.lit(" "), word)))
    grams = F.array_compact(F.flatten(F.array(*of_length)))
    return items.select("seq", F.explode(F.array_distinct(grams)).alias("keyword")).join(known, "keyword").select("seq", "entity_id").distinct()


#: Properties of an article and the columns they come from.
ARTICLE = {
    "title": "title", "url": "url", "publishedAt": "published_at", "summary": "summary", "eventType": "event_type", "sentiment": "sentiment",
    "materiality": "materiality", "speculation": "speculation", "timeHorizon": "time_horizon", "sourceCount": "source_count",
}


def article_assertions(analyzed: DataFrame) -> DataFrame:
    """Property assertions of each article: valid from its publication, recorded when it was seen. An article starts with one source."""
    rows = analyzed.withColumn("source_count", F.lit(1)).withColumn("time_horizon", F.lit("DAYS"))
    rows = rows if "summary" in rows.columns else rows.withColumn("summary", F.lit(None).cast("string"))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("property"), F.col(c).cast("string").alias("value")) for name, c in ARTICLE.items()))).alias("p")
    rows = rows.select(text.external_id("NEWS", F.col("seq").cast("string")).alias("object_id"), each, F.col("published_at").alias("valid_from"), F.col("seen_at").alias("recorded_at"), "seq")
    return rows.select("object_id", "p.property", F.lit(0).alias("ordinal"), "p.value", F.lit("set").alias("op"), "valid_from", F.lit(None).cast("timestamp").alias("valid_to"), "recorded_at", "seq").where("value IS NOT NULL")


def source_count_assertions(items: DataFrame, clusters: DataFrame) -> DataFrame:
    """Of each item that joins a cluster: its article's new number of sources, valid from the cluster's latest publication so far."""
    arrival = W.partitionBy("cluster_seq").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = items.join(clusters, "seq").select("seq", "cluster_seq", "seen_at", F.count(F.lit(1)).over(arrival).alias("n"), F.max("published_at").over(arrival).alias("valid_from"))
    rows = rows.where("n > 1").withColumn("object_id", text.external_id("NEWS", F.col("cluster_seq").cast("string")))
    return rows.select("object_id", F.lit("sourceCount").alias("property"), F.lit(0).alias("ordinal"), F.col("n").cast("string").alias("value"), F.lit("set").alias("op"), "valid_from", F.lit(None).cast("timestamp").alias("valid_to"), F.col("seen_at").alias("recorded_at"), "seq")


def mentions(items: DataFrame, entities: DataFrame) -> DataFrame:
    """MENTIONS links of each article (seq) to the assets found in it, from its publication on."""
    rows = items.select("seq", "published_at", "seen_at").join(entities, "seq")
    return rows.select(F.lit("MENTIONS").alias("link_type"), text.external_id("NEWS", F.col("seq").cast("string")).alias("from_id"), F.col("entity_id").alias("to_id"), F.lit(None).cast("double").alias("weight"), F.col("published_at").alias("valid_from"), F.col("seen_at").alias("recorded_at"), "seq")


def ingest_report(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def ingest(items: DataFrame, threshold: float = THRESHOLD, hours: int = WINDOW_H) -> DataFrame:
    """(seq, outcome, cluster_seq) of items in arrival order: DUPLICATE by the feed's address or by content within the window, else
    NEW_CLUSTER or JOINED. An item that is a duplicate by its address doesn't count as seen content."""
    fresh = graph.cut(dedup_content(dedup_url(items), hours).select("seq", "tokens", "published_at"))
    joined = cluster(fresh, threshold, hours)
    of = joined.select("seq", "cluster_seq", F.when(F.col("seq") == F.col("cluster_seq"), "NEW_CLUSTER").otherwise("JOINED").alias("found"))
    return items.select("seq").join(of, "seq", "left").select("seq", F.coalesce("found", F.lit("DUPLICATE")).alias("outcome"), "cluster_seq")


def ingest_counts(items: DataFrame, feeds: DataFrame, threshold: float = THRESHOLD, hours: int = WINDOW_H) -> DataFrame:
    """(outcome, n) of an ingest, zeros included: FETCHED, NEW_CLUSTER, JOINED, DUPLICATE, and FAILED_FEED for feeds (feed_id, ok) that gave
    nothing; what they hold isn't counted as fetched."""
    working = feeds.where("ok").select("feed_id").distinct()
    done = ingest(items.join(working, "feed_id", "left_semi"), threshold, hours)
    sums = {"FETCHED": F.count(F.lit(1)), **{k: F.count_if(F.col("outcome") == k) for k in ("NEW_CLUSTER", "JOINED", "DUPLICATE")}}
    counts = done.agg(*(v.alias(k) for k, v in sums.items()))
    failed = feeds.where("NOT ok").select("feed_id").distinct().agg(F.count(F.lit(1)).alias("FAILED_FEED"))
    each = lambda df: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("outcome"), F.col(c).alias("n")) for c in df.columns))).alias("x")).select("x.*")
    return each(counts).unionByName(each(failed))
