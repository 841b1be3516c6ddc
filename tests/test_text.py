"""News, macro, ledger, decoders, progress and streams."""

import json
import time
from datetime import datetime, timedelta, timezone

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronark.functions import text
from chronark.operators import learning, ledger, macro, news, progress, similarity
from chronark.plans.queries import ORACLE_SQL, QUERIES
from chronark.sources import decode
from chronark.streaming import streams

START = datetime(2026, 1, 1, tzinfo=timezone.utc)
SAME = [
    "Harbour strike halts grain exports from northern ports", "Northern ports halt grain exports as harbour strike spreads", "Grain exports halted by harbour strike at northern ports",
    "Harbour strike: northern ports halt all grain exports", "Northern harbour strike halts exports of grain from ports",
]


def items(spark, titles, step=60):
    rows = [(i, t, START + timedelta(seconds=step * i)) for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "seq long, title string, published_at timestamp")
    return df.withColumn("normalized", text.normalize(F.col("title"))).withColumn("tokens", text.tokens(F.col("normalized")))


def clusters(spark, titles, step=60):
    return [r.cluster_seq for r in news.cluster(items(spark, titles, step)).orderBy("seq").collect()]


def test_paraphrases_make_one_cluster(spark):
    assert clusters(spark, SAME) == [0] * 5
    c = news.cluster_counters(items(spark, SAME), news.cluster(items(spark, SAME))).first()
    assert c.source_count == 5 and c.title == SAME[0]


def test_other_topics_and_old_clusters_stay_apart(spark):
    assert clusters(spark, [SAME[0], "Museum opens late wing with glass roof", SAME[1]]) == [0, 1, 0]
    assert clusters(spark, [SAME[0], SAME[0]], step=7 * 86_400) == [0, 1]


def plain_clusters(rows, threshold=0.45, hours=72):
    """(seq, leader) one item after another: among clusters that still get items, the most similar first member."""
    out, leaders = {}, []
    for seq, tokens, at in rows:
        best = None
        for k, (first, words, last) in enumerate(leaders):
            either = len(words | tokens)
            s = len(words & tokens) / either if words and tokens else 0
            if s >= threshold and last >= at - hours * 3600 and (best is None or (s, last, -first) > best[0]):
                best = ((s, last, -first), k)
        if best is None:
            leaders.append((seq, tokens, at))
            out[seq] = seq
        else:
            first, words, last = leaders[best[1]]
            leaders[best[1]] = (first, words, max(last, at))
            out[seq] = first
    return out


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_a_plain_fold(spark, seed):
    """Random headlines over months, some out of order, long chains of similar ones, equal ones, and some without words."""
    rng = random.Random(seed)
    words = [f"w{k:02d}x" for k in range(30)]
    rows, at = [], 0
    for seq in range(300):
        at += rng.choice([600, 40_000, 90_000, 400_000] if seed else [600])
        base = (seq // 3) % 25 if seed == 2 else rng.randrange(8)
        tokens = sorted({words[(base + k) % 30] for k in range(5)} ^ ({rng.choice(words)} if rng.random() < 0.4 else set()))
        rows.append((seq, [] if seq % 50 == 7 else tokens, at - (rng.choice([0, 0, 0, 300_000]))))
    df = spark.createDataFrame(rows, "seq long, tokens array<string>, at long").select("seq", "tokens", F.timestamp_seconds("at").alias("published_at"))
    got = {r.seq: r.cluster_seq for r in news.cluster(df.repartition(3)).collect()}
    assert got == plain_clusters([(s, frozenset(t), at) for s, t, at in rows])


@pytest.mark.parametrize("seed", range(1))
def test_clusters_with_late_items_equal_a_plain_fold(spark, seed, monkeypatch):
    """Groups that live on for many windows by one member after another, items that arrive weeks late, and small epochs and slices."""
    monkeypatch.setattr(news, "EPOCH", 7)
    monkeypatch.setattr(similarity, "SLICE", 3)
    rng = random.Random(seed + 10)
    rows, at = [], 0
    for seq in range(60):
        at += rng.choice([10_000, 30_000, 60_000])
        base = rng.randrange(3)
        tokens = sorted({f"s{base}{k}" for k in range(8)} - {f"s{base}{rng.randrange(8)}"} | ({f"x{rng.randrange(40)}"} if rng.random() < 0.5 else set()))
        rows.append((seq, tokens, at - rng.choice([0, 0, 0, 0, 200_000, 900_000])))
    df = spark.createDataFrame(rows, "seq long, tokens array<string>, at long").select("seq", "tokens", F.timestamp_seconds("at").alias("published_at"))
    got = {r.seq: r.cluster_seq for r in news.cluster(df.repartition(3), hours=250).collect()}
    assert got == plain_clusters([(s, frozenset(t), at) for s, t, at in rows], hours=250)
    assert len(set(got.values())) > 2


def test_groups_of_many_windows_take_no_more_steps(spark, monkeypatch):
    """A headline with another word each day: the driver plans as many steps for twenty windows as for two."""
    steps, cut = [], similarity.graph.cut
    monkeypatch.setattr(similarity.graph, "cut", lambda df: steps.append(df) or cut(df))
    taken = []
    for days in (6, 60):
        steps.clear()
        assert set(clusters(spark, [f"{SAME[0]} word{k}x" for k in range(days)], step=86_400)) == {0}
        taken.append(len(steps))
    assert taken[0] == taken[1]


@pytest.mark.parametrize("size", [2, 2000])
def test_recent_pairs_equal_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(similarity, "SLICE", size)
    rng = random.Random(size)
    rows = []
    for seq in range(200):
        tokens = sorted({f"t{rng.randrange(12)}" for _ in range(rng.randrange(7))})
        rows.append((seq, tokens, rng.randrange(0, 40 * 3600)))
    rows += [(300, ["t1", "t2"], None), (301, None, 5)]
    df = spark.createDataFrame(rows, "seq long, tokens array<string>, at long").select("seq", "tokens", F.timestamp_seconds("at").alias("published_at"))
    want = set()
    for a, x, ta in rows:
        for b, y, tb in rows:
            if a > b and x and y and ta is not None and tb is not None and abs(ta - tb) <= 10 * 3600 and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.45:
                want.add((a, b))
    got = similarity.recent_pairs(df.repartition(3), hours=10)
    assert sorted((r.a, r.b) for r in got.collect()) == sorted(want)
    assert similarity.recent_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize(("span", "unit"), [(2, 8192), (3, 20)])
def test_recent_pairs_deal_texts_once(spark, span, unit, monkeypatch):
    """Many windows, some of them dense, times before 1970 and late items: all pairs, and one shuffle that carries tokens, not one for each of these."""
    for name, value in (("SPAN", span), ("UNIT", unit), ("STEP", 7), ("PIECE", 50)):
        monkeypatch.setattr(similarity, name, value)
    rng = random.Random(span)
    at = [rng.choice([rng.randrange(-50 * 3600, 90 * 3600), 36000 * rng.randrange(-3, 6), rng.randrange(3600)]) for _ in range(150)]
    rows = [(seq, sorted({f"t{rng.randrange(9)}" for _ in range(rng.randrange(1, 7))}), at[seq]) for seq in range(150)]
    df = spark.createDataFrame(rows, "seq long, tokens array<string>, at long").select("seq", "tokens", F.timestamp_seconds("at").alias("published_at"))
    want = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for a, x, ta in rows for b, y, tb in rows if a > b and abs(ta - tb) <= 36000}
    found = similarity.recent_pairs(df, hours=10)
    got = [((r.a, r.b), r.similarity) for r in found.collect()]
    assert len(got) == len(dict(got)) and dict(got) == {k: v for k, v in want.items() if v >= 0.45}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "explode(tokens" not in plan


@pytest.mark.parametrize(("slice_size", "list_size"), [(3, 2), (2000, 512)])
def test_similar_pairs_equal_brute_force_with_copies(spark, slice_size, list_size, monkeypatch):
    monkeypatch.setattr(similarity, "SLICE", slice_size)
    monkeypatch.setattr(similarity, "LIST", list_size)
    rng = random.Random(list_size)
    kinds = [sorted({f"t{int(rng.random() ** 2 * 14)}" for _ in range(rng.randrange(1, 10))}) for _ in range(40)]
    rows = [(seq, rng.choice(kinds) if seq % 3 else kinds[0]) for seq in range(150)] + [(200, []), (201, None), (202, ["only"])]
    want = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for a, x in rows for b, y in rows if a < b and x and y}
    got = [((r.a, r.b), r.similarity) for r in similarity.similar_pairs(spark.createDataFrame(rows, "seq long, tokens array<string>").repartition(3)).collect()]
    assert len(got) == len(dict(got)) and dict(got) == {k: v for k, v in want.items() if v >= 0.45}


def test_copies_meet_as_one_set(spark):
    """The index of pairs meets a set once, however many items have it, and hands no pair of items to a shuffle."""
    rows = [(seq, ["a", "b", "c"] if seq < 400 else ["a", "b", "d"]) for seq in range(800)]
    found = similarity.similar_pairs(spark.createDataFrame(rows, "seq long, tokens array<string>"))
    assert found.count() == 800 * 799 // 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Deduplicate" not in plan and "tokens" not in plan and plan.index("explode(items") < plan.index("RepartitionByExpression")


def test_content_window_equals_a_plain_fold(spark):
    rng = random.Random(4)
    rows, at = [], 0
    for seq in range(400):
        at += rng.choice([600, 30_000, 400_000])
        rows.append((seq, rng.choice(["Á b", "a B!", "c", ""]), None if seq % 9 == 0 else rng.choice(["x", ""]), at - rng.choice([0, 0, 500_000])))
    df = spark.createDataFrame(rows, "seq long, title string, body string, at long").select("seq", "title", "body", F.timestamp_seconds("at").alias("published_at"))
    newest, want = {}, []
    for seq, title, body, at in rows:
        key = (title.lower().replace("á", "a").strip("!"), body or "")
        if key not in newest or newest[key] < at - 72 * 3600:
            want.append(seq)
            newest[key] = max(newest.get(key, at), at)
    out = news.dedup_content(df.repartition(3))
    assert sorted(r.seq for r in out.collect()) == want and out.columns == [*df.columns, "content"]


def test_source_counts_and_mentions(spark):
    n = items(spark, [SAME[0], SAME[1], "Other topic altogether"]).withColumn("seen_at", F.col("published_at"))
    grown = news.source_count_assertions(n, news.cluster(n)).collect()
    assert [(r.object_id, r.value) for r in grown] == [("NEWS:0", "2")]
    links = news.mentions(n, spark.createDataFrame([(0, "ASSET:BTC")], "seq long, entity_id string")).collect()
    assert [(r.link_type, r.from_id, r.to_id) for r in links] == [("MENTIONS", "NEWS:0", "ASSET:BTC")]


def test_ingest_counts_every_outcome(spark):
    rows = [(k, feed, url, title, None, START + timedelta(minutes=k)) for k, (feed, url, title) in enumerate([("a", "x.com/1", SAME[0]), ("a", "x.com/1?utm_source=q", "Other words"), ("b", "y.com/1", SAME[0]), ("b", "y.com/2", SAME[1]), ("b", "y.com/3", "Other words"), ("c", "z.com/1", "Never seen")])]
    df = spark.createDataFrame(rows, "seq long, feed_id string, url string, title string, body string, published_at timestamp")
    df = df.withColumn("tokens", text.tokens(text.normalize(F.col("title"))))
    feeds = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", False)], "feed_id string, ok boolean")
    got = {r.outcome: r.n for r in news.ingest_counts(df, feeds).collect()}
    assert got == {"FETCHED": 5, "NEW_CLUSTER": 2, "JOINED": 1, "DUPLICATE": 2, "FAILED_FEED": 2}


def test_urls(spark):
    urls = ["https://www.Example.com/a/?utm_source=t&b=2&a=1#x", "https://example.com/a?a=1&b=2&fbclid=9", "HTTPS://example.com:443/a/?a=1&b=2", " not a url "]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(text.canonical_url(F.col("u"))).collect()]
    assert got[:3] == ["https://example.com/a?a=1&b=2"] * 3 and got[3] == "not a url"


def test_normalize_and_simhash(spark):
    df = spark.createDataFrame([("Éclair, ÀÉ  café!",), ("plain Text",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.normalize(F.col("t"))).collect()] == ["eclair ae cafe", "plain text", None, ""]
    h = spark.createDataFrame([(["a"],), ([],), (None,), (["bitcoin", "etf", "decision"],), (["bitcoin", "etf", "decision", "sec"],)], "t array<string>").select(text.simhash64("t").alias("h")).collect()
    fnv = ((0xCBF29CE484222325 ^ 97) * 0x100000001B3) % 2**64
    assert h[0].h % 2**64 == fnv and h[1].h == h[2].h == 0
    assert bin((h[3].h ^ h[4].h) % 2**64).count("1") < 32


def test_extraction(spark):
    rows = {r.seq: r for r in news.analyze(items(spark, ["Hackers exploit bridge, funds stolen in attack", "Token may rally after record growth", "Nothing here"])).collect()}
    assert rows[0].event_type == "SECURITY_INCIDENT" and rows[0].materiality > 0.4
    assert rows[1].sentiment == 1.0 and rows[1].speculation and rows[2].event_type == "OTHER"
    d = spark.createDataFrame([("bitcoin", "BTC"), ("token may", "TM")], "keyword string, entity_id string")
    assert {(r.seq, r.entity_id) for r in news.link_entities(items(spark, ["Bitcoin up", "A token may fall", "bitcoiners"]), d).collect()} == {(0, "BTC"), (1, "TM")}


def test_content_window(spark):
    rows = [(i, "t", "b", START + timedelta(hours=h)) for i, h in enumerate((0, 10, 80, 100, 200))]
    out = news.dedup_content(spark.createDataFrame(rows, "seq long, title string, body string, published_at timestamp"))
    assert sorted(r.seq for r in out.collect()) == [0, 2, 4]


def test_vintages(spark):
    body = json.dumps({"observations": [{"date": "2026-07-01", "value": "314.2", "realtime_start": "2026-08-15", "realtime_end": "2026-09-14"}, {"date": "2026-07-01", "value": "314.5", "realtime_start": "2026-09-15", "realtime_end": "9999-12-31"}, {"date": "2026-08-01", "value": ".", "realtime_start": "2026-09-15", "realtime_end": "9999-12-31"}]})
    raw = decode.vintages(spark.createDataFrame([("CPI", body)], "series string, body string"))
    points = macro.vintage_ranges(raw)
    got = [(str(r.vintage_from), str(r.vintage_to), r.is_revision) for r in points.orderBy("vintage_from").collect()]
    assert got == [("2026-08-15", "2026-09-15", False), ("2026-09-15", "None", True)]
    for t, v in (("2026-09-01", 314.2), ("2026-09-20", 314.5)):
        assert [float(r.value) for r in macro.known_at(points, F.lit(t).cast("date")).collect()] == [v]
    first = macro.write_observations(points)
    plain = lambda r: str(float(r.value)) if r.property == "value" else r.value
    assert first.count() == 8 and {(r.property, plain(r), str(r.valid_to)[:10]) for r in first.collect()} == {
        ("label", "CPI 2026-07-01", "None"), ("period", "2026-07-01", "None"), ("value", "314.2", "2026-09-15"), ("value", "314.5", "None"), ("revision", "false", "2026-09-15"), ("revision", "true", "None"),
    }
    links = macro.observation_links(points).collect()
    assert [(r.link_type, r.from_id, r.to_id) for r in links] == [("OBSERVATION_OF", "FRED:CPI:2026-07-01", "FRED:CPI")]
    assert macro.write_observations(points, first.withColumn("retracted_at", F.lit(None).cast("timestamp"))).count() == 0


FIELDS = [ledger.Field("sentiment", "NUMBER", True, -1, 1), ledger.Field("materiality", "NUMBER", True, 0, 1), ledger.Field("eventType", "ENUM", values=("HACK", "MACRO")), ledger.Field("speculation", "BOOLEAN"), ledger.Field("entities", "TEXT_LIST"), ledger.Field("evidence", "OBJECT_LIST", fields=(ledger.Field("claim", "TEXT", True), ledger.Field("weight", "NUMBER", True, 0, 1)))]


def test_conform(spark):
    raws = ['{"sentiment": -5.0, "materiality": 999}', '```json\n{"sentiment": 0.5, "materiality": 0.2, "eventType": "hack", "speculation": "true", "entities": "BTC", "evidence": [{"claim": "a", "weight": 2}, {"claim": "b"}], "x": 1}\n```', '{"sentiment": 0.1}', "no json", '{"sentiment": "high", "materiality": 0.1, "eventType": "PARTY"}', None]
    got = [r for r in ledger.conform(spark.createDataFrame(list(enumerate(raws)), "i long, raw string"), FIELDS).orderBy("i").collect()]
    assert (got[0].sentiment, got[0].materiality, got[0].clamped, got[0].error) == (-1, 1, ["sentiment", "materiality"], None)
    assert (got[1].eventType, got[1].speculation, got[1].entities) == ("HACK", True, ["BTC"])
    assert [(e.claim, e.weight) for e in got[1].evidence] == [("a", 1.0)] and (got[1].clamped, got[1].dropped) == (["evidence.weight"], ["evidence"])
    assert got[2].error == "missing: materiality" and got[3].error == "not JSON" and got[5].error == "not JSON"
    assert got[4].error == "missing: sentiment" and got[4].clamped == got[4].dropped == []
    with pytest.raises(ValueError):
        ledger.conform(spark.createDataFrame([(1, "{}")], "i long, raw string"), [ledger.Field("e", "ENUM")])


def test_budget_and_cost(spark):
    rows = [(str(i), START + timedelta(days=10 * i), "p", 1_000_000, 0, 0) for i in range(5)]
    calls = spark.createDataFrame(rows, "call_id string, occurred_at timestamp, purpose string, input_tokens long, cached_input_tokens long, output_tokens long")
    calls = calls.withColumn("cost", text.call_cost(F.col("input_tokens"), F.col("cached_input_tokens"), F.col("output_tokens")))
    assert [float(r.cost) for r in calls.collect()] == [0.15] * 5
    assert [r.refused for r in ledger.budget_gate(calls, "0.3").orderBy("call_id").collect()] == [False, False, True, True, False]
    assert [r.refused for r in ledger.replay_budget(calls, 0.3).orderBy("call_id").collect()] == [False, False, True, True, False]
    assert [(float(r.spend), r.calls) for r in ledger.spend_by_purpose(calls, F.lit(START + timedelta(days=15))).collect()] == [(0.3, 2)]


def test_feeds_are_read_as_xml(spark):
    rss = """<?xml version="1.0"?><!-- <!DOCTYPE --><rss><channel><title>c</title>
      <item><title>late &#8217;A&#x41;</title><link> http://a </link><link>http://b</link><description><![CDATA[one <p>]]>two<![CDATA[ three]]></description><dc:date>2026-01-05T12:00:00+02:00</dc:date></item>
      <item><title>early</title><link>http://c</link><content:encoded><![CDATA[<item><title>not one</title></item>]]></content:encoded><pubDate>Mon, 5 Jan 2026 09:00:00 GMT</pubDate></item>
      <item><title>unzoned</title><link>http://d</link><pubDate>2026-01-05T09:00:00</pubDate></item><item><link>http://e</link><guid>x</guid></item></channel></rss>"""
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>x</title><link rel="self" href="s"/><link href="http://f"/><id>i</id><updated>2026-01-05T10:00:00.5Z</updated><summary>s</summary></entry>
      <entry><title>y</title><link rel="self" href="s"/><id>urn:1</id><published>2026-01-04T10:00:00Z</published></entry></feed>"""
    bodies = {"rss": rss, "atom": atom, "rdf": "<rdf:RDF><item><title>q</title><link>l</link></item></rdf:RDF>", "none": "<rss><channel/></rss>", "cut": "<rss><channel><item>", "text": "hello", "empty": "", "null": None, "type": "<!DOCTYPE rss><rss/>"}
    raw = spark.createDataFrame([(k, START, v) for k, v in bodies.items()], "feed_id string, fetched_at timestamp, body string")
    got = {}
    for r in decode.feeds(raw).withColumn("at", F.date_format("published_at", "dd HH:mm")).collect():
        got.setdefault(r.feed_id, []).append((r.url, r.title, r.summary, r.body, r["at"], r.reason))
    start = "01 00:00"
    bad = lambda reason: [(None, None, None, None, start, reason)]
    assert got == {
        "rss": [("http://d", "unzoned", None, None, start, None), ("http://c", "early", None, "<item><title>not one</title></item>", "05 09:00", None),
                ("http://a", "late \u2019AA", "one <p>two three", "one <p>two three", "05 10:00", None), ("http://e", None, None, None, start, "NO_URL_OR_TITLE")],
        "atom": [("urn:1", "y", None, None, "04 10:00", None), ("http://f", "x", "s", "s", "05 10:00", None)], "rdf": [("l", "q", None, None, start, None)],
        "cut": bad("BAD_XML"), "text": bad("BAD_XML"), "empty": bad("BAD_XML"), "null": bad("BAD_XML"), "type": bad("DOCTYPE"),
    }


def test_entities_of_a_long_text(spark):
    d = spark.createDataFrame([("of the", "A"), ("w7 of the", "B"), ("end", "C"), ("the w", "D")], "keyword string, entity_id string")
    long = spark.createDataFrame([(1, " ".join(f"w{k % 10} of the" for k in range(40_000)) + " end")], "seq long, normalized string")
    start = time.perf_counter()
    assert {r.entity_id for r in news.link_entities(long, d).collect()} == {"A", "B", "C"}
    assert time.perf_counter() - start < 60  # splitting the text anew for every word takes far longer


def test_many_trades(spark):
    body = json.dumps([[1767225600000, "1", "2", "0.5", "1.5", "10", 1767225659999, "15", 3_000_000_235, "5"]])
    bars = decode.klines(spark.createDataFrame([(1, "1m", body)], "instrument_id long, timeframe string, body string"), F.lit(START + timedelta(hours=1)))
    assert [r.trade_count for r in bars.collect()] == [3_000_000_235]


def test_klines_at_the_end_of_a_minute_and_between_two_cents(spark, tmp_path):
    """A bar opens in its event's minute, up to the last microsecond, and a price is rounded as the decimal it is written as; in the SQL too."""
    rows = [(0, datetime(2024, 1, 14, 23, 58, 59, 999900), 1, 1.005), (1, datetime(2024, 1, 14, 23, 59), 2, 2.675), (60, datetime(1969, 12, 31, 23, 59, 59, 999999), 3, -1.005)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, QUERIES["decode_klines"](spark, str(tmp_path)).select("body", "open_ms", "close", "trade_count", "is_final").collect()))
    assert got == [(0, 1705276680000, 1.01, 1, True), (0, 1705276740000, 2.68, 2, False), (1, -60000, -1.01, 3, True)]
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(duck.sql(ORACLE_SQL["decode_klines"]).fetchall()) == got


def test_decoders(spark):
    k = [[1767225600000, "1", "2", "0.5", "1.5", "10", 1767225659999, "15", 3, "5", "x"], ["bad"]]
    bars = decode.klines(spark.createDataFrame([(1, "1m", json.dumps(k))], "instrument_id long, timeframe string, body string"), F.lit(START + timedelta(hours=1))).collect()
    assert len(bars) == 1 and bars[0].is_final and float(bars[0].close) == 1.5
    info = {"symbols": [{"symbol": "AB", "baseAsset": "A", "quoteAsset": "B", "status": "BREAK", "filters": [{"filterType": "PRICE_FILTER", "tickSize": "0.01"}]}]}
    r = decode.exchange_info(spark.createDataFrame([("X", json.dumps(info))], "exchange string, body string")).first()
    assert (r.status, float(r.tick_size), float(r.step_size), float(r.min_notional)) == ("HALT", 0.01, 1e-8, 0.0)
    rss = "<rss><channel><item><title>A &amp; B</title><link>https://x/1</link><pubDate>Thu, 01 Jan 2026 10:00:00 +0000</pubDate></item><item><title>no link</title></item></channel></rss>"
    feeds = decode.feeds(spark.createDataFrame([("f", START, rss), ("g", START, "<!DOCTYPE x><rss></rss>")], "feed_id string, fetched_at timestamp, body string")).collect()
    assert [(f.feed_id, f.title, f.reason) for f in feeds] == [("f", "A & B", None), ("f", "no link", "NO_URL_OR_TITLE"), ("g", None, "DOCTYPE")]
    v = decode.values(spark.createDataFrame([("1.5", "DECIMAL"), ("yes", "BOOLEAN"), (None, "TEXT"), ("2026-01-01", "DATE")], "raw string, data_type string")).collect()
    assert [x.reason for x in v] == [None, "NOT_A_VALUE", "NULL", None]


def test_progress(spark):
    rows = [("k", 1, 1, True, 10, None), ("k", 2, 2, True, 5, None), ("k", 3, 3, False, None, "x" * 600), ("k", 4, 4, False, None, "last")]
    df = spark.createDataFrame(rows, "key string, at long, seq long, ok boolean, value long, message string")
    w, c = progress.advance_watermarks(df, ["key"]).first(), progress.advance_cursors(df, ["key"]).first()
    assert (w.progress, c.progress, w.consecutive_errors, w.last_error) == (10, 5, 2, "last")


def test_streams(spark, tmp_path):
    rows = [("a", START + timedelta(minutes=m), float(m), m) for m in range(0, 200, 7)]
    spark.createDataFrame(rows, "instrument_id string, ts timestamp, value double, seq long").write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("instrument_id string, ts timestamp, value double, seq long").parquet(f"{tmp_path}/in")
    out = streams.stream_bars(s, 3600)
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("open_time").collect()
    assert [r.volume for r in got] == [9, 9, 8]


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def test_stream_dedup_equals_the_batch_form(spark, tmp_path, rocksdb):
    """Parts that land one after another, some items out of order, windows that end and begin again."""
    rng = random.Random(6)
    rows, at = [], 0
    for seq in range(120):
        at += rng.choice([600, 20_000, 90_000])
        rows.append((seq, rng.choice("abcd"), None, START + timedelta(seconds=at - rng.choice([0, 0, 3000]))))
    df = spark.createDataFrame(rows, "seq long, title string, body string, published_at timestamp").withColumn("content", text.content_hash(F.col("title"), F.lit("")))
    for k in range(3):
        df.where(F.floor(F.col("seq") / 40) == k).write.mode("append").parquet(f"{tmp_path}/in")
        kept = streams.stream_dedup(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 48)
        kept.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    want = sorted(r.seq for r in news.dedup_content(df.drop("content"), 48).collect())
    assert sorted(r.seq for r in spark.read.schema(df.schema).parquet(f"{tmp_path}/out").collect()) == want


def test_stream_dedup_calls_the_state_by_bucket(spark, tmp_path, rocksdb):
    """Contents share buckets: the state has a row for each of these at most, forgets what is over and keeps what a late item may meet."""
    hour = lambda h: START + timedelta(hours=h)
    parts = [[(k, f"c{k}", hour(k)) for k in range(60)], [(k, f"c{k % 60}", hour(k)) for k in range(60, 120)], [(120, "c59", hour(121)), (121, "c58", hour(110)), (122, "c1", hour(122))]]
    kind = "seq long, content string, published_at timestamp"
    states = []
    for rows in parts:
        spark.createDataFrame(rows, kind).write.mode("append").parquet(f"{tmp_path}/in")
        kept = streams.stream_dedup(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), 60, "20 hours", buckets=4)
        run = kept.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        states += [p.stateOperators[0].numRowsTotal for p in run.recentProgress if p.stateOperators]
    got = sorted(r.seq for r in spark.read.schema(kind).parquet(f"{tmp_path}/out").collect())
    # c0 to c59 come again after 60 hours exactly, which is within the window; c1 after 121 and c59 after 62 are not
    assert got == [*range(60), 120, 122]
    assert max(states) <= 8


def test_sync_goes_on_and_reads_touched_months_only(spark, tmp_path):
    kind = "instrument_id string, timeframe string, open_time timestamp, close_time timestamp, open double, high double, low double, close double, volume double, quote_volume double, trade_count int, taker_buy_base double, is_final boolean, seq long"
    bar = lambda month, hour, quarter, close: ("a", "15m", datetime(2026, month, 1, hour, 15 * quarter), datetime(2026, month, 1, hour, 15 * quarter + 14), 1.0, 9.0, 0.5, close, 1.0, 1.0, 1, 0.5, True, 1)
    put = lambda rows: spark.createDataFrame(rows, kind).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: streams.sync(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), f"{tmp_path}/state", streams.stream_rollup(f"{tmp_path}/store", "15m", ["1h"]))
    hours = lambda: sorted((r.open_time.month, r.open_time.hour, r.close) for r in spark.read.parquet(f"{tmp_path}/store").where("timeframe = '1h'").collect())
    put([bar(m, h, q, float(q)) for m in (1, 2) for h in (3, 4) for q in range(4) if (m, h, q) != (2, 4, 2)])
    assert run() == 15 and run() == 0
    assert hours() == [(1, 3, 3.0), (1, 4, 3.0), (2, 3, 3.0)]
    put([bar(2, 4, 2, 7.0), bar(2, 3, 3, 8.0)])
    assert run() == 2
    assert hours() == [(1, 3, 3.0), (1, 4, 3.0), (2, 3, 8.0), (2, 4, 3.0)]
    stored = streams._stored(f"{tmp_path}/store", spark.createDataFrame([], kind), [("15m", "2026-02")])
    plan = stored._jdf.queryExecution().executedPlan().toString()
    folders = plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert "month" in folders and "timeframe" in folders and "PushedFilters: []" in plan
    assert stored.count() == 8
    again = streams.stream_rollup(f"{tmp_path}/store", "15m", ["1h"])
    again(spark.createDataFrame([bar(2, 4, 2, 7.0)], kind), 9)
    assert len(hours()) == 4 and spark.read.parquet(f"{tmp_path}/store").count() == 20


def test_similar_objects_in_chunks_equal_all_pairs(spark):
    import numpy as np

    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(300)]
    rows[5], rows[6], rows[7] = (5, [0.0] * 4), (6, rows[8][1]), (7, [1.0, float("nan"), 0.0, 0.0])
    given = spark.createDataFrame([*rows, (None, [1.0] * 4), (900, None)], "vec_id long, embedding array<float>").repartition(5)
    asked = given.where("vec_id % 7 = 0 OR vec_id IN (5, 6)")
    x = {i: np.array(v) / max(np.linalg.norm(v), 1e-12) for i, v in rows if i != 7}
    want = {q: [round(float(s), 9) for s in sorted((x[q] @ x[i] for i in x if i != q), reverse=True)[:5]] for q in x if q % 7 == 0 or q in (5, 6)}
    for chunk in (20, 1000):
        got = {}
        for r in learning.similar_objects(given, asked.union(asked), 5, chunk).orderBy("query_id", "rank").collect():
            assert r.vec_id != r.query_id and abs(float(x[r.query_id] @ x[r.vec_id]) - r.similarity) < 1e-9
            got.setdefault(r.query_id, []).append(round(r.similarity, 9))
        assert got == want
    assert learning.similar_objects(given.where("false"), asked, 5).count() == learning.similar_objects(given, asked.where("false"), 5).count() == 0


def test_the_gate_walks_some_rows_at_a_time(monkeypatch):
    class State:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

    def run(rows, most):
        monkeypatch.setattr(streams, "GATE_ROWS", most)
        gate = streams._Gate()
        gate.state = State()
        return list(gate.handleInputRows(("X",), iter(rows), None)), gate.state.value

    names = [c for c in streams._GATE_COLUMNS if c not in ("as_of", "has_open_position")]
    rng = random.Random(5)
    rows = pd.DataFrame([{"instrument_id": "X", "as_of": pd.Timestamp(2026, 1, 1) + pd.Timedelta(hours=k), "has_open_position": k % 3 > 0} | {c: rng.choice([0.0, 25.0, 75.0, 100.0, None]) for c in names} for k in range(100)])
    mixed = rows.sample(frac=1, random_state=2)
    whole, parts = run([rows], 1000), run([mixed[:30], mixed[30:]], 7)
    assert [len(p) for p in parts[0]] == [7] * 14 + [2]
    assert pd.concat(parts[0], ignore_index=True).equals(whole[0][0]) and str(parts[1]) == str(whole[1])


def test_conforming_reads_each_field_once(spark):
    fields = [ledger.Field("k", "INTEGER", True, 0, 50), ledger.Field("items", "OBJECT_LIST", True, fields=(ledger.Field("n", "NUMBER", True, 0, 100), ledger.Field("name", "TEXT")))]
    raw = '{"k": "7", "items": [{"n": 120, "name": "a"}, {"name": "b"}, 5]}'
    done = ledger.conform(spark.createDataFrame([(1, raw)], "id long, raw string"), fields)
    r = done.first()
    assert (r.k, [tuple(x) for x in r["items"]], r.clamped, r.dropped, r.error) == (7.0, [(100.0, "a")], ["items.n"], ["items", "items"], None)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("variantget") + plan.count("variant_get") <= 12
