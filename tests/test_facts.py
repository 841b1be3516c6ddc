"""Golden histories of facts and links, and bulk apply against one-by-one application."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronark.operators import bitemporal as bt
from chronark.operators import query as qb
from chronark.operators import temporal

A = "object_id long, property string, ordinal int, value string, op string, valid_from timestamp, valid_to timestamp, recorded_at timestamp, seq long"
S = "object_id long, property string, ordinal int, value string, valid_from timestamp, valid_to timestamp, recorded_at timestamp, retracted_at timestamp"


def d(text):
    return datetime.fromisoformat(text) if text else None


def applied(spark, rows, state=()):
    a = spark.createDataFrame([(1, "p", 0, v, op, d(f), d(t), d(r), i) for i, (op, v, f, t, r) in enumerate(rows)], A)
    return bt.apply_assertions(spark.createDataFrame(list(state), S), a)


def at(state, t):
    return [r.value for r in state.where(temporal.known_at(F.lit(t).cast("timestamp"))).collect()]


def test_three_updates_and_a_retraction(spark):
    out = applied(spark, [("set", "19500000", "2026-01-01", None, "2026-01-01"), ("set", "19650000", "2026-03-01", None, "2026-03-01"), ("set", "19800000", "2026-05-01", None, "2026-05-01"), ("retract", None, None, None, "2026-06-01"), ("set", "19780000", "2026-05-01", None, "2026-06-01")])
    s = out.state.cache()
    assert [at(s, t) for t in ("2026-02-01", "2026-04-01", "2026-05-15", "2026-06-15")] == [["19500000"], ["19650000"], ["19800000"], ["19780000"]]
    assert s.count() == 4 and s.where("retracted_at IS NOT NULL").count() == 1
    assert [r.value for r in bt.current_values(s).collect()] == ["19780000"]
    assert out.rejects.count() == 0 and out.log.count() == 5


def test_late_knowledge_close_overlap_correction_and_no_change(spark):
    s = applied(spark, [("set", "a", "2026-02-01", None, "2026-05-01")]).state
    assert at(s, "2026-03-01") == [] and at(s, "2026-06-01") == ["a"]
    s = applied(spark, [("set", "a", "2026-01-01", None, "2026-01-01"), ("close", None, None, "2026-04-01", "2026-04-01")]).state
    assert at(s, "2026-03-01") == ["a"] and at(s, "2026-05-01") == [] and s.count() == 1
    out = applied(spark, [("set", "a", "2026-03-01", None, "2026-03-01"), ("set", "b", "2026-02-01", None, "2026-04-01")])
    assert [r.reason for r in out.rejects.collect()] == ["TEMPORAL_CONFLICT"] and out.state.count() == 1
    s = applied(spark, [("set", "a", "2026-03-01", None, "2026-03-01"), ("set", "b", "2026-03-01", None, "2026-03-02")]).state
    assert s.count() == 2 and [r.value for r in bt.current_values(s).collect()] == ["b"]
    assert applied(spark, [("set", "a", "2026-03-01", None, "2026-03-01"), ("set", "a", "2026-04-01", None, "2026-04-01")]).state.count() == 1


def one_by_one(rows, assertions):
    """One key's rows after its assertions in order, each looking at all rows; and how many were rejected."""
    rejected = 0
    end = lambda r: r["valid_to"] or datetime(9999, 1, 1)
    for a in assertions:
        live = [r for r in rows if r["retracted_at"] is None]
        opened = [r for r in live if r["valid_to"] is None]
        start, until = a["valid_from"], a["valid_to"]
        if a["op"] == "retract":
            for r in opened:
                r["retracted_at"] = a["recorded_at"]
        elif a["op"] == "close":
            for r in opened:
                if r["valid_from"] < until:
                    r["valid_to"] = until
        elif not (len(opened) == 1 and opened[0]["value"] == a["value"] and until is None):
            before = [dict(r) for r in rows]
            for r in live if until is None else []:
                if r["valid_from"] < start < end(r):
                    r["valid_to"] = start
                elif r["valid_to"] is None and r["valid_from"] == start:
                    r["retracted_at"] = a["recorded_at"]
            if any(r["retracted_at"] is None and r["valid_from"] < (until or datetime(9999, 1, 1)) and start < end(r) for r in rows):
                rows, rejected = before, rejected + 1
            else:
                rows = [*rows, {"value": a["value"], "valid_from": start, "valid_to": until, "recorded_at": a["recorded_at"], "retracted_at": None}]
    return rows, rejected


def test_unordered_writes_onto_a_state_equal_one_by_one(spark):
    rng = random.Random(7)
    day = lambda k: datetime(2026, 1, 1) + timedelta(days=k)
    names = ("value", "valid_from", "valid_to", "recorded_at", "retracted_at")
    old, new, want, rejects = [], [], {}, 0
    for key in range(60):
        # histories with gaps, retracted rows and, in every fifth, rows that overlap
        state, at = [], 0
        for _ in range(rng.randint(0, 5)):
            first = at + rng.randint(0, 2)
            at = first + rng.randint(1, 4)
            state.append(dict(zip(names, (rng.choice("ab"), day(first), day(at), day(0), day(1) if rng.random() < 0.2 else None))))
        if state and rng.random() < 0.5:
            state.append(dict(zip(names, ("c", day(at), None, day(0), None))))
        if key % 5 == 4:
            state.append(dict(zip(names, ("d", day(1), day(6), day(0), None))))
        own = []
        for i in range(rng.randint(1, 25)):
            op = rng.choice(["set"] * 7 + ["retract", "close"])
            start = day(rng.randint(0, 20))
            until = start + timedelta(days=rng.randint(1, 4)) if op == "close" or rng.random() < 0.4 else None
            own.append(dict(zip(("value", "op", "valid_from", "valid_to", "recorded_at", "seq"), (rng.choice("abc"), op, start, until, day(30 + i // 2), i))))
        # a bounded write before the first of all makes the key one for the fold
        own[0] |= {"op": "set", "valid_to": own[0]["valid_from"] + timedelta(days=1)}
        old += [(key, "p", 0, *(r[n] for n in names)) for r in state]
        new += [(key, "p", 0, *(a[n] for n in ("value", "op", "valid_from", "valid_to", "recorded_at", "seq"))) for a in own]
        rows, n = one_by_one([dict(r) for r in state], own)
        want[key], rejects = sorted((tuple(r[n] for n in names) for r in rows), key=str), rejects + n
    done = bt.apply_assertions(spark.createDataFrame(old, S), spark.createDataFrame(new, A))
    got = {}
    for r in done.state.collect():
        got.setdefault(r.object_id, []).append(tuple(r[n] for n in names))
    assert {k: sorted(v, key=str) for k, v in got.items()} == want
    assert done.rejects.count() == rejects > 0


def test_a_hot_key_of_late_writes_is_not_quadratic():
    machine, first, out = bt._Values(), datetime(2026, 1, 1), []
    for i in range(100_000):
        start = first + timedelta(hours=i * 7919 % 100_000)
        out += machine.put({"object_id": 1, "property": "p", "ordinal": 0, "value": "a", "op": "set", "valid_from": start, "valid_to": start + timedelta(hours=1), "recorded_at": first, "seq": i})
    assert len(out) == 100_000 and not any(r[-2] == "reject" for r in out) and len(machine.end()) == 100_000


def test_bulk_apply_equals_one_by_one(spark):
    rng = random.Random(1)
    base = datetime(2026, 1, 1)
    rows, want = [], set()
    for key in range(40):
        history, own = [], []
        for i in range(rng.randint(1, 7)):
            op = rng.choice(["set"] * 6 + ["retract", "close"]) if key % 2 else "set"
            day = lambda k: base + timedelta(days=k)
            start = day(rng.randint(0, 20)) if key % 2 else day(i * rng.randint(0, 1) + i)
            until = start + timedelta(days=rng.randint(1, 9)) if op == "close" or key % 4 == 1 and rng.random() < 0.3 else None
            own.append((key, "p", 0, rng.choice("ab"), op, start, until, day(i), i))
        rows += own
        names = ("value", "op", "valid_from", "valid_to", "recorded_at", "seq")
        history, _ = one_by_one([], [dict(zip(names, (r[3], r[4], r[5], r[6], r[7], r[8]))) for r in own])
        want |= {(key, h["value"], h["valid_from"], h["valid_to"], h["recorded_at"], h["retracted_at"], k) for k, h in enumerate(sorted(history, key=str))}
    out = bt.apply_assertions(spark.createDataFrame([], S), spark.createDataFrame(rows, A)).state.collect()
    by_key = {}
    for r in out:
        by_key.setdefault(r.object_id, []).append({"value": r.value, "valid_from": r.valid_from, "valid_to": r.valid_to, "recorded_at": r.recorded_at, "retracted_at": r.retracted_at})
    assert {k: len(v) for k, v in by_key.items()} == {k: sum(x[0] == k for x in want) for k in by_key}
    got = {(k, h["value"], h["valid_from"], h["valid_to"], h["recorded_at"], h["retracted_at"]) for k, v in by_key.items() for h in v}
    assert got == {x[:6] for x in want}


def test_lists(spark):
    old = spark.createDataFrame([(1, "t", i, v, d("2026-01-01"), None, d("2026-01-01"), None) for i, v in enumerate("ab")], S)
    kind = "object_id long, property string, elements array<string>, valid_from timestamp, recorded_at timestamp"
    same = bt.set_lists(old, spark.createDataFrame([(1, "t", ["a", "b"], d("2026-02-01"), d("2026-02-01"))], kind))
    assert same.count() == 2
    new = bt.set_lists(old, spark.createDataFrame([(1, "t", ["b"], d("2026-02-01"), d("2026-02-01"))], kind))
    assert new.count() == 3 and [r.value for r in bt.current_values(new).collect()] == ["b"]


def test_links(spark):
    kind = "link_type string, from_id string, to_id string, weight double, valid_from timestamp, recorded_at timestamp, seq long"
    one = bt.link_objects(spark.createDataFrame([("L", "BTC", "X", 1.0, d("2026-02-01"), d("2026-02-01"), 1), ("L", "BTC", "Y", 1.0, d("2026-05-01"), d("2026-05-01"), 2)], kind), "MANY_TO_ONE")
    assert [r.to_id for r in one.where(temporal.is_current()).collect()] == ["Y"]
    assert [r.to_id for r in one.where(temporal.known_at(F.lit("2026-03-01").cast("timestamp"))).collect()] == ["X"]
    both = bt.link_objects(spark.createDataFrame([("C", "a", "b", 0.65, d("2026-02-01"), d("2026-02-01"), 1)], kind), "MANY_TO_MANY", symmetric=True)
    assert both.count() == 2
    gone = bt.unlink_objects(both, spark.createDataFrame([("C", "a", "b", d("2026-06-01"))], "link_type string, from_id string, to_id string, until timestamp"), symmetric=True)
    assert gone.where(temporal.is_current()).count() == 0


def test_overlaps(spark):
    rows = spark.createDataFrame([(1, "p", 0, "a", d("2026-01-01"), d("2026-02-01"), d("2026-01-01"), None), (1, "p", 0, "b", d("2026-02-01"), None, d("2026-02-01"), None), (2, "p", 0, "a", d("2026-01-01"), None, d("2026-01-01"), None), (2, "p", 0, "b", d("2026-02-01"), None, d("2026-02-01"), None)], S)
    assert [r.object_id for r in temporal.detect_overlaps(rows, bt.KEY).collect()] == [2]


def test_overlaps_of_one_instant_by_commit(spark):
    at = d("2026-01-01")
    rows = [(1, "p", 0, "long", at, d("2026-02-01"), at, None, 8), (1, "p", 0, "short", at, at, at, None, 7), (2, "p", 0, "long", at, d("2026-02-01"), at, None, 7), (2, "p", 0, "short", at, at, at, None, 8)]
    for some in (rows, rows[::-1]):
        found = temporal.detect_overlaps(spark.createDataFrame(some, f"{S}, commit_id long").coalesce(1), bt.KEY)
        assert [(r.object_id, r.value) for r in found.collect()] == [(2, "short")]


def test_many_instants_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    day = lambda k: datetime(2026, 1, 1) + timedelta(days=k)
    rows = [(k % 7, k, day(a := rng.randrange(400)), rng.choice([None, day(a + rng.randrange(300))]), day(a + rng.randrange(20)), rng.choice([None, None, day(a + 90)])) for k in range(150)]
    asked = sorted({(k % 8, day(rng.randrange(700))) for k in range(60)} | {(6, day(200))})
    values = spark.createDataFrame(rows, "k int, value int, valid_from timestamp, valid_to timestamp, recorded_at timestamp, retracted_at timestamp")
    got = temporal.as_of_many(values.repartition(3), spark.createDataFrame(asked, "k int, at timestamp"), ["k"])
    want = [(k, v, at) for k, v, f, to, rec, gone in rows for key, at in asked if key == k and f <= at and (to is None or at < to) and rec <= at and (gone is None or gone > at)]
    assert sorted((r.k, r.value, r.at) for r in got.collect()) == sorted(want) and want


def test_an_instant_costs_the_same_after_any_time(spark):
    import time

    at = lambda *t: F.array(*(F.lit(x).cast("timestamp") for x in t))
    key = spark.range(3000)
    none = F.lit(None).cast("timestamp")
    begin = F.lit("0001-01-01 00:00:00").cast("timestamp")
    values = key.select("id", begin.alias("valid_from"), none.alias("valid_to"), begin.alias("recorded_at"), none.alias("retracted_at"))
    start = time.perf_counter()
    met = temporal.as_of_many(values, key.select("id", F.explode(at("0001-01-02", "9999-01-01")).alias("at")), ["id"])
    assert met.agg(F.count("valid_from")).first()[0] == 6000
    assert time.perf_counter() - start < 30  # a row for each of 120 000 months takes far longer


CATALOG = qb.Catalog({"Asset": None, "CryptoAsset": "Asset"}, {"Asset": [qb.Property("name", is_title=True)], "CryptoAsset": [qb.Property("marketCap", "DECIMAL"), qb.Property("category", "ENUM"), qb.Property("tags", is_list=True)]}, {"Asset"})
COINS = [("BTC", "Bitcoin", "1300000000000", "L1", ["PoW", "STORE_OF_VALUE"]), ("ETH", "Ethereum", "400000000000", "L1", ["PoS", "SMART_CONTRACT"]), ("ARB", "Arbitrum", "3000000000", "L2", ["PoS", "ROLLUP"]), ("USDT", "Tether", "120000000000", "STABLECOIN", ["STABLE"])]


@pytest.fixture(scope="module")
def coins(spark):
    start = d("2026-01-01")
    objects = spark.createDataFrame([(i, "CryptoAsset", i, start, start, None) for i, *_ in COINS], "object_id string, type string, external_id string, exists_from timestamp, recorded_at timestamp, deleted_at timestamp")
    rows = []
    for i, name, cap, category, tags in COINS:
        turn = d("2026-06-01") if i == "ARB" else None
        rows += [(i, "name", 0, name, start, None), (i, "marketCap", 0, cap, start, turn), (i, "category", 0, category, start, None)] + [(i, "tags", k, t, start, None) for k, t in enumerate(tags)]
        if turn:
            rows.append((i, "marketCap", 0, "30000000000", turn, None))
    values = spark.createDataFrame([(*r, r[4], None, "c") for r in rows], "object_id string, property string, ordinal int, value string, valid_from timestamp, valid_to timestamp, recorded_at timestamp, retracted_at timestamp, commit_id string")
    links = spark.createDataFrame([], "link_type string, from_id string, to_id string, valid_from timestamp, valid_to timestamp, recorded_at timestamp, retracted_at timestamp, commit_id string")
    return objects, values, qb.project(objects, values, links, CATALOG, "CryptoAsset").cache()


def ids(result):
    return [r.object_id for r in result.rows.collect()]


def test_query_builder(coins):
    objects, values, projection = coins

    def run(*where, **more):
        return qb.run(qb.Query(more.pop("type", "CryptoAsset"), [qb.Where(*w) for w in where], **more), CATALOG, projection, objects, values)

    big = run(("marketCap", "GT", 100_000_000_000), order_by=[("marketCap", False)])
    assert ids(big) == ["BTC", "ETH", "USDT"] and big.total() == 3
    assert ids(run(order_by=[("marketCap", False)], limit=2, offset=2)) == ["USDT", "ARB"]
    assert ids(run(("name", "CONTAINS", "ere"))) == ["ETH"] and ids(run(search="bitcoin")) == ["BTC"]
    assert sorted(ids(run(("tags", "CONTAINS", "PoS")))) == ["ARB", "ETH"]
    assert len(ids(run(type="Asset"))) == 4
    for t, want in (("2026-03-01", ["BTC", "ETH", "USDT"]), ("2026-08-01", ["ARB", "BTC", "ETH", "USDT"])):
        assert ids(run(("marketCap", "GT", 10_000_000_000), as_of=F.lit(t).cast("timestamp"))) == want


@pytest.mark.parametrize(("where", "error"), [(("nope", "EQ", 1), qb.NotFound), (("category", "GT", "x"), qb.SchemaViolation), (("tags", "GT", "x"), qb.SchemaViolation), (("name", "EQ", None), qb.SchemaViolation)])
def test_bad_queries_are_refused_before_planning(coins, where, error):
    with pytest.raises(error):
        qb.query_current(coins[2], qb.Query("CryptoAsset", [qb.Where(*where)]), CATALOG)
    with pytest.raises(qb.NotFound):
        qb.query_current(coins[2], qb.Query("Ghost"), CATALOG)


def test_limits_are_clamped():
    q = qb.Query("X", limit=10_000, offset=-4)
    assert (q.limit, q.offset) == (500, 0)


def test_catalog_grows_by_versions(spark):
    from chronark.operators import news

    c = news.ensure_schema(qb.Catalog({}, {}))
    before = len(c.log)
    assert news.ensure_schema(c) is c and len(c.log) == before
    c.define_type("Coin", "Asset")
    c.define_property("Coin", qb.Property("supply", "DECIMAL"))
    c.deprecate("Coin", "supply")
    spec = {r.type: r for r in c.specs(spark).collect()}
    assert spec["Coin"].version == 3 and [(p.name, p.deprecated_in) for p in spec["Coin"].properties] == [("name", None), ("supply", 3), ("symbol", None)]
    for bad in (lambda: c.define_type("coin"), lambda: c.define_type("Coin"), lambda: c.define_property("Coin", qb.Property("Bad")), lambda: c.define_property("Coin", qb.Property("must", required=True), populated=True), lambda: c.define_link(qb.Link("bad", "Coin", "Asset"))):
        with pytest.raises(qb.SchemaViolation):
            bad()
    with pytest.raises(qb.NotFound):
        c.deprecate("Coin", "nope")


def plain_links(rows, source_one, target_one):
    """Links one after another, as the store makes them."""
    made = []
    for f, t, at in rows:
        if any(x[:2] == [f, t] and x[3] is None for x in made):
            continue
        for x in made:
            if x[3] is None and x[2] < at and (source_one and x[0] == f and x[1] != t or target_one and x[1] == t and x[0] != f):
                x[3] = at
        made.append([f, t, at, None])
    return sorted(map(tuple, made), key=str)


@pytest.mark.parametrize("cardinality", ["ONE_TO_ONE", "ONE_TO_MANY", "MANY_TO_ONE", "MANY_TO_MANY"])
@pytest.mark.parametrize("split", [0, 60])
def test_links_of_each_cardinality_equal_a_plain_fold(spark, cardinality, split):
    import random

    rng = random.Random(len(cardinality) + split)
    rows = [(f"a{rng.randrange(6)}", f"x{rng.randrange(5)}", d(f"2026-{1 + k // 25:02d}-{1 + k % 25:02d}")) for k in range(120)]
    make = lambda part, start: spark.createDataFrame([("L", f, t, 1.0, at, at, start + k) for k, (f, t, at) in enumerate(part)], "link_type string, from_id string, to_id string, weight double, valid_from timestamp, recorded_at timestamp, seq long")
    state = bt.link_objects(make(rows[:split], 0), cardinality) if split else None
    got = bt.link_objects(make(rows[split:], split), cardinality, state=state)
    want = plain_links(rows, cardinality in ("ONE_TO_ONE", "MANY_TO_ONE"), cardinality in ("ONE_TO_ONE", "ONE_TO_MANY"))
    assert sorted(((r.from_id, r.to_id, r.valid_from, r.valid_to) for r in got.collect()), key=str) == want


def test_unlinking_before_the_start_does_nothing(spark):
    kind = "link_type string, from_id string, to_id string, weight double, valid_from timestamp, recorded_at timestamp, seq long"
    links = bt.link_objects(spark.createDataFrame([("L", "a", "x", 1.0, d("2026-02-01"), d("2026-02-01"), 1)], kind), "MANY_TO_MANY")
    ends = lambda *until: spark.createDataFrame([("L", "a", "x", d(u)) for u in until], "link_type string, from_id string, to_id string, until timestamp")
    assert bt.unlink_objects(links, ends("2026-02-01")).first().valid_to is None
    assert bt.unlink_objects(links, ends("2026-01-01", "2026-04-01", "2026-03-01")).first().valid_to == d("2026-03-01")


def test_conditions_are_checked_alike_in_bulk_and_alone(spark):
    c = qb.Catalog({}, {})
    c.define_type("Thing")
    c.define_type("Tool", "Thing")
    for p in (qb.Property("name"), qb.Property("price", "DECIMAL"), qb.Property("marks", is_list=True), qb.Property("sold", "BOOLEAN")):
        c.define_property("Thing", p)
    values = [None, [], [None], ["1"]]
    asked = [(t, f, o, v) for t in ("Tool", "None") for f in ("name", "price", "marks", "sold", "other") for o in (*qb.OPERATORS, "LIKE") for v in values]

    def alone(t, f, o, v):
        value = v if o == "IN" else v[0] if v else None
        try:
            qb.check(qb.Query(t, [qb.Where(f, o, value)]), c)
        except ValueError as e:
            return str(e)

    requests = spark.createDataFrame([*asked, (None, "name", "EQ", ["1"]), ("Tool", None, "EQ", ["1"])], "type string, field string, op string, values array<string>")
    got = {(r.type, r.field, r.op, str(r["values"])): r.reason for r in qb.violations(requests, c).collect()}
    assert got[(None, "name", "EQ", "['1']")] == "type null" and got[("Tool", None, "EQ", "['1']")] == "field Tool.null"
    assert {(t, f, o, str(v)): alone(t, f, o, v) for t, f, o, v in asked}.items() <= got.items()


def test_literals_of_the_wrong_type_are_refused_before_any_plan(spark):
    for value, kind in (("ten", "DECIMAL"), ("1,5", "INTEGER"), ("soon", "DATE"), ("x", "REFERENCE")):
        with pytest.raises(qb.SchemaViolation):
            qb.literal(value, kind)
    one = spark.range(1).select(qb.literal("1.50", "DECIMAL").alias("a"), qb.literal("True", "BOOLEAN").alias("b"), qb.literal("yes", "BOOLEAN").alias("c"), qb.literal("2026-01-05", "DATE").alias("d"), qb.literal(7, "INTEGER").alias("e")).first()
    assert (float(one.a), one.b, one.c, one.d, int(one.e)) == (1.5, True, False, d("2026-01-05"), 7)
