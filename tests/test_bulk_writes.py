"""Bulk list, closing and link writes against folds that apply one write after another."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronark.operators import bitemporal as bt

START = datetime(2026, 1, 1)
S = "object_id long, property string, ordinal int, value string, valid_from timestamp, valid_to timestamp, recorded_at timestamp, retracted_at timestamp"
LISTS = "object_id long, property string, elements array<string>, valid_from timestamp, recorded_at timestamp, seq long"
LINKS = "link_type string, from_id string, to_id string, weight double, valid_from timestamp, recorded_at timestamp, seq long"


def day(k):
    return START + timedelta(days=k)


def plain_lists(rows, writes):
    """(rows, rejected seqs) of one key."""
    rows, rejected = [dict(r) for r in rows], []
    for elements, start, at, seq in writes:
        opened = sorted((r for r in rows if r["retracted"] is None and r["to"] is None), key=lambda r: r["ordinal"])
        if [r["value"] for r in opened] == elements:
            continue
        after = [dict(r) for r in rows]
        for ordinal in range(max(len(opened), len(elements))):
            for r in after:
                if r["ordinal"] != ordinal or r["retracted"] is not None:
                    continue
                if r["from"] < start and (r["to"] is None or r["to"] > start):
                    r["to"] = start
                elif r["from"] == start and r["to"] is None:
                    r["retracted"] = at
        new = [{"ordinal": k, "value": v, "from": start, "to": None, "at": at, "retracted": None} for k, v in enumerate(elements)]
        clash = any(r["retracted"] is None and r["ordinal"] == n["ordinal"] and (r["to"] is None or r["to"] > start) for r in after for n in new)
        if clash:
            rejected.append(seq)
        else:
            rows = after + new
    return rows, rejected


@pytest.mark.parametrize("seed", range(3))
def test_list_writes_equal_a_plain_fold(spark, seed):
    rng = random.Random(seed)
    old, writes, want, refused = [], [], [], []
    for key in range(12):
        mine, at = [], 0
        if key % 3:
            mine = [{"ordinal": k, "value": v, "from": day(5), "to": None if key % 3 == 1 else day(8 + k), "at": day(5), "retracted": None} for k, v in enumerate("ab")]
        old += [(key, "t", r["ordinal"], r["value"], r["from"], r["to"], r["at"], None) for r in mine]
        own = []
        for k in range(rng.randrange(0, 9)):
            at += rng.randrange(3)
            start = 10 + at if key % 4 else rng.randrange(25)
            own.append(([rng.choice("abc") for _ in range(rng.randrange(4))], day(start), day(40 + k), k))
        writes += [(key, "t", e, s, a, q) for e, s, a, q in own]
        rows, rejected = plain_lists(mine, own)
        want += [(key, r["ordinal"], r["value"], r["from"], r["to"], r["at"], r["retracted"]) for r in rows]
        refused += [(key, q) for e, _, _, q in own if q in rejected and e]
    done = bt.apply_lists(spark.createDataFrame(old, S), spark.createDataFrame(writes, LISTS).repartition(3))
    got = [(r.object_id, r.ordinal, r.value, r.valid_from, r.valid_to, r.recorded_at, r.retracted_at) for r in done.state.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted({(r.object_id, r.seq) for r in done.rejects.collect()}) == sorted(refused)
    log = {}
    for r in done.log.collect():
        log[r.op] = log.get(r.op, 0) + r.n
    ended = lambda rows, c: sum(r[c] is not None for r in rows)
    assert log.get("SET_PROPERTY", 0) == len(want) - len(old)
    assert log.get("CLOSE_PROPERTY", 0) == ended(want, 4) - ended(old, 5) and log.get("RETRACT_PROPERTY", 0) == ended(want, 6)


def test_repeated_closings_and_retractions(spark):
    old = spark.createDataFrame([(1, "p", 0, "a", day(5), None, day(5), None), (1, "p", 1, "b", day(9), None, day(9), None), (2, "p", 0, "c", day(1), day(2), day(1), None)], S)
    ends = lambda rows, kind="object_id long, property string, until timestamp, seq long": spark.createDataFrame(rows, kind)
    out = bt.close_properties(old, ends([(1, "p", day(8), 1), (1, "p", day(20), 2), (1, "p", day(7), 3), (1, "p", None, 0), (2, "p", day(9), 1)]))
    assert sorted((r.object_id, r.ordinal, r.valid_to) for r in out.collect()) == [(1, 0, day(8)), (1, 1, day(20)), (2, 0, day(2))]
    out = bt.close_properties(old, ends([(1, "p", day(20)), (1, "p", day(7))], "object_id long, property string, until timestamp"))
    assert sorted((r.object_id, r.ordinal, r.valid_to) for r in out.collect()) == [(1, 0, day(7)), (1, 1, day(20)), (2, 0, day(2))]
    out = bt.retract_properties(old, ends([(1, "p", day(30)), (1, "p", day(29)), (2, "p", day(30))], "object_id long, property string, at timestamp"))
    assert sorted((r.object_id, r.ordinal, r.retracted_at) for r in out.collect()) == [(1, 0, day(29)), (1, 1, day(29)), (2, 0, None)]
    log = bt.property_log(old, out)
    assert sorted((r.op, r.ordinal, r.n) for r in log.collect()) == [("RETRACT_PROPERTY", 0, 1), ("RETRACT_PROPERTY", 1, 1)]


def plain_links(rows, source_one, target_one, symmetric, state=()):
    made, rejected = [list(r) for r in state], []
    is_open = lambda f, t: any(x[:2] == [f, t] and x[3] is None for x in made)
    for f, t, at, seq in rows:
        if is_open(f, t):
            continue
        after = [list(x) for x in made]
        for x in after:
            if x[3] is None and x[2] < at and (source_one and x[0] == f and x[1] != t or target_one and x[1] == t and x[0] != f):
                x[3] = at
        new = [[f, t, at, None]] + ([[t, f, at, None]] if symmetric and not is_open(t, f) else [])
        clash = f == t or any(x[:2] == n[:2] and (x[3] is None or x[3] > at) for x in after for n in new)
        if clash:
            rejected.append(seq)
        else:
            made = after + new
    return sorted(map(tuple, made), key=str), sorted(rejected)


def asserted(spark, rows):
    return spark.createDataFrame([("L", f, t, 1.0, at, day(100 + seq), seq) for f, t, at, seq in rows], LINKS)


@pytest.mark.parametrize("cardinality", ["ONE_TO_ONE", "ONE_TO_MANY", "MANY_TO_ONE", "MANY_TO_MANY"])
@pytest.mark.parametrize(("symmetric", "split", "late"), [(False, 0, 0.2), (False, 40, 0.1), (False, 30, 0), (True, 0, 0.2), (True, 25, 0)])
def test_links_equal_a_plain_fold(spark, cardinality, symmetric, split, late):
    rng = random.Random(f"{cardinality}{symmetric}{split}")
    names = [f"n{k}" for k in range(9)]
    rows = []
    for seq in range(100):
        f, t = rng.choice(names), rng.choice(names if symmetric else names[:3] + ["x", "y", "z"])
        rows.append((f, t, day(seq // 2 - (rng.randrange(30) if rng.random() < late else 0)), seq))
    one = (cardinality in ("ONE_TO_ONE", "MANY_TO_ONE"), cardinality in ("ONE_TO_ONE", "ONE_TO_MANY"), symmetric)
    state, before = None, ()
    if split:
        state = bt.link_objects(asserted(spark, rows[:split]), cardinality, symmetric)
        before = plain_links(rows[:split], *one)[0]
        assert sorted(((r.from_id, r.to_id, r.valid_from, r.valid_to) for r in state.collect()), key=str) == before
    done = bt.apply_links(asserted(spark, rows[split:]).repartition(3), cardinality, symmetric, state)
    want, rejected = plain_links(rows[split:], *one, before)
    assert sorted(((r.from_id, r.to_id, r.valid_from, r.valid_to) for r in done.state.collect()), key=str) == want
    got = done.rejects.collect()
    assert sorted(r.seq for r in got) == rejected
    assert all((r.reason == "SELF_LINK") == (r.from_id == r.to_id) for r in got)


def test_a_late_link_leaves_later_ones_open(spark):
    rows = [("A", "X", day(10), 1), ("A", "Y", day(5), 2), ("A", "X", day(20), 3)]
    out = bt.link_objects(asserted(spark, rows), "MANY_TO_ONE")
    assert sorted((r.to_id, r.valid_from, r.valid_to) for r in out.collect()) == [("X", day(10), None), ("Y", day(5), None)]
    assert bt.link_objects(asserted(spark, rows).limit(0), "ONE_TO_ONE").count() == 0
    more = asserted(spark, rows).withColumn("old", F.lit(1)).withColumn("group", F.lit("g"))
    assert bt.link_objects(more, "ONE_TO_MANY").count() == 2


@pytest.mark.parametrize("cardinality, rounds", [("ONE_TO_ONE", 60), ("ONE_TO_ONE", 2), ("ONE_TO_MANY", 60), ("MANY_TO_ONE", 60)])
def test_links_of_one_instant_are_told_by_windows(spark, monkeypatch, cardinality, rounds):
    """Many links of each instant, in order: the same as one by one, and none is folded unless the rounds don't suffice."""
    rng, folded = random.Random(5), []
    monkeypatch.setattr(bt, "ROUNDS", rounds)
    fold = bt.ordered.fold
    monkeypatch.setattr(bt.ordered, "fold", lambda rows, *more: folded.append(rows.count()) or fold(rows, *more))
    rows = [(f"a{rng.randrange(6)}", f"b{rng.randrange(4)}", day(k // 9), k) for k in range(180)]
    done = bt.apply_links(asserted(spark, rows).repartition(3), cardinality)
    want, _ = plain_links(rows, cardinality != "ONE_TO_MANY", cardinality != "MANY_TO_ONE", False)
    assert sorted(((r.from_id, r.to_id, r.valid_from, r.valid_to) for r in done.state.collect()), key=str) == want
    assert done.rejects.count() == 0
    assert folded == [0] if rounds == 60 else folded[0] > 0


def test_links_in_order_hold_open_ones_only():
    links, out = bt._Links(True, True, False), []
    for k in range(3000):
        row = {"link_type": "L", "from_id": f"C{k}", "to_id": f"K{k % 3}", "weight": 1.0, "valid_from": pd.Timestamp(day(1)) + pd.Timedelta(hours=k), "valid_to": None, "recorded_at": None, "retracted_at": None, "seq": k, "old": False}
        out += links.put(row | {"ahead": row["valid_from"] + pd.Timedelta(hours=1) if k < 2999 else None})
    assert len(out) == 2997 and len(links.open) == 3 and len(links.by) == 6 and not links.ended
