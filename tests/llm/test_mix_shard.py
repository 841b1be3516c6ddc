"""Mixing and sharding: laws that any right result obeys, and small brute-force versions."""

import random
import re
import zlib
from collections import defaultdict

import pytest

from chronark.llm import mixing, sharding
from tests.llm.conftest import prose


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight of all sizes, capped at ``most`` times a source's size, the excess dealt again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(most * sizes[s] for s in over)
        free -= set(over)
    return target


def docs_of(seed, n=900):
    rng = random.Random(seed)
    return [(i, prose(rng, rng.randint(1, 60)), rng.choice(["hot"] * 6 + ["b", "c", "ä", "Z", None, "rare" if i % 40 == 0 else "b"])) for i in range(n)]


def test_mix_meets_targets(spark):
    rows = docs_of(1)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.plan(df).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        sizes[source] += size_of(text)
    targets = brute_targets(sizes)
    for r in got:
        assert r.size == size_of(rows[r.doc_id][1]) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        assert abs(r.target - targets[r.source]) < 1e-6 * max(1, targets[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 130 for s in sizes)
    assert sum(taken.values()) <= sum(sizes.values()) < sum(taken.values()) + 130
    again = mixing.plan(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    copies = {r.doc_id: r.copies for r in got}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    seen = defaultdict(int)
    for r in mixed.collect():
        seen[r.doc_id] += 1
    assert seen == {i: k for i, k in copies.items() if k}


def brute_copies(got, weights=(5, 2, 1), most=3):
    """Plain weighted fair queueing: each source's documents in the plan's order, ``most`` times; what finishes first is taken."""
    names = sorted({r.source for r in got}, key=lambda s: (s is None, s or ""))
    queue, budget = [], sum(r.size for r in got)
    for k, name in enumerate(names):
        mine = sorted((r for r in got if r.source == name and r.size), key=lambda r: r.finish)
        upto = 0
        for lap in range(most):
            for r in mine:
                upto += r.size
                queue.append((upto / weights[k % len(weights)], r.doc_id, r.size))
                if lap == 0:
                    assert abs(r.finish - queue[-1][0]) < 1e-6 * max(1, r.finish)
    taken, copies = 0, defaultdict(int)
    for _, i, size in sorted(queue):
        if taken + size > budget:
            break
        taken += size
        copies[i] += 1
    return copies


@pytest.mark.parametrize("ordered, run", [(50_000, 4_000), (40, 4_000), (40, 20)])
def test_mix_equals_plain_queueing(spark, monkeypatch, ordered, run):
    monkeypatch.setattr(mixing, "ORDERED", ordered)
    monkeypatch.setattr(mixing, "RANGES", 8 if ordered < 100 else 4096)
    monkeypatch.setattr(mixing, "RUN", run)
    got = mixing.plan(spark.createDataFrame(docs_of(2), "doc_id long, text string, source string")).collect()
    want = brute_copies(got)
    # documents that finish at one time are taken together or not at all: one of a source at most differs
    assert sum(want[r.doc_id] != r.copies for r in got) <= 2
    assert all(abs(want[r.doc_id] - r.copies) <= 1 for r in got)


def test_mix_is_in_order_of_finish(spark):
    df = spark.createDataFrame(docs_of(3, 300), "doc_id long, text string, source string")
    plan = {r.doc_id: r for r in mixing.plan(df).collect()}
    want = sorted((p.finish + k * p.lap, i) for i, p in plan.items() for k in range(p.copies))
    got = [r.doc_id for r in mixing.mix(df).collect()]
    assert sorted(got) == sorted(i for _, i in want)
    seen, times = defaultdict(int), []
    for i in got:
        times.append(plan[i].finish + seen[i] * plan[i].lap)
        seen[i] += 1
    assert times == sorted(times)


@pytest.mark.parametrize("parts", [1, 7])
def test_repeated_rows_share_what_is_taken(spark, parts):
    rows = docs_of(4, 60) + [(1000, "one two three four", "hot")] * 50 + [(1000, "one two three four", "Z")] * 9 + [(None, None, None)] * 3
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, source string, row long").repartition(parts)
    plan, want = mixing.plan(df).collect(), defaultdict(int)
    for r in plan:
        want[r.doc_id, r.source] += r.copies if r.size else 1
    got, each = defaultdict(int), defaultdict(int)
    for r in mixing.mix(df).collect():
        got[r.doc_id, r.source] += 1
        each[r.row] += 1
    assert got == {k: n for k, n in want.items() if n}
    assert max(each.values()) <= 3
    for source, n in (("hot", 50), ("Z", 9)):
        counts = [each[k] for k, r in enumerate(rows) if r[0] == 1000 and r[2] == source]
        assert len(counts) == n and max(counts) - min(counts) <= 1


def test_mix_of_odd_rows(odd, odd_rows, nothing):
    got = mixing.plan(odd).collect()
    assert len(got) == len(odd_rows)
    assert all(r.taken <= 3 * r.size for r in got)
    assert mixing.plan(nothing).collect() == [] and mixing.mix(nothing).collect() == []
    assert mixing.mix(odd).columns == odd.columns


def check_shards(rows, got, shards):
    assert len(got) == len(rows)
    of, slots, loads = {}, defaultdict(list), [0] * shards
    for r in got:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    want = defaultdict(list)
    for r in got:
        of.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    for i, text in rows:
        raw = (text or "").encode()
        want[i].append((len(raw) + 1, zlib.crc32(raw)))
        assert len(of[zlib.crc32(raw), len(raw) + 1]) == 1
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.size, r.text_crc32))
    assert {i: sorted(x) for i, x in have.items()} == {i: sorted(x) for i, x in want.items()}
    return loads


def plain_loads(rows, shards):
    """Loads of plain longest-processing-time scheduling, group by group."""
    groups, loads = defaultdict(int), [0] * shards
    for _, text in rows:
        groups[text or ""] += len((text or "").encode()) + 1
    for size in sorted(groups.values(), reverse=True):
        loads[loads.index(min(loads))] += size
    return loads


def test_shards(spark, odd, odd_rows, nothing, monkeypatch):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.choice([1, 3, rng.randint(1, 80)])) if i % 9 else "same text") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert check_shards(rows, sharding.assign(df).collect(), 16) == plain_loads(rows, 16)
    monkeypatch.setattr(sharding, "RUN", 10)
    assert check_shards(rows, sharding.assign(df, 5).collect(), 5) == plain_loads(rows, 5)
    odd_texts = [(r[0], r[1]) for r in odd_rows]
    assert check_shards(odd_texts, sharding.assign(odd, 4).collect(), 4) == plain_loads(odd_texts, 4)
    assert sharding.assign(nothing).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_size_classes_are_scheduled_as_single_groups(seed):
    rng = random.Random(seed)
    shards = rng.choice([1, 2, 5, 16])
    classes = [(s, rng.choice([1, 2, 5, 50, 400])) for s in rng.sample(range(1, 200), rng.randint(1, 20))]
    loads, want = [0] * shards, {}
    for size, count in sorted(classes, reverse=True):
        want[size] = [0] * shards
        for _ in range(count):
            k = loads.index(min(loads))
            loads[k] += size
            want[size][k] += 1
    assert sharding.schedule(classes, shards) == want
