"""Hard negatives, the filter audit and repeated bytes against brute force."""

import math
import random
import re
from itertools import permutations

import numpy as np
import pytest

from chronark.llm import filter_audit, hard_negatives, repeated_bytes
from tests.llm.conftest import prose

VECTORS = "vec_id long, embedding array<float>, label int, score string, anchor long, block int"


def brute_negatives(rows):
    used = set()
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        used.add((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, tuple(math.floor(256 * float(x)) for x in v)))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, label, v in used:
        if i is None or i % 50:
            continue
        score = [(sum(a * b for a, b in zip(v, w, strict=False)), j, other) for j, other, w in used if j is None or j != i]
        for ps, p, _ in sorted((x for x in score if x[2] == label), key=order)[:5]:
            fits = sorted((x for x in score if x[2] != label and 50 * ps <= 100 * x[0] <= 95 * ps), key=order)[:3]
            out += [(i, p, k, n, ps, ns) for k, (ns, n, _) in enumerate(fits, 1)]
    return sorted(out, key=repr)


def vectors(seed, n=400, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim))
    rows = []
    for i in range(n):
        v = centres[i % 4] + rng.normal(size=dim) * (0.2 if i % 3 else 1.0)
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(4))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(hard_negatives, "WINDOW", 16)
    monkeypatch.setattr(hard_negatives, "CHUNK", 90)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rows = vectors(seed)
    same = [(1000 + k, rows[0][1], rows[0][2]) for k in range(40)]  # ties
    rows += same + [(i, v, 9 - label) for i, v, label in vectors(9, 30)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS)
    assert sorted(map(tuple, hard_negatives.mine(df).collect()), key=repr) == brute_negatives(rows)


def test_hard_negatives_of_odd_rows(spark):
    rows = vectors(3, 120) + [(7, None, 1), (50, [1.0, None], 1), (100, [math.nan, 1.0], 1), (150, [math.inf], 2), (200, [], 1), (None, vectors(3)[0][1], 1), (350, [0.5, 0.5], None), (250, [0.0] * 8, 2)]
    rows += [rows[0], (0, vectors(4)[0][1], 3), (3000, [3e38, 1e38, 0.0], 1), (3050, [2e38, 1e38], 1), (3051, [1e38, 1e38], 1), (3052, [1.0e38, 1.0e38], 2), (3053, [-3e38, 0.0], 2)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS)
    got = hard_negatives.mine(df)
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    top = 2**63 - 1
    want = [(*r[:4], max(-top, min(top, r[4])), max(-top, min(top, r[5]))) for r in brute_negatives(f32)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert hard_negatives.mine(df.limit(0)).count() == 0


def test_bounds_hold_for_every_pair():
    rng = np.random.default_rng(5)
    import pandas as pd

    def block(m):
        refs = rng.normal(size=(6, 5))
        refs /= np.linalg.norm(refs, axis=1)[:, None]
        return refs, lambda x: hard_negatives.Block(pd.DataFrame({"vec_id": range(len(x)), "label": 1, "v": list(x), "norm": hard_negatives._norms(x), "angles": list(hard_negatives._angles(x, refs))}), 5)

    _, make = block(None)
    centre = rng.normal(size=5) * 100
    a, w = make(np.floor(rng.normal(size=(50, 5)) * 200)), make(np.floor(centre + rng.normal(size=(30, 5)) * 5))
    lower, upper = hard_negatives.bounds(a, (w.norm.min(), w.norm.max()), w.angles.min(axis=0), w.angles.max(axis=0))
    s = a.m @ w.m.T
    assert (s >= lower[:, None]).all() and (s <= upper[:, None]).all()
    assert (upper < np.abs(a.norm * w.norm.max())).any()  # they say something


def brute_audit(docs, labels):
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                 "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > first[text]}
        rows.append((lang or "", fails, any(d == i and q == 1 for d, q, _ in labels if d is not None), any(d == i and t == 1 for d, _, t in labels if d is not None)))
    out, removed_by = [], {}
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                every = [r for r in rows if r[0] == part and r[1][f]]
                alone = [r for r in every if sum(r[1].values()) == 1]
                removed_by[part, f] = removed_by.get((part, f), 0) + len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), len(every) - len(gone), len(alone), sum(r[2] for r in gone), sum(r[3] for r in gone), f])
    return sorted((*r[:-1], removed_by[r[0], r[-1]]) for r in out)


def test_filter_audit_equals_brute_force(spark):
    rng = random.Random(4)
    docs = []
    for i in range(60):
        text = prose(rng, rng.choice([5, 150, 220, 400])) + rng.choice(["", " #", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 3, " the the" * 300])
        docs.append((i, rng.choice([text, docs[-1][1] if docs else text]), rng.choice(["en", "fr", None, ""])))
    docs += [(None, docs[0][1], "en"), (None, None, "en"), (100, None, "fr"), (101, "", "fr"), (3, docs[3][1], "en"), (102, "x y\x0bz", None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(50)] + [(0, 1, 1), (0, 0, 0), (None, 1, 1)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, lang string, mask long, part string").repartition(3)
    got = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == brute_audit(docs, labels)
    assert filter_audit.audit(df.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_swaps_visit_every_order():
    order, seen = list(range(5)), {(0, 1, 2, 3, 4)}
    for d in filter_audit.neighbouring_swaps(5):
        order[d], order[d + 1] = order[d + 1], order[d]
        seen.add(tuple(order))
    assert len(seen) == 120 == len(list(filter_audit.neighbouring_swaps(5))) + 1


def brute_repeats(docs):
    """By (id, text): (n_bytes, spans, kept); documents in order of id (null last)."""
    seen, out = set(), {}
    for i, text in sorted({(i, t or "") for i, t in docs}, key=lambda d: (d[0] is None, d[0] or 0)):
        data = text.encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(data[k : k + 100])
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out[i, text] = (len(data), sum(gone), spans, bytes(c for c, g in zip(data, gone, strict=True) if not g))
    return out


def check_repeats(spark, docs):
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, batch long, hash long").repartition(3)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], [tuple(x) for x in r["spans"]], bytes(r["kept"])) for r in repeated_bytes.remove_repeats(df).collect()), key=repr)
    want = brute_repeats(docs)
    assert got == sorted(((i, *want[i, t or ""]) for i, t in docs), key=repr)


def repeating(seed):
    rng = random.Random(seed)
    shared = [prose(rng, n) for n in (20, 40, 120)]
    docs = []
    for i in range(60):
        parts = [prose(rng, rng.randint(1, 40))] + [rng.choice(shared)[rng.randrange(30) :] for _ in range(rng.randrange(3))] + [prose(rng, rng.randint(1, 20))]
        docs.append((i, " ".join(parts)))
    return [*docs, (60, "ab" * 500), (61, "abcdefghi" * 40), (62, "x" * 99), (63, "x" * 100), (64, "é漢" * 90), (65, docs[0][1]), (66, docs[1][1] * 3)]


@pytest.mark.parametrize(("hot", "batch"), [(4096, 1 << 22), (4096, 3000), (0, 3000), (2, 2000)])
def test_repeats_equal_brute_force(spark, hot, batch, monkeypatch):
    monkeypatch.setattr(repeated_bytes, "HOT", hot)
    monkeypatch.setattr(repeated_bytes, "BATCH", batch)
    monkeypatch.setattr(repeated_bytes, "GROUP", batch)
    check_repeats(spark, repeating(batch + hot))


def test_repeats_of_odd_rows(spark):
    rng = random.Random(8)
    base = prose(rng, 60)
    check_repeats(spark, [(1, None), (2, ""), (3, base), (3, base), (None, base), (None, None), (4, base[5:]), (5, prose(rng, 4000)), (6, "a\0b" * 60), (7, "\0" * 150)])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeated_bytes.remove_repeats(empty).count() == 0


def test_suffixes_are_separated_where_their_prefixes_are_shorter():
    rng = random.Random(3)
    text = np.array([rng.choice([0, 1, 2]) for _ in range(700)] + [3, 4] * 40, np.uint16)
    for length in (1, 4, 20):
        order = repeated_bytes.suffix_order(text, length)
        prefix = [tuple([*text[a : a + length], *[0] * length][:length]) for a in order]
        assert prefix == sorted(prefix)
        assert list(repeated_bytes.separated(text, order, length)) == [True] + [a != b for a, b in zip(prefix, prefix[1:], strict=False)]

