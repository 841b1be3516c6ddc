"""Jaccard join, exact duplicates and near-duplicate lines against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from chronark.llm import exact_dedup, jaccard, line_dedup
from tests.llm.conftest import prose


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([" ".join(words)] if 0 < len(words) < 5 else [" ".join(words[k : k + 5]) for k in range(len(words) - 4)])


def brute_components(rows):
    """(doc_id, n, component) of rows with ids; ids that repeat are one document."""
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def family_rows(seed, n=60):
    rng = random.Random(seed)
    rows, shared = [], prose(rng, 50)
    for f in range(6):
        words = prose(rng, rng.choice([4, 8, 40, 150])).split()
        for _ in range(n // 6):
            w = list(words)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(["new", "other", "ba", "lo"])
            rows.append(" ".join(w) + (" " + shared if f % 2 else ""))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 300)
    rows = family_rows(seed)
    got = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect())) == brute_components(rows)


def test_components_of_odd_rows(odd, odd_rows, nothing):
    got = sorted((tuple(r) for r in jaccard.components(odd).collect() if r[0] is not None))
    assert got == brute_components([(r[0], r[1]) for r in odd_rows if r[0] is not None])
    none = [tuple(r) for r in jaccard.components(odd).collect() if r[0] is None]
    assert sorted(none, key=str) == sorted([(None, len(shingles(odd_rows[7][1])), 7), (None, 0, None)], key=str)
    assert jaccard.components(nothing).collect() == []
    kept = jaccard.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, c in got if i == c} | {None}


def test_exact_dedup(spark, odd, odd_rows, nothing):
    groups = defaultdict(list)
    for r in odd_rows:
        groups[r[1] or ""].append(r[0])
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    assert sorted(map(str, map(tuple, exact_dedup.flag_copies(odd).collect()))) == sorted(map(str, want))
    assert exact_dedup.flag_copies(nothing).collect() == []
    left = exact_dedup.drop_copies(odd)
    assert left.columns == odd.columns and left.count() == len(groups)


def test_heavy_digests_are_counted_exactly(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 700}") for i in range(3000)]
    digests = exact_dedup._digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "doc_id", "text")
    found = {r.text_sha256: (r.keep_id, r.group_size) for r in exact_dedup.frequent(digests).collect()}
    assert found[hashlib.sha256(b"hot").hexdigest()] == (2997, 1000)
    assert len(found) <= 1 / exact_dedup.SUPPORT


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(rows):
    key = lambda i: 2**63 - 1 if i is None else i
    order = {}  # texts of one id stand in the order of a hash: of two, take the one that the operator puts first
    lines = sorted({(key(i), order.setdefault((key(i), t), t), k, x.strip(" ")) for i, t in rows if t is not None for k, x in enumerate(t.split("\n")) if x.strip(" ")})
    first = {}
    for i, t, k, x in lines:
        first.setdefault(x, (i, t, k))
    long = [x for x in first if len(x) >= line_dedup.PER_EDIT]
    near = {x for x in long for y in long if first[y] < first[x] and abs(len(x) - len(y)) <= 1 and distance(x, y) <= 1}
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        old = t.split("\n")
        new = [x for k, x in enumerate(old) if not x.strip(" ") or (x.strip(" ") not in near and first[x.strip(" ")] == (key(i), t, k))]
        out.append((i, "\n".join(new), len(old), len(old) - len(new)))
    return sorted(out, key=str)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    bases = [prose(rng, rng.randint(5, 12)) for _ in range(12)] + ["a" * 25, "ab" * 12, "Share this page", "}", "see also"]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(1, 5)):
            x = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(x))
                edit = rng.choice("sid")
                x[at : at + (edit != "i")] = [] if edit == "d" else [rng.choice("abxé")]
            lines.append(" " * rng.randint(0, 1) + "".join(x))
        rows.append((i, "\n".join(lines)))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == brute_lines(rows)


def test_line_dedup_of_odd_rows(spark, odd, odd_rows, nothing):
    got = sorted(map(tuple, line_dedup.dedup_lines(odd).collect()), key=str)
    assert got == brute_lines([(r[0], r[1]) for r in odd_rows])
    assert line_dedup.dedup_lines(nothing).collect() == []
    # without an id, texts are told apart by themselves: of two lines at one place, one goes
    rows = [(None, "a line that many texts share\nfirst"), (None, "a line that many texts share\nsecond"), (None, "alone")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in out) == [0, 0, 1]


def test_within_one_edit():
    rng = random.Random(3)
    for _ in range(3000):
        a = "".join(rng.choice("aé\U0001f600") for _ in range(rng.randrange(7)))
        b = list(a)
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = rng.choice(["", "a", "é"])
        b = "".join(b)
        rows = [list(range(len(b) + 1))]
        for i, x in enumerate(a, 1):
            rows.append([i])
            for j, y in enumerate(b, 1):
                rows[i].append(min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (x != y)))
        assert line_dedup.within_one(a, b) == (rows[-1][-1] <= 1)


def test_long_lines_and_many_lines(spark):
    rng = random.Random(4)
    line = "".join(rng.choice("abcdefghij ") for _ in range(60_000)) + "x"
    many = "\n".join(f"number {k} of many lines" for k in range(30_000))
    rows = [(1, line), (2, line[:20_000] + "Z" + line[20_001:]), (3, line[:50_000] + line[50_001:]), (4, line[:9] + "ZZZ" + line[9:]), (5, many), (6, many + "\nlast one")]
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # a number's first digit may be the edit
    assert {k: got[k] for k in (1, 2, 3, 4, 6)} == {1: (1, 0), 2: (1, 1), 3: (1, 1), 4: (1, 0), 6: (30_001, 30_000)}
    assert got[5][0] == 30_000
    plain = line_dedup.dedup_lines(spark.createDataFrame(rows[:3], "doc_id long, text string"), edits=0)
    assert {r.n_removed for r in plain.collect()} == {0}
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(spark.createDataFrame(rows[:1], "doc_id long, text string"), edits=2)
