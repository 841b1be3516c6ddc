"""The pipeline, stage by stage, against brute force on what each stage got."""

import math
import random
import uuid
from collections import Counter, defaultdict

import pytest

from chronark.llm import decontaminate, language_id, mixing
from tests.llm.conftest import prose
from tests.llm.test_mix_shard import brute_targets, check_shards, plain_loads, size_of
from tests.llm.test_pairs import brute_components
from tests.llm.test_text_operators import LANGS, brute_distance

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(21)
    rows = []
    for i in range(240):
        lang = rng.choice(list(LANGS))
        rows.append((i, prose(rng, rng.randint(8, 60), LANGS[lang]), lang, rng.choice(["a", "a", "a", "b", None]), i))
    items = [(k, prose(rng, 14, LANGS["aa"])) for k in range(4)] + [(9, None), (None, "no id")]
    for k in range(12):
        rows.append((300 + k, f"{prose(rng, 20, LANGS['aa'])} {items[k % 4][1].upper()}! {prose(rng, 9, LANGS['aa'])}", "aa", "b", None))
    for k in range(30):  # near and exact copies
        words = rows[k % 6][1].split()
        if k % 2 and len(words) > 40:
            words[rng.randrange(len(words))] = "lolo"
        rows.append((400 + k, " ".join(words), rows[k % 6][2], "a", 1))
    rows += [(500, None, "aa", "a", 1), (501, "", "aa", "a", None), (502, "123 !", None, None, None), (503, " ", None, "a", 1), (504, "щщ жж фф ыы яя " * 9, None, "a", 1), (None, rows[9][1], "aa", "b", None), (None, prose(rng, 40, LANGS["aa"]), None, "a", 2), rows[11], rows[11], (12, prose(rng, 33, LANGS["bb"]), None, "a", 1)]
    return rows, items


def key(r):
    return tuple(r[:4])


def test_stages_equal_brute_force(spark, tmp_path):
    rows, items = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixture", "shards"]
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), [rows]
    for name, stage in corpus_pipeline.STAGES:
        at = f"{tmp_path}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, str(tmp_path)).write.parquet(at)
        docs = spark.read.parquet(at)
        if name != "shards":
            assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
        kept.append([tuple(r) for r in docs.collect()])
    after_language, after_copies, clean, mixed, shards = kept[1:]

    gone = Counter(r[0] for r in rows) - Counter(r[0] for r in after_language)
    assert {500, 501, 502, 503, 504} <= set(gone) and sum(gone.values()) <= 12
    want = {(r[0], r[1]): r[2] for r in rows if r[2]}
    assert all(want.get((r[0], r[1]), r[2]) == r[2] for r in after_language)

    with_id = [(r[0], r[1]) for r in after_language if r[0] is not None]
    classes = {i: c for i, _, c in brute_components(with_id)}
    assert Counter(map(key, after_copies)) == Counter(key(r) for r in after_language if r[0] is None or classes[r[0]] == r[0])
    assert len(after_copies) < len(after_language) - 20

    wanted = [decontaminate.normalised(t) for i, t in items if i is not None and t]
    found = lambda t: any(brute_distance(n, decontaminate.normalised(t)) <= int(len(n) * decontaminate.RATE) for n in wanted)
    assert Counter(map(key, clean)) == Counter(key(r) for r in after_copies if not found(r[1]))
    assert len(clean) <= len(after_copies) - 12

    plan = mixing.plan(spark.createDataFrame(clean, SCHEMA)).collect()
    copies = defaultdict(int)
    for r in plan:
        copies[r.doc_id, r.source, r.size] += r.copies if r.size else 1
    assert Counter((r[0], r[3], size_of(r[1])) for r in mixed) == Counter({k: n for k, n in copies.items() if n})
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in clean:
        sizes[r[3]] += size_of(r[1])
    for r in mixed:
        taken[r[3]] += size_of(r[1])
    assert all(abs(taken[s] - t) <= 130 for s, t in brute_targets(sizes).items())

    loads = [0] * 16
    for r in shards:
        loads[r[4]] += r[1]
    assert loads == plain_loads([(r[0], r[1]) for r in mixed], 16)
    named = [type("Row", (), dict(zip(docs.columns, r, strict=True))) for r in shards]
    check_shards([(r[0], r[1]) for r in mixed], named, 16)

    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in again) == Counter((r[0], r[1], r[2]) for r in shards)


def test_stages_of_odd_and_empty_tables(spark, odd, nothing, tmp_path):
    benchmark = [(1, "some words that no text has at all"), (2, None)]
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "shards":
                assert out.columns == docs.columns
            n = out.count()
            assert n == 0 if docs is nothing else n > 0
    assert math.isclose(language_id.SPREAD, 0.05)
