"""Hard-negative mining by angular triangle filtering.

Every vector stores its norm and its angles to a few reference directions. Angles are a metric, so for any two vectors u, v and
reference r: |angle(u, r) - angle(v, r)| <= angle(u, v) <= angle(u, r) + angle(v, r). With the norms that bounds the score from both sides.
Vectors of one label that are near each other in angle form windows; a window stores the range of its norms and angles. An
anchor scores the vectors of a window only if the window's bounds, widened by more than rounding can do, reach into what the
anchor still looks for: scores that enter its best positives, or the range of scores in which a positive's negatives lie.

Anchors go in blocks against chunks of windows, one task each; a block and a chunk have a bounded size, whatever a label's share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronark.llm import _runtime

SCALE, EVERY = 256, 50
POSITIVES, NEGATIVES = 5, 3
#: Negatives have a score from 50 to 95 hundredths of the positive's.
LOW, HIGH = 50, 95
REFERENCES, SAMPLE = 12, 4096
WINDOW, ANCHORS, CHUNK = 256, 4096, 32768
#: Scores whose size stays under this are exact in doubles; others are computed with Python's integers.
EXACT = 2.0**52
#: Components beyond this, once scaled, count as not finite: no product of two overflows a double.
LARGEST = 1e150
_LONG = 2**63 - 1
_SCORE = "score long, beyond string"
ROWS = "vec_id long, label long, v array<double>, norm double, angles array<double>, near int"


def _quantised(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, equal rows once; v has the components' integers, as doubles."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.transform(F.col(vec_col), lambda x: x.cast("double") * SCALE).alias("v"))
    rows = rows.where(F.col("label").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(2)
            whole = pa.ListArray.from_arrays(v.offsets, pa.array(np.floor(v.values.to_numpy(zero_copy_only=False)) + 0.0, pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), whole], ["vec_id", "label", "v"])

    return rows.select("vec_id", label.alias("label"), "v").mapInArrow(floors, "vec_id long, label long, v array<double>").distinct()


def _matrix(vectors: list[np.ndarray] | np.ndarray, dim: int) -> np.ndarray:
    """Rows of ``dim`` components: shorter vectors are filled with zeros."""
    out = np.zeros((len(vectors), dim))
    for k, v in enumerate(vectors):
        out[k, : min(len(v), dim)] = v[:dim]
    return out


def _norms(m: np.ndarray) -> np.ndarray:
    big = np.abs(m).max(axis=1, initial=0.0)
    safe = np.where(big > 0, big, 1.0)
    return np.sqrt(((m / safe[:, None]) ** 2).sum(axis=1)) * safe


def _angles(m: np.ndarray, refs: np.ndarray) -> np.ndarray:
    norm = _norms(m)
    unit = m / np.where(norm > 0, norm, 1.0)[:, None]
    return np.arccos(np.clip(unit @ refs.T, -1.0, 1.0))


def references(rows: DataFrame) -> np.ndarray:
    """Unit vectors far from each other, of the ``SAMPLE`` vectors that come first by hash: they decide how much is skipped, never the result."""
    sample = [np.array(r["v"], float) for r in rows.orderBy(F.xxhash64("vec_id", "label"), "vec_id").limit(SAMPLE).select("v").collect()]
    dim = max((len(v) for v in sample), default=0)
    m = _matrix(sample, dim)
    norm = _norms(m) if dim else np.zeros(len(sample))
    m = m[norm > 0] / norm[norm > 0][:, None]
    if not len(m):
        return np.zeros((1, max(dim, 1)))
    chosen = [m[0]]
    nearest = m @ m[0]
    for _ in range(min(REFERENCES, len(m)) - 1):
        chosen.append(m[int(nearest.argmin())])
        nearest = np.maximum(nearest, m @ chosen[-1])
    return np.array(chosen)


def _with_angles(rows: DataFrame, refs: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.asarray(v, float) for v in batch.column(2).to_pylist()]
            dim = max([refs.shape[1], *map(len, vectors)])
            m = _matrix(vectors, dim)
            angles = _angles(m, np.pad(refs, ((0, 0), (0, dim - refs.shape[1]))))
            made = [pa.array(_norms(m)), pa.array(list(angles), pa.list_(pa.float64())), pa.array(angles.argmin(axis=1).astype("int32"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], ["vec_id", "label", "v", "norm", "angles", "near"])

    return rows.mapInArrow(run, ROWS)


class Block:
    """Vectors as one matrix: of anchors, or of a window."""

    def __init__(self, rows: pd.DataFrame, dim: int):
        ids = rows["vec_id"].to_numpy()
        self.known = ~pd.isna(ids)
        self.ids = np.where(self.known, ids, 0).astype(object).astype("int64") if len(ids) else np.zeros(0, "int64")
        self.labels = rows["label"].to_numpy().astype("int64")
        self.m = _matrix(rows["v"].to_numpy(), dim)
        self.norm = rows["norm"].to_numpy()
        self.angles = np.stack(rows["angles"].to_numpy()) if len(rows) else np.zeros((0, 1))


def bounds(anchors: Block, norms: tuple[float, float], least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bound of each anchor's score with any vector whose norm and angles lie in these ranges.

    A zero vector has angle pi/2 to everything and score 0, which the norm's range covers. Bounds are widened by a share of the norms' product.
    """
    gap = np.maximum(0.0, np.maximum(least - anchors.angles, anchors.angles - most)).max(axis=1)
    total = np.minimum(anchors.angles + most, 2 * math.pi - anchors.angles - least).min(axis=1)
    near, far = np.cos(np.clip(gap - 1e-6, 0, math.pi)), np.cos(np.clip(total + 1e-6, 0, math.pi))
    products = np.stack([anchors.norm * n for n in norms])
    slack = products.max(axis=0) * 1e-6 + 1e-6
    return (products * far).min(axis=0) - slack, (products * near).max(axis=0) + slack


def scores(a: Block, rows: np.ndarray, w: Block, cols: slice) -> np.ndarray:
    """Integer inner products: as doubles where these are exact, else as Python's integers."""
    if len(rows) and a.norm[rows].max() * w.norm[cols].max(initial=0.0) < EXACT:
        return a.m[rows] @ w.m[cols].T
    whole = lambda m: np.array([[int(x) for x in v] for v in m], dtype=object).reshape(m.shape)
    return whole(a.m[rows]).dot(whole(w.m[cols]).T)


class Best:
    """The first ``k`` scores of each of ``n`` seekers: higher first, ties by smaller id, null ids last."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -math.inf)
        self.found: tuple[np.ndarray, ...] = (np.zeros(0, "int64"), np.zeros(0), np.zeros(0, "int64"), np.zeros(0, bool))

    def add(self, seeker: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        if not len(seeker):
            return
        seeker, score, ids, known = (np.concatenate(x) for x in zip(self.found, (seeker, score, ids, known), strict=True))
        order = np.lexsort((ids, ~known, -score, seeker))
        seeker, score, ids, known = seeker[order], score[order], ids[order], known[order]
        first = np.flatnonzero(np.r_[True, seeker[1:] != seeker[:-1]])
        place = np.arange(len(seeker)) - np.repeat(first, np.diff(np.r_[first, len(seeker)]))
        stays = place < self.k
        self.found = tuple(x[stays] for x in (seeker, score, ids, known))
        last = place == self.k - 1
        least = score[last].astype(float)
        self.least[seeker[last]] = np.where(np.abs(least) < EXACT, least, np.nextafter(least, -math.inf))


def _first(s: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``k`` highest scores of each row among those that fit, and of all that equal the last of them."""
    if s.dtype != object and s.shape[1] > k:
        s = np.where(fits, s, -math.inf)
        fits = fits & (s >= np.partition(s, -k, axis=1)[:, -k][:, None])
    return np.nonzero(fits)


def _written(score: np.ndarray) -> dict[str, pa.Array]:
    """Scores as longs; of one beyond a long also a text that sorts as it does."""
    whole = [int(s) for s in score]
    texts = [f"{len(t := str(abs(s))):05d}{t}" if abs(s) > _LONG else "" for s in whole]
    beyond = [t if s > 0 else "".join(str(9 - int(c)) for c in t) for s, t in zip(whole, texts, strict=True)]
    return {"score": pa.array([max(-_LONG, min(_LONG, s)) for s in whole], pa.int64()), "beyond": pa.array(beyond, pa.string())}


def _windows(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Runs of ``WINDOW`` rows of one label, near each other in angle, ordered by id within."""
    rows = rows.assign(turn=[a[n] for a, n in zip(rows["angles"], rows["near"], strict=True)]).sort_values(["label", "near", "turn", "vec_id"])
    for _, same in rows.groupby("label", sort=False):
        for k in range(0, len(same), WINDOW):
            yield same.iloc[k : k + WINDOW]


def _scan(anchors: pd.DataFrame, rows: pd.DataFrame, visit) -> None:
    """Calls ``visit(anchors, window, lower, upper)`` for each window of ``rows``, the most promising first."""
    dim = max(len(v) for d in (anchors, rows) for v in d["v"]) if len(anchors) and len(rows) else 0
    a, todo = Block(anchors, dim), []
    for part in _windows(rows) if dim or len(rows) else ():
        w = Block(part, dim)
        lower, upper = bounds(a, (w.norm.min(), w.norm.max()), w.angles.min(axis=0), w.angles.max(axis=0))
        todo.append((upper.max(), lower, upper, w))
    for _, lower, upper, w in sorted(todo, key=lambda x: -x[0]):
        visit(a, w, lower, upper)


def _same(a: Block, rows: np.ndarray, w: Block) -> np.ndarray:
    """Whether row and column have the same known id."""
    return (a.ids[rows][:, None] == w.ids[None, :]) & w.known[None, :]


def _positives(_: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
    anchors, rows = anchors.to_pandas(), rows.to_pandas()
    best = Best(len(anchors), POSITIVES)

    def visit(a: Block, w: Block, lower: np.ndarray, upper: np.ndarray) -> None:
        seek = np.flatnonzero((a.labels == w.labels[0]) & (upper >= best.least))
        if not len(seek):
            return
        s = scores(a, seek, w, slice(None))
        i, j = _first(s, (s >= best.least[seek][:, None]) & ~_same(a, seek, w), POSITIVES)
        best.add(seek[i], s[i, j], w.ids[j], w.known[j])

    if len(anchors) and len(rows):
        _scan(anchors, rows, visit)
    seeker, score, ids, known = best.found
    return pa.table({
        "anchor": pa.array(anchors["anchor"].to_numpy()[seeker], pa.int64()), "positive_id": pa.array(ids, pa.int64(), mask=~known), **_written(score),
    })


def _negatives(_: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
    anchors, rows = anchors.to_pandas(), rows.to_pandas()
    every = [(k, x["place"], int(x["beyond"][5:]) if x["beyond"] and x["score"] > 0 else int(x["score"])) for k, xs in enumerate(anchors["positives"]) for x in xs]
    owner, place = (np.array([x[k] for x in every], "int64") for k in range(2))
    lo = np.array([-(-LOW * x[2] // 100) for x in every], dtype=object)
    hi = np.array([HIGH * x[2] // 100 for x in every], dtype=object)
    if all(abs(x) < EXACT for x in (*lo, *hi)):
        lo, hi = lo.astype(float), hi.astype(float)
    best = Best(len(every), NEGATIVES)

    def visit(a: Block, w: Block, lower: np.ndarray, upper: np.ndarray) -> None:
        reach = (a.labels[owner] != w.labels[0]) & (lo <= hi) & (upper[owner] >= np.maximum(lo, best.least)) & (lower[owner] <= hi)
        seek = np.flatnonzero(reach)
        if not len(seek):
            return
        mine, back = np.unique(owner[seek], return_inverse=True)
        s = scores(a, mine, w, slice(None))
        same = _same(a, mine, w)
        for k in range(0, len(seek), 1024):
            part, of = seek[k : k + 1024], back[k : k + 1024]
            t = s[of]
            fits = (t <= hi[part][:, None]) & (t >= lo[part][:, None]) & (t >= best.least[part][:, None]) & ~same[of]
            i, j = _first(t, fits, NEGATIVES)
            best.add(part[i], t[i, j], w.ids[j], w.known[j])

    if len(every) and len(rows):
        _scan(anchors, rows, visit)
    seeker, score, ids, known = best.found
    return pa.table({
        "anchor": pa.array(anchors["anchor"].to_numpy()[owner[seeker]], pa.int64()), "place": pa.array(place[seeker], pa.int32()),
        "negative_id": pa.array(ids, pa.int64(), mask=~known), **_written(score),
    })


def _ranked(found: DataFrame, keys: list[str], id_col: str, k: int) -> DataFrame:
    """The first ``k`` of each key, with their rank. Every task that found some sends ``k`` at most."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("beyond").desc(), F.col(id_col).asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor, positive and rank.

    Anchors are rows whose id is divisible by 50. Rows with a null label or vector, or with a component that is null or not
    finite (or beyond ``LARGEST`` once multiplied by 256), take no part. Equal rows count once; rows with one id are never each other's positive or negative, and each is an
    anchor of its own. A null id is no anchor and comes last in ties. Shorter vectors count as filled with zeros. Scores beyond a long are
    ranked as they are and returned as the nearest long. Other columns are ignored; an empty table gives an empty result.
    """
    rows = _quantised(_runtime.in_batches(embeddings), id_col, vec_col, label_col)
    rows = _runtime.cut(_with_angles(rows, references(rows)))
    n = rows.count()
    n_chunks = max(1, -(-n // CHUNK), min(4 * rows.sparkSession.sparkContext.defaultParallelism, n // (4 * WINDOW)))
    near = [F.col("label"), F.col("near"), F.element_at("angles", F.col("near") + 1), F.xxhash64("vec_id")]
    # ranges of near equal size, whatever a label's or a vector's share: the hash ends every tie
    chunks = _runtime.cut(rows.repartitionByRange(n_chunks, *near).withColumn("chunk", F.spark_partition_id()))
    numbers = [r[0] for r in chunks.select("chunk").distinct().collect()]
    anchors = rows.where(F.col("vec_id") % EVERY == 0)
    n_blocks = max(1, -(-anchors.count() // ANCHORS))
    block = F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(n_blocks)).cast("int")
    anchors = _runtime.cut(anchors.withColumn("block", block).withColumn("anchor", F.monotonically_increasing_id()))
    anchors = anchors.toDF(*anchors.columns)
    every = lambda values: F.explode(F.array(*map(F.lit, values)) if values else F.array().cast("array<int>"))
    all_rows = chunks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def against(seekers: DataFrame, run, schema: str) -> DataFrame:
        return seekers.withColumn("chunk", every(numbers)).groupBy("block", "chunk").cogroup(all_rows.groupBy("block", "chunk")).applyInArrow(run, schema)

    found = against(anchors, _positives, f"anchor long, positive_id long, {_SCORE}")
    positives = _ranked(found, ["anchor"], "positive_id", POSITIVES).select("anchor", F.col("rank").alias("place"), "positive_id", "score", "beyond")
    positives = _runtime.cut(positives)
    lists = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "score", "beyond"))).alias("positives"))
    found = against(anchors.join(lists, "anchor"), _negatives, f"anchor long, place int, negative_id long, {_SCORE}")
    known = positives.select("anchor", "place", "positive_id", F.col("score").alias("positive_score")).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    out = _ranked(found, ["anchor", "place"], "negative_id", NEGATIVES).join(known, ["anchor", "place"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
