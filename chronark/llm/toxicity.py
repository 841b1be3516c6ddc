"""Toxicity by compression distance: two zstandard dictionaries, one trained on toxic and one on ordinary text.

Each window of a text is compressed with the ordinary dictionary and with both; what the toxic dictionary saves shows how much
of the window is like toxic text. Both end in the same ordinary part, so that ordinary text costs the same in both. Every byte
is spelled in three, as else the letters of a short word cost hardly more than the reference to it.

The label is one of a whole text, of which most is ordinary even if it is toxic. The toxic dictionary is therefore trained on
windows of one word, and of a toxic text's words on those that toxic texts hold more often than chance would give any word.
Two thresholds are calibrated on the labelled rows: what a window must save (of ordinary windows one in a hundred does), and,
by length of the text, how likely label 1 is at each sum of what its windows save beyond that.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronark.llm import _runtime, shingles

#: Labelled rows the classifier is fitted on, at most, of each label; those with the smallest hash of the id.
FIT_TOXIC, FIT_ORDINARY = 6_000, 18_000
#: Windows of these rows' whole texts that the ordinary dictionary is trained on, at most; those with the smallest hash.
FIT_WINDOWS = 20_000
#: Words of toxic texts that the toxic dictionary is trained on, at most: the surest ones.
FIT_WORDS = 2_000
WINDOW = 160
#: Spelled bytes of a dictionary, and the trainer's segment lengths; of those for toxic text, the one that fits the labels best.
ORDINARY_BYTES, TOXIC_BYTES = 36_000, 9_000
ORDINARY_SEGMENT, TOXIC_SEGMENTS = 120, (24, 32, 40, 48)
PREFIX = 5
#: Of ordinary windows, about this share saves no more than the window's threshold.
ORDINARY_BELOW = 0.99
THRESHOLD = 0.3
_WORD = re.compile(r"\w+")
_MOST, _CLASSES = 60, 8


#: Stands before both dictionaries, so that they have one length: zstandard finds little in a dictionary of a few kilobytes.
_FILL = np.random.default_rng(8).bytes(ORDINARY_BYTES + TOXIC_BYTES)
_SPELLED = np.random.default_rng(7).integers(0, 256, (256, 3), dtype=np.uint8)


def spelled(raw: bytes) -> bytes:
    return _SPELLED[np.frombuffer(raw, np.uint8)].tobytes()


def _parameters() -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters(compression_level=3, strategy=zstandard.STRATEGY_LAZY, min_match=7, search_log=4, hash_log=16, chain_log=16, window_log=17, write_content_size=0, write_checksum=0, write_dict_id=0)


def _class(windows: int) -> int:
    """The class of length: one for each factor of four."""
    return min(max(windows, 1).bit_length() - 1, 2 * _CLASSES - 1) // 2


@dataclass
class Model:
    """Two dictionaries, the window's threshold, and the probability of label 1 by class of length and excess."""

    toxic: bytes
    ordinary: bytes
    least: int = 0
    chance: np.ndarray = field(default_factory=lambda: np.zeros((_CLASSES, _MOST + 1)))

    def compressors(self) -> tuple:
        out = []
        for content in (self.ordinary, self.toxic + self.ordinary):
            made = zstandard.ZstdCompressionDict((_FILL + content)[-len(_FILL) :], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(compression_params=_parameters())
            out.append(zstandard.ZstdCompressor(dict_data=made, compression_params=_parameters()))
        return tuple(out)

    def excess(self, saved: np.ndarray) -> int:
        """The sum of what windows save beyond the threshold."""
        return int(min(np.clip(np.minimum(saved, _MOST) - self.least, 0, None).sum(), _MOST))

    def score(self, saved: np.ndarray) -> float:
        """Probability of label 1."""
        return float(self.chance[_class(len(saved)), self.excess(saved)])


def windows(raw: bytes) -> list[bytes]:
    """The whole text in windows that end at a space or line break, so that no word is cut."""
    out, at = [], 0
    while at < len(raw):
        end = at + WINDOW
        if end < len(raw):
            space = max(raw.rfind(b" ", at, end), raw.rfind(b"\n", at, end))
            end = space + 1 if space > at else end
        out.append(b" " + raw[at:end])
        at = end
    return out


def _bytes(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def savings(text: str | None, compressors: tuple) -> np.ndarray:
    """How many bytes the toxic dictionary saves in each window."""
    ordinary, toxic = compressors
    parts = [spelled(w) for w in windows(_bytes(text))]
    return np.array([len(ordinary.compress(p)) - len(toxic.compress(p)) for p in parts], np.int64)


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and ordinary texts of the task hold each word and each beginning of words, and how often toxic ones do."""
    seen, times = (Counter(), Counter()), Counter()
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            every = _WORD.findall((text or "").lower())
            words = set(every)
            seen[toxic].update(words | {w[:PREFIX] for w in words})
            if toxic:
                times.update(every)
    words = list(seen[0].keys() | seen[1].keys())
    counts = [pa.array([of[w] for w in words], pa.int64()) for of in (*seen, times)]
    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *counts], ["word", "ordinary", "toxic", "times"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest shingle hash of each text: mostly the same for near copies."""
    for batch in batches:
        sets = [shingles.shingle_set(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([int(s[0]) if len(s) else 0 for s in sets], pa.int64())], ["doc_id", "text", "toxic", "least"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([w for t in batch.column(0).to_pylist() for w in windows(_bytes(t))], pa.binary())], ["part"])


def _measured(models: list[Model]):
    """(toxic, class, saved): label, class of length, and for each model how many of the text's windows save -1 or less, 0, 1 and so on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [m.compressors() for m in models]
        counted = lambda text, both: np.bincount(np.clip(savings(text, both), -1, _MOST) + 1, minlength=_MOST + 2)
        for batch in batches:
            rows = [[counted(t, both).tolist() for both in pairs] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([_class(sum(r[0])) for r in rows], pa.int32()), pa.array(rows, pa.list_(pa.list_(pa.int64())))], ["toxic", "class", "saved"])

    return run


def _trained(size: int, segment: int, samples: list[bytes]) -> bytes:
    """A zstandard dictionary of the spelled samples; the samples themselves where they are too few to train one."""
    samples = [spelled(x) for x in samples]
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[-size:]


def _rising(share: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nearest sequence that never falls: neighbours in the wrong order are pooled."""
    blocks: list[list[float]] = []
    for s, w in zip(share.tolist(), weight.tolist(), strict=True):
        blocks.append([s, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            s2, w2, n2 = blocks.pop()
            s1, w1, n1 = blocks.pop()
            blocks.append([(s1 * w1 + s2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def calibrate(model: Model, toxic: np.ndarray, classes: np.ndarray, saved: np.ndarray) -> float:
    """Sets the window's threshold and the probabilities, and tells the log-likelihood of the labels. Classes with fewer than 30 rows take those of all rows.

    ``saved`` has a row for each text: how many of its windows save -1 bytes or less, 0, 1 and so on."""
    ordinary = saved[toxic == 0].sum(0)
    model.least = max(0, int(np.argmax(np.cumsum(ordinary) >= ORDINARY_BELOW * ordinary.sum())) - 1)
    excess = np.minimum(saved @ np.clip(np.arange(-1, _MOST + 1) - model.least, 0, None), _MOST)
    base = toxic.mean()
    for c in range(_CLASSES):
        of = classes == c
        of = of if of.sum() >= 30 else np.ones(len(toxic), bool)
        n, k = (np.bincount(excess[of], w, _MOST + 1) for w in (np.ones(of.sum()), toxic[of].astype(float)))
        model.chance[c] = _rising((k + base) / (n + 1), np.maximum(n, 1e-6))
    p = np.clip(model.chance[classes, excess], 1e-3, 1 - 1e-3)
    return float(np.log(np.where(toxic == 1, p, 1 - p)).sum())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Dictionaries and thresholds from a bounded sample of labelled rows (``FIT_TOXIC`` and ``FIT_ORDINARY`` of them at most).

    All choices are made in an order by hash, so that reruns learn the same. An id with several labels counts as toxic. Of
    sampled texts with the same smallest shingle, as near copies have, one is used: else copies would pass for evidence.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = (F.xxhash64("doc_id"), F.col("doc_id"))
    fit = known.where("toxic = 1").orderBy(*by_hash).limit(FIT_TOXIC).union(known.where("toxic = 0").orderBy(*by_hash).limit(FIT_ORDINARY))
    rows = _runtime.in_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(_runtime.cut(fit)), "doc_id").select("doc_id", "text", "toxic")
    rows = rows.mapInArrow(_keyed, "doc_id long, text string, toxic int, least long").groupBy("toxic", "least").agg(F.min(F.struct("doc_id", "text")).alias("of"))
    rows = _runtime.cut(rows.select(F.col("of.text").alias("text"), "toxic"))
    size = dict(rows.groupBy("toxic").count().collect())
    if not size.get(0) or not size.get(1):
        return Model(b"", b"")
    share = size[1] / (size[0] + size[1])
    held = F.col("toxic") + F.col("ordinary")
    # log-likelihood ratio against chance; more than chance gives the likeliest of all words
    part = lambda n, p: F.when(n > 0, n * F.log(n / (held * p))).otherwise(0.0)
    odds = (F.col("toxic") + 0.5) / (F.col("ordinary") + 0.5) * ((1 - share) / share)
    words = rows.mapInArrow(_phrases, "word string, ordinary long, toxic long, times long").groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"), F.sum("times").alias("times"))
    words = _runtime.cut(words.withColumn("evidence", part(F.col("toxic"), share) + part(F.col("ordinary"), 1 - share)).withColumn("more", odds > 3).where("toxic > 0"))
    sure = words.where(F.col("more") & (F.col("evidence") > float(np.log(max(1, words.where("more").count())) + 1)))
    sure = F.broadcast(_runtime.cut(sure.orderBy(F.desc("evidence"), "word").limit(FIT_WORDS).select(F.col("word").alias("sign"))))
    used = words.where("times > 0").select("word", "times", F.explode(F.array_distinct(F.array("word", F.substring("word", 1, PREFIX)))).alias("sign")).join(sure, "sign").select("word", "times").distinct()
    used = used.orderBy(F.desc("times"), "word").limit(10 * FIT_WORDS).toPandas()
    # in turns, as the trainer takes segments from all over its samples
    turns = sorted((k, w) for w, n in zip(used["word"], used["times"], strict=True) for k in range(min(int(n), 1000)))
    toxic = [f" {w}".encode("utf-8", "surrogatepass") for _, w in turns]
    parts = rows.where("toxic = 0").select("text").mapInArrow(_windows, "part binary")
    ordinary = parts.orderBy(F.xxhash64("part"), "part").limit(FIT_WINDOWS).toPandas()["part"]
    of_ordinary = _trained(ORDINARY_BYTES, ORDINARY_SEGMENT, list(map(bytes, ordinary)))
    models = [Model(_trained(TOXIC_BYTES, segment, toxic), of_ordinary) for segment in TOXIC_SEGMENTS]
    measured = rows.mapInArrow(_measured(models), "toxic int, class int, saved array<array<long>>").toPandas()
    label, classes, saved = measured["toxic"].to_numpy(), measured["class"].to_numpy(), np.array([[list(m) for m in r] for r in measured["saved"]])
    fits = [calibrate(m, label, classes, saved[:, k]) for k, m in enumerate(models)]
    return models[int(np.argmax(fits))]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, saved) for each row, from its whole text: the probability of label 1 and the most bytes saved in a window.

    Null counts as empty; both get the score of a text without windows. With no labelled rows of either kind all scores are 0.
    Null and repeated ids each give their row; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = model.compressors()
        for batch in batches:
            rows = [savings(t, both) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(s) for s in rows], pa.float64()), pa.array([float(s.max()) if len(s) else 0.0 for s in rows], pa.float64())], ["doc_id", "score", "saved"])

    rows = _runtime.in_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, saved double")
