"""Secret scans: fixed formats, and character Markov models of random strings and ordinary identifiers.

The labelled samples are in the corpus itself: what the fixed formats match are random strings, all other runs of identifier
characters are ordinary ones (the few secrets among them weigh little against the rest). Both models hold the transition counts
of all documents. Each run is judged by its best segment: the one with the largest sum of log-likelihood ratios, so that a key
within a path or a name=value pair is found. The threshold for the sum is calibrated on the best segments of all labelled runs;
it alone decides how short a random string can be found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronark.llm import _runtime

#: Fixed formats: kind, pattern, group and its least length.
FORMATS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),
)
_ASSIGNED = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = (*(f[0] for f in FORMATS), "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SIZE = len(ALPHABET) + 1  # 0: any other character, also before the first and after the last of a run
_CODE = np.zeros(256, np.int32)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, _SIZE)
_SIGN = np.array([c in "/_=-" for c in f" {ALPHABET}"])
#: Shares of the labelled runs that set the threshold; up to a hundredth of random strings among the ordinary ones shift it little.
ORDINARY_BELOW, RANDOM_ABOVE = 0.99, 0.02
#: Bits by which the threshold is above the ordinary runs, at least; twice as many where the random ones leave room.
BITS = 8.0
_BINS = np.linspace(0, 256, 1025)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed formats, leftmost non-overlapping per kind, in code points."""
    low, found = text.lower(), []
    may = (any(k in low for k in _ASSIGNED), "AKIA" in text, True)
    for k, (_, pattern, group, least) in enumerate(FORMATS):
        if may[k]:
            found += [(m.start(), k, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found)


class _Text:
    """Character codes of one text with a 0 at each end, its runs, which of them the fixed formats cover, and the base spans.

    Position p of the text is place p + 1 of ``code``; run i has the places from ``start[i]`` to before ``end[i]``.
    """

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.code = np.zeros(len(points) + 2, np.int32)
        self.code[1:-1] = _CODE[np.where(points < 256, points, 0)]
        edge = np.flatnonzero(np.diff(self.code > 0))
        self.start, self.end = edge[::2] + 1, edge[1::2] + 1
        self.spans = base_spans(text)
        cover = np.zeros(len(self.code) + 1, np.int32)
        for start, kind, end in self.spans:
            if kind == 0:  # without the name before the value
                start = FORMATS[0][1].match(text, start).start(2)
            cover[start + 1] += 1
            cover[end + 1] -= 1
        covered = np.concatenate(([0], np.cumsum(np.cumsum(cover) > 0)))
        self.random = covered[self.end] > covered[self.start]

    def pairs(self) -> np.ndarray:
        """The transition into each place after the first."""
        return self.code[:-1] * _SIZE + self.code[1:]

    def best(self, ratio: np.ndarray) -> np.ndarray:
        """For each run the largest sum of ratios over a segment of it."""
        if not len(self.start):
            return np.zeros(0)
        into = np.concatenate(([0.0], ratio[self.pairs()]))
        total = np.cumsum(into)
        # the least sum before each place within its run: every run is lowered below all before it, so that minima don't cross
        inside = np.repeat(np.arange(len(self.start)), self.end - self.start)
        place = np.flatnonzero(self.code)
        upto = total[place] - np.repeat(total[self.start - 1], self.end - self.start)
        before = upto - into[place]
        fall = before.max() - before.min() + 1.0
        low = np.minimum.accumulate(before - inside * fall) + inside * fall
        return np.maximum.reduceat(upto - low, np.flatnonzero(np.diff(inside, prepend=-1)))

    def segments(self, i: int, ratio: np.ndarray, least: float) -> list[tuple[int, int, float]]:
        """(start, end, sum) of run i's segments above ``least``, in the text: the best one, then those left and right of it."""
        into = ratio[self.code[self.start[i] - 1 : self.end[i] - 1] * _SIZE + self.code[self.start[i] : self.end[i]]]
        found, open_ = [], [(0, len(into))]
        while open_:
            lo, hi = open_.pop()
            if lo >= hi:
                continue
            total = np.concatenate(([0.0], np.cumsum(into[lo:hi])))
            rise = total[1:] - np.minimum.accumulate(total[:-1])
            last = int(rise.argmax())
            if rise[last] <= least:
                continue
            first = int(total[: last + 1].argmin())
            # up to the next sign on either side: what a key ends in may look ordinary
            signs = np.flatnonzero(_SIGN[self.code[self.start[i] + lo : self.start[i] + hi]])
            at = np.searchsorted(signs, (first, last + 1))
            first = int(signs[at[0] - 1]) + 1 if at[0] else 0
            last = int(signs[at[1]]) - 1 if at[1] < len(signs) else hi - lo - 1
            found.append((int(self.start[i]) - 1 + lo + first, int(self.start[i]) + lo + last, float(rise.max())))
            open_ += [(lo, lo + first), (lo + last + 1, hi)]
        return found


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = np.zeros((2, _SIZE * _SIZE), np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                t = _Text(text)
                label = np.zeros(len(t.code), bool)
                label[np.flatnonzero(t.code)] = np.repeat(t.random, t.end - t.start)
                pair = t.pairs()
                for k in (0, 1):
                    count[k] += np.bincount(pair[label[1:] == bool(k)], minlength=_SIZE * _SIZE)
    label, pair = np.nonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(pair), pa.array(count[label, pair])], ["label", "pair", "n"])


def ratios(count: np.ndarray) -> np.ndarray:
    """log2 of P(next | last, random) / P(next | last, ordinary) for each pair; the random model is mixed with a uniform one."""
    count = count.reshape(2, _SIZE, _SIZE).astype(float)
    count[:, :, 0] = 0  # the ends of runs say nothing
    single = count.sum(1) + 1
    p = [(c + 20 * (s / s.sum())) / (c.sum(1, keepdims=True) + 20) for c, s in zip(count, single, strict=True)]
    random = 0.5 * p[1] + 0.5 / (_SIZE - 1)
    out = np.log2(random / p[0])
    out[:, 0] = 0
    return out.reshape(-1)


def _histograms(ratio):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, len(_BINS) + 1), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    t = _Text(text)
                    bins = np.digitize(t.best(ratio), _BINS)
                    for k, of in enumerate((~t.random, t.random)):
                        count[k] += np.bincount(bins[of], minlength=len(_BINS) + 1)
        label, bin_ = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(bin_), pa.array(count[label, bin_])], ["label", "bin", "n"])

    return run


def threshold(count: np.ndarray) -> float:
    """``BITS`` above the top of the ordinary runs, or up to twice that if it stays below the bottom of the random ones."""
    share = np.cumsum(count, 1) / np.maximum(count.sum(1, keepdims=True), 1)
    edges = np.append(_BINS, _BINS[-1])
    ordinary = edges[np.argmax(share[0] >= ORDINARY_BELOW)] if count[0].any() else 0.0
    random = edges[max(0, np.argmax(share[1] > RANDOM_ABOVE) - 1)] if count[1].any() else 0.0
    return float(max(ordinary + BITS, min(ordinary + 2 * BITS, random)))


def _scan(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, least = model
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                found = []
                if text:
                    t = _Text(text)
                    found = [(s, k, e, None) for s, k, e in t.spans]
                    for i in np.flatnonzero((t.best(ratio) > least) & ~t.random):
                        found += [(s, len(FORMATS), e, x) for s, e, x in t.segments(i, ratio, least)]
                out.append([{"kind": KINDS[k], "start": s, "end": e, "score": x} for s, k, e, x in sorted(found, key=lambda f: f[:2])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    return run


def train(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, float]:
    """(log ratios, threshold) from the runs of all documents; what is collected are two tables of fixed size."""
    texts = _runtime.in_batches(docs).select(F.col(text_col).cast("string").alias("text"))

    def summed(rows: DataFrame, key: str, width: int) -> np.ndarray:
        table = np.zeros((2, width), np.int64)
        for label, k, n in rows.groupBy("label", key).agg(F.sum("n")).collect():
            table[label, k] = n
        return table

    ratio = ratios(summed(texts.mapInArrow(_transitions, "label long, pair long, n long"), "pair", _SIZE * _SIZE))
    return ratio, threshold(summed(texts.mapInArrow(_histograms(ratio), "label long, bin long, n long"), "bin", len(_BINS) + 1))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: tuple[np.ndarray, float] | None = None) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, score>>) for each row, spans in code points, by start and kind.

    Kinds: assign, access, hex by fixed formats; markov for segments of runs of identifier characters that no fixed format
    touches and that the models take for random; their score is the sum of log ratios in bits. Null counts as empty and has no spans; null and repeated ids
    each give their row; other columns are ignored; an empty table gives an empty result.
    """
    model = model or train(docs, text_col)
    rows = _runtime.in_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan(model), "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")
