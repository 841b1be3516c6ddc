"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared as lower-cased words with one space between. An item of n characters may differ by
``rate * n`` edits: cut into one piece more than that, one piece at least is found unchanged. An Aho-Corasick automaton finds
the pieces, and Myers' bit-parallel distance verifies the item around each hit. Items of fewer than 1 / rate characters have no
edits: they are found where their words stand as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronark.llm import _runtime

RATE = 0.08
#: Characters of items that one automaton holds; more are searched in blocks of that size.
BLOCK_CHARS = 4_000_000
_WORDS = re.compile(r"\w+")


def normalised(text: str | None) -> str:
    return " ".join(_WORDS.findall((text or "").lower()))


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): ``edits`` + 1 pieces of near equal length."""
    cut = [len(item) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(mask: dict[str, int], n: int, text: str) -> tuple[int, int]:
    """(least edit distance of the item to any part of ``text``, end of that part), a column of the table per big-integer step."""
    full, high = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best, at = n, 0
    for i, c in enumerate(text, 1):
        eq = mask.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(xh | plus) & full)
        down = plus & xh
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (~(xv | up) & full)
        minus = up & xv
        if score < best:
            best, at = score, i
    return best, at


class Items:
    """Test items ready for the search of their pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items = []
        self.automaton = ahocorasick.Automaton()
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normalised(text)
            if not text:
                continue
            edits = int(len(text) * rate)
            for offset, piece in pieces(text, edits):
                by_piece.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, text, edits, masks(text)))
        for piece, of in by_piece.items():
            self.automaton.add_word(piece, (len(piece), of))
        if by_piece:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, distance) of verified items in the normalised text; one for each item, its nearest."""
        text = normalised(text)
        if not self.items or not text:
            return []
        best: dict[int, tuple[int, int, int]] = {}
        tried: dict[int, list[int]] = {}
        for end, (length, of) in self.automaton.iter(text):
            for k, offset in of:
                _, item, edits, mask = self.items[k]
                start = end + 1 - length - offset
                if not edits:
                    whole = (start == 0 or text[start - 1] == " ") and (end + 1 == len(text) or text[end + 1] == " ")
                    if whole:
                        best.setdefault(k, (0, start, end + 1))
                    continue
                if best.get(k, (edits + 1,))[0] == 0:
                    continue
                # hits along one diagonal band are one window: a window covers starts from -edits to +edits
                if any(abs(start - s) <= edits // 2 for s in tried.get(k, [])[-8:]):
                    continue
                tried.setdefault(k, []).append(start)
                lo = max(0, start - 2 * edits)
                distance, at = myers(mask, len(item), text[lo : start + len(item) + 2 * edits])
                if distance <= edits and distance < best.get(k, (edits + 1,))[0]:
                    best[k] = (distance, max(0, lo + at - len(item)), lo + at)
        return sorted((self.items[k][0], lo, hi, d) for k, (d, lo, hi) in best.items())


KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("distance", pa.int64())]))


def _hits(ready: Items, text: str | None) -> list[dict]:
    return [dict(zip(("item_id", "start", "end", "distance"), h, strict=True)) for h in ready.find(text)]


def _search(items, rate: float, some: bool):
    """The hits of each text; ``some``: only texts with any, with the id and the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Items(items.value, rate)
        for batch in batches:
            hits = [_hits(ready, t) for t in batch.column(1).to_pylist()]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, KIND), *batch.columns[2:]], ["doc_id", "hits", *batch.schema.names[2:]])
            yield out.filter(pa.array([bool(h) for h in hits], pa.bool_())) if some else out

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The test items, in blocks of about ``BLOCK_CHARS`` characters dealt by hash: what is collected at once is bounded."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // BLOCK_CHARS))
    for k in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).distinct().orderBy("item_id", "text").collect()]


HITS = "array<struct<item_id:long,start:long,end:long,distance:long>>"


def _block_by_block(rows: DataFrame, blocks: Iterator[list[tuple[int, str]]], rate: float) -> DataFrame:
    """(doc_id, text_hash, hits) of the texts with hits. One block is held at a time: its hits are written before the next is sent."""
    found = []
    for items in blocks:
        sent = rows.sparkSession.sparkContext.broadcast(items)
        found.append(_runtime.cut(rows.mapInArrow(_search(sent, rate, True), f"doc_id long, hits {HITS}, text_hash long").dropDuplicates(["doc_id", "text_hash"])))
        sent.unpersist()
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every.groupBy("doc_id", "text_hash").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))


def find_items(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, contaminated, n_items, hits) for each row: the test items its whole text holds within ``rate`` edits a character.

    ``hits`` has one entry for each item, at its nearest place in the normalised text. Items with a null id or text, or without
    a word, are not searched. Null and empty texts have no hits; null and repeated ids each give their row; other columns are
    ignored; empty tables give an empty result or no hits.
    """
    rows = _runtime.in_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = _blocks(benchmark, item_col, item_text_col)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        found = rows.mapInArrow(_search(docs.sparkSession.sparkContext.broadcast(first), rate, False), f"doc_id long, hits {HITS}")
    else:
        rows = rows.withColumn("text_hash", F.xxhash64("text"))
        some = _block_by_block(rows, chain((first, second), blocks), rate).select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash"), "hits")
        found = rows.join(some, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash")), "left")
        found = found.select("doc_id", F.coalesce("hits", F.array().cast(HITS)).alias("hits"))
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"), "hits")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a test item; all columns and all other rows stay as they are.

    Null and empty texts stay, null ids and repeated rows are judged each by its text; empty tables drop nothing. Each block of
    items is searched in what the ones before left.
    """
    for items in _blocks(benchmark, "item_id", "text"):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ready = Items(sent.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([not ready.find(t) for t in batch.column(text_col).to_pylist()], pa.bool_()))

        docs = _runtime.in_batches(docs).mapInArrow(keep, docs.schema)
    return docs
