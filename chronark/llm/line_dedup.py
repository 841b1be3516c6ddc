"""Near-duplicate lines by a deletion-neighbourhood join: lines that are equal or within one edit, the earliest stays.

Equal lines count at any length. An edit is allowed in lines of ``PER_EDIT`` characters or more: in shorter ones it often makes
another word or number. Two lines differ by one edit if they become equal when one character is deleted at the same place of
both, or if one becomes the other. All such variants of a line are emitted as hashed keys, but only those that another line can
have too: the edit lies in one of ``WINDOWS`` parts of the line, and before and behind that part the lines are equal. So each
line first emits the hashes of what surrounds each part; only where two distinct lines agree on one, they emit the variants
within it.

A key's lines are never paired with each other: keys are aggregated, and what aggregates say is joined back. Equal substitution
keys mean a distance of one at most, so the earliest line of the key stands for all; in an insertion key, the line that is the
key itself is compared with the earliest of the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronark.llm import _runtime

WINDOWS = 4
#: A line may differ by one edit if it has so many characters, without spaces at its ends.
PER_EDIT = 20
_LAST = 2**63 - 1
#: Variants that go back from a task at once, about.
_MOST = 200_000
_PLACE = ("doc", "hash", "no")


def _hash(*parts: Column | str | int) -> Column:
    return F.xxhash64(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _around(line: Column, n: Column, base: Column, j: int) -> Column:
    """The hash of ``line`` without part ``j`` of ``base`` characters: a prefix and a suffix."""
    lo, hi = F.floor(base * j / WINDOWS), F.floor(base * (j + 1) / WINDOWS)
    return _hash(base, j, F.substr(line, F.lit(1), lo.cast("int")), F.substr(line, (n - (base - hi) + 1).cast("int")))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, doc, hash): a document is known by its id, the largest long for null, and the hash of its text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("hash"))


def _occurrences(docs: DataFrame) -> DataFrame:
    """(doc, hash, no, line, h) of all lines that aren't blank."""
    lines = docs.select("doc", "hash", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return lines.withColumn("line", F.trim("line")).where(F.length("line") > 0).withColumn("h", F.xxhash64("line"))


class _Powers:
    """Powers of an odd number modulo 2**64, as many as were asked for."""

    base = 0x9E3779B97F4A7C15
    inverse = np.uint64(pow(base, -1, 2**64))
    known = np.ones(1, np.uint64)

    @classmethod
    def first(cls, n: int) -> np.ndarray:
        while len(cls.known) < n:
            step = np.uint64(pow(cls.base, len(cls.known), 2**64))
            cls.known = np.concatenate([cls.known, cls.known * step])
        return cls.known[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def variant_keys(line: str, parts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, roles) of the variants of ``line`` in its ``parts`` (by how much it is longer than the base, number of the part).

    A line's hash is a sum over its characters, so a variant's follows from sums before and behind the deleted place, in constant time.
    """
    letters = _mixed(np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1))
    n = len(letters)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * _Powers.first(n), dtype=np.uint64)])
    deleted = lambda at: sums[at] + (sums[n] - sums[at + 1]) * _Powers.inverse
    longer = lambda total, size: _mixed(total + np.uint64(size))
    keys, roles = [], []
    for shift, j in parts:
        base = n - shift
        at = np.arange(base * j // WINDOWS, base * (j + 1) // WINDOWS + shift)
        if shift:
            keys.append(longer(deleted(at), n - 1))
        else:
            keys.append(_mixed(longer(deleted(at), n - 1) + at.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
        roles.append(np.full(len(at), shift))
    if any(not shift for shift, _ in parts):
        keys.append(longer(sums[n:], n))
        roles.append(np.full(1, 2))
    return np.concatenate(keys), np.concatenate(roles)


def within_one(a: str, b: str) -> bool:
    """Whether one edit at most makes ``a`` of ``b``: what follows the first difference is equal, but for the edited character."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) > len(b) + 1:
        return False
    x, y = (np.frombuffer(t.encode("utf-32-le"), "<u4") for t in (a, b))
    differs = x[: len(y)] != y
    at = int(differs.argmax()) if differs.any() else len(y)
    return a[at + 1 :] == b[at + (len(a) == len(b)) :]


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = [within_one(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(near, pa.bool_()))], ["h"])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, keys, roles, held = [], [], [], 0
        last = batch.num_rows - 1
        for k, (line, parts) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            key, role = variant_keys(line, sorted((p["shift"], p["j"]) for p in parts))
            rows.append(np.full(len(key), k))
            keys.append(key)
            roles.append(role)
            held += len(key)
            if held > _MOST or k == last:
                of = pa.array(np.concatenate(rows))
                made = [batch.column(0).take(of), batch.column(1).take(of), pa.array(np.concatenate(keys).view("int64")), pa.array(np.concatenate(roles).astype("int32"))]
                yield pa.RecordBatch.from_arrays(made, ["h", "first", "key", "role"])
                rows, keys, roles, held = [], [], [], 0


def _near(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(h): hashes of lines with an earlier line within one edit."""
    # the place in ``keys`` tells by how much the line is longer than the base, and the part
    around = firsts.select("h", F.posexplode("keys").alias("i", "key"))
    common = around.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key")
    shared = _runtime.only(around, common, "left_semi", "key")
    # these lines' texts, from where they occur first
    chosen = shared.groupBy("h").agg(F.collect_set(F.struct(F.expr(f"CAST(i div {WINDOWS} AS int)").alias("shift"), F.expr(f"i % {WINDOWS}").alias("j"))).alias("parts")).join(firsts.select("h", "first"), "h")
    chosen = _runtime.cut(chosen.select("h", "parts", "first", *(F.col(f"first.{c}").alias(c) for c in _PLACE)))
    here = _occurrences(_runtime.only(docs, chosen.select("doc").distinct(), "left_semi", "doc"))
    texts = _runtime.cut(chosen.join(here.select(*_PLACE, "line", F.col("h").alias("same")), list(_PLACE)).where("h = same").dropDuplicates(["h"]).select("h", "first", "line", "parts"))

    # role 0: a character is replaced; 1: longer by one; 2: the shorter line itself
    every = _runtime.in_batches(texts).select("h", "first", "line", "parts").mapInArrow(_variants, "h long, first struct<doc: long, hash: long, no: int>, key long, role int")
    me = F.struct("first", "h")
    heads = every.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), *(F.min(F.when(F.col("role") == k, me)).alias(f"role{k}") for k in range(3))).where("lo <> hi").drop("lo", "hi")
    found = _runtime.only(every, heads, "inner", "key").withColumn("near", F.expr("CASE role WHEN 0 THEN role0 WHEN 1 THEN role2 ELSE role1 END"))
    found = found.where("near.first < first").select("h", F.col("near.h").alias("other")).distinct()
    pairs = found.join(texts.select("h", "line"), "h").join(texts.select(F.col("h").alias("other"), F.col("line").alias("earlier")), "other")
    return _runtime.in_batches(pairs).select("h", "line", "earlier").mapInArrow(_close, "h long").distinct()


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 1) -> DataFrame:
    """(doc, hash, no, h): the lines that go. ``doc`` is the id, the largest long for null, ``hash`` that of the text; ``no``
    counts the lines of a text from 0."""
    if edits not in (0, 1):
        raise ValueError("edits: 0 or 1")
    docs = _keyed(docs, id_col, text_col)
    lines = _occurrences(docs)
    n = F.length("line")
    keys = F.when(n >= PER_EDIT, F.array(*(_around(F.col("line"), n, n - shift, j) for shift in (0, 1) for j in range(WINDOWS))))
    firsts = lines.select("h", *_PLACE, keys.alias("keys")).groupBy("h").agg(F.min(F.struct(*_PLACE)).alias("first"), F.max(F.struct(*_PLACE)).alias("last"), F.any_value("keys").alias("keys"))
    firsts = _runtime.cut(firsts)
    near = _runtime.cut(_near(docs, firsts.where("keys IS NOT NULL"))) if edits else firsts.select("h").limit(0)
    near = near.withColumn("near", F.lit(True))
    # only lines that go somewhere are looked up: those that are near an earlier one, and those that occur again
    known = firsts.select("h", "first", "last").join(near, "h", "left").where("near OR last <> first").select("h", "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = _runtime.only(lines.select(*_PLACE, "h"), known, "inner", "h")
    return gone.where("near OR first <> struct(doc, hash, no)").select(*_PLACE, "h")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 1) -> DataFrame:
    """(doc_id, text, n_lines, n_removed): each whole text without the lines that an earlier line equals or is ``edits`` (0 or 1) edits away from.

    Earlier: by document id (null last), then by a hash of the text, then by place in the text. Lines are compared without
    spaces at their ends; blank ones always stay, and those of fewer than 20 characters go only for an equal one. A line goes
    whether or not the earlier one stays itself. A null text stays null with 0 lines, an empty one is one empty line. Rows that
    repeat an id and its text are one document, rows with an id and another text, or with no id and another text, are others.
    Other columns are ignored; an empty table gives an empty result.
    """
    gone = removed_lines(docs, id_col, text_col, edits).groupBy(F.col("doc").alias("gone_doc"), F.col("hash").alias("gone_hash")).agg(F.collect_set("no").alias("gone"))
    rows = _keyed(docs, id_col, text_col)
    rows = rows.join(gone, (F.col("doc") == F.col("gone_doc")) & (F.col("hash") == F.col("gone_hash")), "left")
    rows = rows.withColumn("lines", F.split("text", "\n"))
    lines = F.col("lines")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    kept = F.when(F.col("gone").isNull(), lines).otherwise(F.transform(stay, lambda k: F.get(lines, k)))
    out = rows.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"), F.coalesce(F.size(lines), F.lit(0)).alias("n"), F.coalesce(F.size(kept), F.lit(0)).alias("k"), F.col("text").isNull().alias("none"))
    count = lambda c: F.when(F.col("none"), 0).otherwise(F.greatest(c, F.lit(0))).cast("long")
    return out.select("doc_id", "text", count(F.col("n")).alias("n_lines"), count(F.col("n") - F.col("k")).alias("n_removed"))
