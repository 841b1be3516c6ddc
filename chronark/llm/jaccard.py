"""N-gram Jaccard join by a token-group matrix.

Similar documents are put into groups, the matrix has a row for each (token, group) pair, and a document's query opens a
group only if the tokens they share can reach the required overlap.

* Tokens are hashed 5-word shingles. All documents follow one order of tokens: rare ones first by hash, tokens that were
  found to be frequent last by count. If two sets reach similarity t, each has k of the common tokens among its first
  ``n - ceil(t n) + k`` ones. The matrix needs those columns only, and a document and a group that have fewer than k of them
  in common hold no similar pair; k is 1 plus a twentieth of the smaller set.
* A group's leader is the document with the largest share of frequent tokens in a common column (of a family of copies this
  is the one they were made from), and a group is stored in blocks of bounded token count.
* Each member is first compared with its leader. Only members that this leaves unlinked, and documents of other groups, query
  the group, if they have enough columns in common with it: against each block's token union first, then, if the bound holds,
  its members.

Every pair at or above the threshold is either compared or already connected, so components are exact; the join emits
neither pairs within a group nor pairs of equal sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronark.llm import _runtime, shingles

#: Tokens that get their own rank in the order, at most: 16 bytes each on every executor.
FREQUENT = 500_000
BLOCK_TOKENS = 100_000
#: Documents of a frequent token's column that one task compares to find the best leader, about.
SLICE = 50_000
#: A column of more groups than this is left out of a document's search if it can lack them all and still share enough.
WIDE = 64
#: The matrix has one column more for each so many tokens of a set than one match needs; similar sets then share as many more.
SPARE = 20


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document its set's size and key; for each token repeated in a slice of documents, its count there."""
    kept: list[np.ndarray] = []

    def repeated() -> pa.RecordBatch:
        token, count = np.unique(np.concatenate(kept or [np.empty(0, np.int64)]), return_counts=True)
        token, count = token[count > 1], count[count > 1]
        none = [None] * len(token)
        kept.clear()
        return pa.RecordBatch.from_arrays([pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.binary()), pa.array(token), pa.array(count)], ["doc_id", "n", "set_key", "token", "seen"])

    held = 0
    for batch in batches:
        sets = [shingles.shingle_set(t) for t in batch.column(1).to_pylist()]
        none = pa.nulls(len(sets), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([shingles.set_key(s) for s in sets], pa.binary()), none, none], ["doc_id", "n", "set_key", "token", "seen"])
        kept += sets
        held += sum(map(len, sets))
        if held > 2_000_000:
            yield repeated()
            held = 0
    yield repeated()


def _needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


class _Order:
    """The order of tokens: those not in ``tokens`` by hash, then those by rank."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        by_token = np.argsort(tokens)
        self.tokens = tokens[by_token]
        rank = np.empty(len(tokens), np.int64)
        rank[np.lexsort((tokens, counts))] = np.arange(len(tokens))
        self.rank = rank[by_token]
        self.slices = 1 + counts[by_token] // SLICE

    def first(self, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The first ``k`` tokens of ``s``, in how many slices their columns are dealt (0: no frequent token), and how many
        thousandths of ``s`` are frequent."""
        if not len(self.tokens) or not len(s):
            return s[:k], np.zeros(len(s[:k]), np.int64), 0
        at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        hot = self.tokens[at] == s
        count = int(hot.sum())
        first = s[~hot][:k]
        slices = np.zeros(len(first), np.int64)
        if len(first) < k:
            last = at[hot][np.argsort(self.rank[at[hot]])][: k - len(first)]
            first, slices = np.concatenate([first, self.tokens[last]]), np.concatenate([slices, self.slices[last]])
        return first, slices, 1000 * count // len(s)


def _columns(order, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _Order(*order.value)
        for batch in batches:
            ids, sizes, shares, firsts, dealt = [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingles.shingle_set(text)
                if len(s):
                    tokens, slices, share = by.first(s, len(s) - _needed(len(s), percent) + 1 + len(s) // SPARE)
                    ids.append(i), sizes.append(len(s)), shares.append(share), firsts.append(tokens)
                    # frequent tokens come last: what is dealt in slices is a list for the end of ``tokens``
                    dealt.append(slices[np.count_nonzero(slices == 0) :])
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(shares, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(dealt, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "share", "tokens", "dealt"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles.shingle_set(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "tokens"])


class _Block:
    """The members of one block of a group, with their token union."""

    def __init__(self) -> None:
        self.docs: list[int] = []
        self.sizes: list[int] = []
        self.parts: list[np.ndarray] = []
        self.root: dict[int, int] = {}
        self.ready = False

    def add(self, doc: int, comp: int, tokens: np.ndarray) -> None:
        self.docs.append(doc)
        self.sizes.append(len(tokens))
        self.parts.append(tokens)
        self.merge(doc, comp)

    def find(self, x: int) -> int:
        while (up := self.root.setdefault(x, x)) != x:
            self.root[x] = x = self.root[up]
        return x

    def merge(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)
        return a != b

    def links(self, doc: int, comp: int, tokens: np.ndarray, percent: int) -> list[int]:
        """Members that are similar to ``doc``, of those not known to be connected with it."""
        if not self.docs:
            return []
        if not self.ready:
            owner = np.repeat(np.arange(len(self.docs)), self.sizes)
            every = np.concatenate(self.parts)
            order = np.argsort(every, kind="stable")
            self.every, self.owner, self.n, self.ready = every[order], owner[order], np.array(self.sizes), True
        self.merge(doc, comp)
        lo, hi = np.searchsorted(self.every, tokens, "left"), np.searchsorted(self.every, tokens, "right")
        if int((hi > lo).sum()) < _needed(len(tokens), percent):  # the bound: no member can share enough
            return []
        width = hi - lo
        at = np.repeat(hi - np.cumsum(width), width) + np.arange(int(width.sum()))
        common = np.bincount(self.owner[at], minlength=len(self.docs))
        near = np.flatnonzero(100 * common >= percent * (self.n + len(tokens) - common))
        return [self.docs[k] for k in near if self.docs[k] != doc and self.merge(doc, self.docs[k])]


def _opened(percent: int):
    """Rows come sorted by block, its members before its queries; only one block is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, _Block()
        for batch in batches:
            a, b = [], []
            tokens = batch.column("tokens")
            flat, offsets = tokens.values.to_numpy(zero_copy_only=False), tokens.offsets.to_numpy()
            rows = zip(*(batch.column(c).to_pylist() for c in ("grp", "block", "query", "doc_id", "comp")), strict=True)
            for k, (group, part, query, doc, comp) in enumerate(rows):
                s = flat[offsets[k] : offsets[k + 1]]
                if now != (group, part):
                    now, block = (group, part), _Block()
                if not query:
                    block.add(doc, comp, s.copy())
                else:
                    found = block.links(doc, comp, s, percent)
                    a += [doc] * len(found)
                    b += found
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])

    return run


def _open(rows: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) found by opening the blocks of ``rows`` (grp, block, query, doc_id, comp, tokens)."""
    rows = rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "query", "doc_id")
    return rows.mapInArrow(_opened(percent), "u long, v long")


def links_and_sets(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sets, links): for each row its id, set size and set key; and links (u, v) between ids of different sets.

    The links connect all that the threshold connects; of pairs that are connected anyway, not each has a row.
    """
    spark: SparkSession = docs.sparkSession
    base = _runtime.in_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    profiles = _runtime.cut(base.mapInArrow(_profiles, "doc_id long, n long, set_key binary, token long, seen long"))
    sets = profiles.where("n IS NOT NULL").select("doc_id", "n", "set_key")
    frequent = profiles.where("token IS NOT NULL").groupBy("token").agg(F.sum("seen").alias("seen")).where("seen >= 4").orderBy(F.desc("seen"), "token").limit(FREQUENT).toPandas()
    order = spark.sparkContext.broadcast((frequent["token"].to_numpy(np.int64), frequent["seen"].to_numpy(np.int64)))

    # of equal sets, one stands for all
    known = sets.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    first = known.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    copies = known.select("doc_id").distinct().join(first.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_anti")
    columns = base.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(_columns(order, percent), "doc_id long, n long, share long, tokens array<long>, dealt array<long>")
    columns = _runtime.only(columns, copies, "left_anti").select("doc_id", F.col("n").cast("int").alias("n"), F.col("share").cast("int").alias("share"), F.size("tokens").alias("all"), "dealt", F.posexplode("tokens").alias("i", "token"))
    # a frequent token's column is dealt in slices, so that no task has all of it; it has partners enough not to look for them
    late = F.col("i") - (F.col("all") - F.size("dealt"))
    columns = columns.select("token", "doc_id", "n", "share", F.when(late >= 0, F.pmod(F.xxhash64("doc_id"), F.get("dealt", late)) + 1).otherwise(0).cast("int").alias("slice"))
    by_size = "OVER (PARTITION BY token, slice ORDER BY n, doc_id)"
    shared = columns.selectExpr("token", "doc_id", "n", "slice", f"lag(n) {by_size} AS smaller", f"lead(n) {by_size} AS larger", "max(struct(share, -doc_id AS neg)) OVER (PARTITION BY token, slice) AS best")
    shared = _runtime.cut(shared.where(f"slice > 0 OR 100 * smaller >= {percent} * n OR 100 * n >= {percent} * larger").select("token", "doc_id", "n", "slice", "best"))
    sliced = F.broadcast(shared.where("slice > 0").groupBy("token").agg(F.max("best").alias("best_of_all")))

    enough = F.expr(f"columns >= 1 + (({percent} * n + 99) div 100) div {SPARE}")
    pointers = shared.join(sliced, "token", "left").groupBy("doc_id").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("columns"), F.max(F.coalesce("best_of_all", "best")).alias("best")).where(enough)
    pointers = _runtime.cut(pointers.select("doc_id", "n", (-F.col("best.neg")).alias("grp")))
    # a leader may follow a better one: its group follows it once, so that a family has few groups
    onward = pointers.where("doc_id <> grp").select(F.col("doc_id").alias("grp"), F.col("grp").alias("next"))
    leaders = pointers.join(onward, "grp", "left").select("doc_id", "n", F.coalesce("next", "grp").alias("grp"))
    # a leader belongs to its own group
    led = leaders.select("grp").distinct().select(F.col("grp").alias("doc_id"), F.lit(True).alias("leads"))
    leaders = _runtime.cut(leaders.join(led, "doc_id", "left").select("doc_id", "n", F.when(F.col("leads"), F.col("doc_id")).otherwise(F.col("grp")).alias("grp")))
    wanted = leaders.select("doc_id").union(leaders.select("grp")).distinct()
    tokens = _runtime.cut(_runtime.only(base.where("text IS NOT NULL"), wanted, "left_semi").mapInArrow(_sets, "doc_id long, tokens array<long>"))

    parts = leaders.groupBy("grp").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).alias("blocks"))
    members = leaders.join(parts, "grp").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).select("doc_id", "n", "grp", "block", "blocks")

    row = ["grp", "block", "query", "doc_id", "comp", "tokens"]
    star = members.where("doc_id <> grp").select("grp", "block", F.lit(True).alias("query"), "doc_id", F.col("doc_id").alias("comp"))
    heads = members.where("doc_id <> grp").select("grp", "block").distinct().select("grp", "block", F.lit(False).alias("query"), F.col("grp").alias("doc_id"), F.col("grp").alias("comp"))
    near = _runtime.cut(_open(star.union(heads).join(tokens, "doc_id").select(row), percent).distinct())

    linked = near.select(F.col("u").alias("doc_id"), F.lit(True).alias("linked")).distinct()
    members = members.join(linked, "doc_id", "left").withColumn("comp", F.when(F.col("linked"), F.col("grp")).otherwise(F.col("doc_id"))).drop("linked")
    at = shared.join(members.select("doc_id", "grp", "comp"), "doc_id").select("token", "doc_id", "n", "grp", "comp")
    matrix = at.groupBy("token", "grp").agg(F.count(F.lit(1)).alias("docs"))
    wide = _runtime.cut(matrix.groupBy("token").agg(F.count(F.lit(1)).alias("groups")).where(F.col("groups") > WIDE)).select("token", F.lit(True).alias("wide"))
    at = _runtime.cut(_runtime.only(at, wide, "left", "token").withColumn("wide", F.coalesce("wide", F.lit(False))))
    # with fewer columns in common with a group than ``need``, no member can be similar. A document that could lack all its wide
    # columns and still share enough looks through its narrow ones only, and is given the wide ones
    need = F.expr(f"1 + (({percent} * n + 99) div 100) div {SPARE}")
    widths = at.groupBy("doc_id").agg(F.sum(F.col("wide").cast("int")).alias("given"), F.max("n").alias("n")).where(F.col("given") > 0)
    widths = widths.select("doc_id", F.when(F.col("given") < need, F.col("given")).otherwise(0).alias("given"))
    looking = _runtime.only(at, widths, "left", "doc_id").withColumn("given", F.coalesce("given", F.lit(0))).where("NOT wide OR given = 0")
    # its own group counts where another member has the column too, and for members not known to be linked with the leader
    pairs = looking.join(matrix.select("token", F.col("grp").alias("to"), "docs"), "token").where("grp > to OR grp = to AND docs > 1 AND comp <> grp")
    queries = pairs.groupBy("doc_id", "comp", "to").agg(F.max("n").alias("n"), F.max("given").alias("given"), F.count_distinct("token").alias("columns"))
    queries = queries.where(F.col("columns") + F.col("given") >= need).join(parts.select(F.col("grp").alias("to"), "blocks"), "to")
    queries = queries.select("doc_id", "comp", F.col("to").alias("grp"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
    queries = _runtime.cut(queries.select("grp", "block", F.lit(True).alias("query"), "doc_id", "comp"))
    asked = members.join(queries.select("grp", "block").distinct(), ["grp", "block"], "left_semi").select("grp", "block", F.lit(False).alias("query"), "doc_id", "comp")
    far = _open(queries.union(asked).join(tokens, "doc_id").select(row), percent)
    # an id with several texts connects their sets
    several = known.groupBy("doc_id").agg(F.min("set_key").alias("a"), F.max("set_key").alias("b")).where("a <> b").select("doc_id")
    own = known.join(several, "doc_id", "left_semi").join(first, "set_key").where("doc_id <> rep").select("doc_id", "rep")
    return sets, near.union(far).union(own)


def components(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate classes of all rows: (doc_id, n_shingles, component_id).

    Two documents link when 100 * |A & B| >= percent * |A | B| over their distinct 5-word shingles (A-Z lower-cased; a text of
    fewer words is one shingle). ``component_id`` is the smallest id reachable over links, itself included.

    Null and blank texts have no shingles and link with nothing. Rows with a null id get the class of equal sets that have an
    id, else null. Several rows with one id are one document: each of its texts can link it. Other columns are ignored, an
    empty table gives an empty result.
    """
    sets, links = links_and_sets(docs, percent, id_col, text_col)
    sets = sets.withColumnRenamed("n", "n_shingles")
    classes = sets.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most"))
    found = _runtime.connected_components(links).withColumnRenamed("node", "rep")
    classes = classes.join(found, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component")).hint("shuffle_hash")
    out = sets.join(classes, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest id. All columns stay as they are.

    Rows with a null id stay, as do texts without words. Of rows that repeat the kept id, all stay.
    """
    gone = components(docs, percent, id_col, text_col).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
