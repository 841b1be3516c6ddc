"""Filter interaction audit: what each of five filters removes, in every order of them, by decision diagrams.

Spark reduces the documents to counts by part and failure mask, 32 rows a part at most. Of these a part builds a decision diagram
whose levels are filters and whose nodes carry counts. A node stands for the documents that share what the filters above it say, so
the diagram of another order differs by swaps of neighbouring levels only, and each swap changes only the nodes of two levels. On
the path where every filter passes, the failing child of a level holds what its filter removes there, the passing one what stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _fails(text: Column, copy: Column) -> dict[str, Column]:
    words = F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
        "E": copy,
    }


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and the set of filters they fail, bit k for the k-th filter.

    Null texts are empty and so fail A only, and E beside another. A null id is larger than none, so such a row fails E never. Rows that repeat
    an id aren't copies of one another, and each counts. A document is good, or toxic, if any of its label rows says so.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    by_text = _fails(F.col("text"), F.lit(False))
    bits = sum((F.when(by_text[f], 1 << k).otherwise(0) for k, f in enumerate(FILTERS) if f != "E"), F.lit(0))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), bits.alias("bits"))
    # equal texts are combined before their shuffle; only those with different ids are looked up
    firsts = rows.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("sha", "first")
    known = labels.groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(firsts, "sha", "left").join(known, F.col("doc_id") == F.col("of"), "left")
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    return rows.groupBy("part", (F.col("bits") + copy).alias("mask")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


class Diagram:
    """A decision diagram over failure masks: node = (passing child, failing child), leaf = what its documents weigh.

    ``levels[d]`` holds the nodes of the d-th filter in ``order``, equal ones once. Weights are vectors: documents, good, toxic.
    """

    def __init__(self, n_filters: int, weights: dict[int, tuple[int, ...]]):
        self.order = list(range(n_filters))
        self.zero = (0,) * len(next(iter(weights.values())))
        self.leaves: list[tuple[int, ...]] = []
        self.levels: list[dict[tuple[int, int], int]] = [{} for _ in self.order]
        self.nodes: list[list[tuple[int, int]]] = [[] for _ in self.order]
        leaf: dict[tuple[int, ...], int] = {}

        def build(d: int, mask: int) -> int:
            if d == n_filters:
                w = weights.get(mask, self.zero)
                if w not in leaf:
                    leaf[w] = len(self.leaves)
                    self.leaves.append(w)
                return leaf[w]
            return self._node(d, build(d + 1, mask), build(d + 1, mask | 1 << d))

        self.root = build(0, 0)

    def _node(self, d: int, passing: int, failing: int) -> int:
        key = (passing, failing)
        if key not in self.levels[d]:
            self.levels[d][key] = len(self.nodes[d])
            self.nodes[d].append(key)
        return self.levels[d][key]

    def swap(self, d: int) -> None:
        """Exchanges the filters of levels d and d + 1: only these levels' nodes and the links of level d - 1 change."""
        upper, lower = self.nodes[d], self.nodes[d + 1]
        for level in (d, d + 1):
            self.levels[level], self.nodes[level] = {}, []
        moved = []
        for passing, failing in upper:
            (pp, pf), (fp, ff) = lower[passing], lower[failing]
            moved.append(self._node(d, self._node(d + 1, pp, fp), self._node(d + 1, pf, ff)))
        if d == 0:
            self.root = moved[self.root]
        else:
            above = [(moved[p], moved[f]) for p, f in self.nodes[d - 1]]
            self.levels[d - 1], self.nodes[d - 1] = {key: k for k, key in enumerate(above)}, above
        self.order[d], self.order[d + 1] = self.order[d + 1], self.order[d]

    def totals(self) -> list[list[np.ndarray]]:
        """By level, each node's weight: the sum of its children's, from the leaves up."""
        below = [np.array(w, dtype=object) for w in self.leaves]
        out = [below]
        for nodes in reversed(self.nodes):
            below = [below[p] + below[f] for p, f in nodes]
            out.append(below)
        return out[::-1]

    def steps(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(filter, weight it removes, weight that stays) along the all-pass path."""
        totals, at = self.totals(), self.root
        for d, f in enumerate(self.order):
            passing, failing = self.nodes[d][at]
            yield f, totals[d + 1][failing], totals[d + 1][passing]
            at = passing


def neighbouring_swaps(n: int) -> Iterator[int]:
    """Levels to swap with the next, one after another, so that every order of n comes up once (plain changes)."""
    if n < 2:
        return
    turns, up = list(neighbouring_swaps(n - 1)), False
    for k in range(len(turns) + 1):
        yield from range(n - 1) if up else range(n - 2, -1, -1)
        if k < len(turns):
            yield turns[k] + (not up)
        up = not up


def audit_counts(weights: dict[int, tuple[int, ...]], filters: str = FILTERS) -> list[dict]:
    """The rows of one part, for masks with their (documents, good, toxic)."""
    n = len(filters)
    failing = [sum(w[0] for mask, w in weights.items() if mask >> k & 1) for k in range(n)]
    alone = [weights.get(1 << k, (0,))[0] for k in range(n)]
    diagram, out, shapley = Diagram(n, weights), [], [0] * n
    for turn in (None, *neighbouring_swaps(n)):
        if turn is not None:
            diagram.swap(turn)
        name = "".join(filters[k] for k in diagram.order)
        for step, (k, gone, stays) in enumerate(diagram.steps(), 1):
            shapley[k] += gone[0]
            out.append({"filter_order": name, "step": step, "kept": stays[0], "removed": gone[0], "redundant": failing[k] - gone[0], "unique_fails": alone[k], "good_lost": gone[1], "toxic_lost": gone[2]})
    for row in out:
        row["shapley"] = shapley[filters.index(row["filter_order"][row["step"] - 1])]
    return out


def _part(rows: pa.Table) -> pa.Table:
    part = rows.column("part")[0].as_py()
    found = audit_counts({r["mask"]: (r["n"], r["good"], r["toxic"]) for r in rows.to_pylist()})
    kinds = [("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))]
    return pa.Table.from_pylist([{"part": part} | r for r in found], pa.schema(kinds))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """600 rows a part, one for each order of the filters and each step, zeros included; columns as in ``SCHEMA``.

    A null part is the empty string. Documents without labels are neither good nor toxic. An empty table has no part and gives no
    row. Other columns are ignored. See ``masks`` for null and repeated ids.
    """
    return masks(docs, labels, id_col, text_col, part_col).groupBy("part").applyInArrow(_part, SCHEMA)
