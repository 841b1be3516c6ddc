"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, three times over. A document's virtual finish time is the number
of source tokens up to and including it, divided by the source's weight. The mix is what finishes first, up to the budget:
as a source runs dry, the others go on in proportion to their weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronark.llm import _runtime

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Rows of one source that are put in order by one task, about; a source has 2 to the power of ``BITS`` such runs at most.
RUN, BITS = 4_000, 20
#: Copies that are put in order to find where the budget ends, at most, unless more finish at one time.
ORDERED, RANGES = 50_000, 4_096


def sources(rows: DataFrame, weights: tuple[float, ...], repeats: int) -> DataFrame:
    """(source, weight, source_size, source_rows, target): weights repeat over the sources by code point, null last.

    The target is what the source holds at the virtual time at which all have reached the budget (the size of all rows):
    the smaller of ``repeats`` times its size and its weight times that time.
    """
    every = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    place = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    every = every.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (place % len(weights) + 1).cast("int")))
    full = F.lit(repeats) * F.col("source_size")
    every = every.withColumn("dry_at", full / F.col("weight"))
    by_dry = W.orderBy("dry_at", F.asc_nulls_last("source"))
    total = F.sum("source_size").over(W.partitionBy())
    before = F.coalesce(F.sum(full).over(by_dry.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_dry.rowsBetween(W.currentRow, W.unboundedFollowing))
    every = every.withColumn("until", (total - before) / left)
    # all that run dry before the first one that doesn't are full
    first = F.min_by("until", F.when(F.col("until") <= F.col("dry_at"), F.col("turn"))).over(W.partitionBy())
    every = every.withColumn("turn", F.row_number().over(by_dry))
    end = F.coalesce(first, F.max("dry_at").over(W.partitionBy()))
    return every.withColumn("end", end).select("source", "weight", "source_size", "source_rows", "end", F.least(full.cast("double"), F.col("weight") * F.col("end")).alias("target"))


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each row: (doc_id, shuffle_key, source, size, source_size, target, finish, lap, copies, taken).

    ``size`` is the number of words of the whole text. The budget is the size of all rows. ``finish`` is the virtual finish
    time of the first copy; copy k of a source of size s and weight w finishes k laps of s / w later. All copies that finish
    before the budget is used up are taken, those with equal time together or not at all.

    Null and blank texts have size 0 and are taken 0 words. Null is a source of its own, the last. Repeated rows are taken
    each for itself. Other columns are ignored; an empty table gives an empty result. Reruns give the same rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(_runtime.WORD)).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), text).alias("shuffle_key"),
    )
    rows = _runtime.cut(rows)
    known = _runtime.cut(sources(rows, weights, repeats))
    # a run is a slice of a source's shuffled order: as many leading bits of the key as the source's rows need
    bits = F.least(F.lit(BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("source_rows") / RUN)).cast("int")))
    rows = rows.join(known, rows["source"].eqNullSafe(known["source"])).drop(known["source"])
    rows = rows.withColumn("run", F.when(bits > 0, F.call_function("shiftrightunsigned", "shuffle_key", 64 - bits)).otherwise(F.lit(0)))
    runs = rows.groupBy("source", "run").agg(F.sum("size").alias("of_run"))
    # hash order of unsigned keys: runs and keys compare after moving the sign
    runs = runs.withColumn("before", F.coalesce(F.sum("of_run").over(W.partitionBy("source").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select(F.col("source").alias("of_source"), F.col("run").alias("of"), "before")
    within = F.sum("size").over(W.partitionBy("source", "run").orderBy("shuffle_key", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("within", within)
    rows = rows.join(runs, rows["source"].eqNullSafe(runs["of_source"]) & (rows["run"] == runs["of"]))
    rows = rows.withColumn("finish", (F.col("before") + F.col("within")) / F.col("weight")).withColumn("lap", F.col("source_size") / F.col("weight"))
    rows = _runtime.cut(rows.select("doc_id", "shuffle_key", "source", "size", "source_size", "target", "end", "finish", "lap"))
    cutoff = _cutoff(rows, repeats)
    copies = sum((F.when(F.col("finish") + k * F.col("lap") <= cutoff, 1).otherwise(0) for k in range(1, repeats)), F.when(F.col("finish") <= cutoff, 1).otherwise(0)).cast("long")
    return rows.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0).cast("long"))).select("doc_id", "shuffle_key", "source", "size", "source_size", "target", "finish", "lap", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _cutoff(rows: DataFrame, repeats: int) -> float:
    """The latest finish time that is within the budget.

    Copies are dealt into ranges of finish time; the sizes of the ranges tell in which of them the budget ends. That range is
    dealt again until few copies are left in it, which alone are put in order.
    """
    n, budget, hi = rows.agg(F.count(F.lit(1)), F.sum("size"), F.max(F.col("finish") + (repeats - 1) * F.col("lap"))).first()
    if not n or not budget:
        return 0.0
    copies = rows.where("size > 0").select("size", F.explode(F.array(*(F.col("finish") + k * F.col("lap") for k in range(repeats)))).alias("at"))
    lo, before, left = 0.0, 0, repeats * n  # copies in (lo, hi] are open, those up to lo have the size before
    while left > ORDERED:
        step = (hi - lo) / RANGES
        place = F.least(F.lit(RANGES - 1), F.greatest(F.lit(0), F.floor((F.col("at") - lo) / F.lit(step)))).cast("int")
        inside = copies.where((F.col("at") > lo) & (F.col("at") <= hi)).groupBy(place.alias("range"))
        found = sorted(tuple(r) for r in inside.agg(F.sum("size"), F.count(F.lit(1)), F.min("at"), F.max("at")).collect())
        upto = before
        for _, size, count, first, last in found:
            if upto + size > budget:
                break
            upto, lo = upto + size, last
        else:
            return lo
        shrunk = count < left or last < hi
        before, hi, left = upto, last, count
        if not shrunk or first == last:
            break
    sizes = copies.where((F.col("at") > lo) & (F.col("at") <= hi)).groupBy("at").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(W.orderBy("at")) + F.lit(before)
    found = sizes.select("at", upto.alias("upto")).where(F.col("upto") <= budget).agg(F.max("at")).first()[0]
    return lo if found is None else found


def _dealt(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """``rows`` with equal id, key and source share the copies of such a group: how many each of them gets, as ``__copies``.

    As many each, but for groups in which the budget ends, of which a source has no more than laps. The rows of these are
    written once; they are numbered within the partitions they were written in, and the partitions' counts put in line.
    """
    on = ["__id", "__key", "__source"]
    groups = taken.groupBy(*on).agg(F.min("copies").alias("__each"), F.sum("copies").alias("__all"), F.count(F.lit(1)).alias("__rows"), F.min("finish").alias("__finish"), F.first("lap").alias("__lap"))
    groups = groups.withColumn("__more", F.col("__all") - F.col("__each") * F.col("__rows"))
    same = lambda other: [rows[c].eqNullSafe(other[c]) for c in on]
    even = groups.where("__more = 0 AND __each > 0")
    out = rows.join(even, same(even)).select(rows["*"], "__finish", "__lap", F.col("__each").alias("__copies"))
    uneven = _runtime.cut(groups.where("__more > 0"))
    if not uneven.count():
        return out
    uneven = F.broadcast(uneven)
    some = _runtime.cut(rows.join(uneven, same(uneven)).select(rows["*"], "__finish", "__lap", "__each", "__more", F.spark_partition_id().alias("__part")))
    group = ["__finish", "__lap", *on]
    line = some.groupBy(*group, "__part").count()
    line = line.withColumn("__before", F.sum("count").over(W.partitionBy(*group).orderBy("__part")) - F.col("count")).drop("count")
    line = F.broadcast(line.select(*(F.col(c).alias(f"{c}_of") for c in (*group, "__part")), "__before"))
    place = F.row_number().over(W.partitionBy(*group, "__part").orderBy("__key"))
    some = some.withColumn("__place", place).join(line, [some[c].eqNullSafe(F.col(f"{c}_of")) for c in (*group, "__part")])
    copies = F.col("__each") + F.when(F.col("__before") + F.col("__place") <= F.col("__more"), 1).otherwise(0)
    return out.union(some.select(*rows.columns, "__finish", "__lap", copies.alias("__copies")).where("__copies > 0"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = 17, ordered: bool = True, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed rows of ``docs``, each as often as taken and with all its columns; ``ordered``: range-sorted by finish time.

    Rows of size 0 stay as they are, once: the mix takes no words of them, and they cost none of the budget. Rows that repeat
    an id, text and source share what the plan takes of them, as evenly as it goes. Null ids, texts and sources are values like
    others; an empty table gives an empty result.
    """
    taken = plan(docs, weights, repeats, seed, id_col, text_col, source_col).withColumn("copies", F.when(F.col("size") == 0, 1).otherwise(F.col("copies")))
    taken = taken.select(F.col("doc_id").alias("__id"), F.col("shuffle_key").alias("__key"), F.col("source").alias("__source"), "copies", "finish", "lap")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select("*", F.col(id_col).cast("long").alias("__id"), F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), text).alias("__key"), F.col(source_col).cast("string").alias("__source"))
    out = _dealt(keyed, taken).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    if ordered:
        at = F.col("__finish") + (F.col("__copy") - 1) * F.col("__lap")
        out = out.withColumn("__at", at).repartitionByRange("__at", "__key").sortWithinPartitions("__at", "__key")
    return out.select(*docs.columns)
