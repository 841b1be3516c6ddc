"""Exact duplicates: frequent digests are found by a Misra-Gries sketch and resolved without a shuffle, the rest by one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronark.llm import _runtime

#: A digest of more than this share of the rows is sure to be found; 1 / SUPPORT digests at most are broadcast.
SUPPORT = 1 / 1000


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


def frequent(digests: DataFrame) -> DataFrame:
    """(text_sha256, keep_id, group_size) of the digests that the sketch holds, counted exactly: 1 / SUPPORT rows at most.

    Sketches of slices of the tasks are merged first, so no task reads more of them than the square root of their number.
    """
    items = int(1 / SUPPORT)
    slices = digests.groupBy((F.spark_partition_id() % 256).alias("part")).agg(F.expr(f"approx_top_k_accumulate(text_sha256, {10 * items}) AS sketch"))
    found = slices.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_combine(sketch, {10 * items}) AS sketch")).select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {items})")).alias("top"))
    found = found.select(F.col("top.item").alias("text_sha256")).where("text_sha256 IS NOT NULL")
    seen = digests.join(F.broadcast(found), "text_sha256")
    return seen.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def flag_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal if identical; null counts as empty. Of equal texts the row with the largest id is kept. A null id is
    smaller than any other and keeps only if all ids of the group are null. Rows that repeat an id and its text are all
    marked as kept (``drop_copies`` leaves one of them). Other columns are ignored; an empty table gives an empty result.
    """
    digests = _runtime.cut(_digests(docs, id_col, text_col))
    winners = _runtime.cut(frequent(digests))
    marked = digests.join(F.broadcast(winners), "text_sha256", "left")
    # an aggregate combines before its shuffle and a skewed join is split: no digest is put in order by one task
    rest = marked.where("group_size IS NULL").select("text_sha256", "doc_id")
    groups = rest.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    rest = rest.join(groups, "text_sha256").select("text_sha256", "doc_id", "keep_id", "group_size")
    every = marked.where("group_size IS NOT NULL").select("text_sha256", "doc_id", "keep_id", "group_size").union(rest)
    return every.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they are."""
    keep = flag_copies(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("__keep"), F.col("text_sha256").alias("__sha")).distinct()
    sha = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)
    marked = docs.withColumn("__sha_of", sha)
    out = marked.join(keep, marked[id_col].cast("long").eqNullSafe(keep["__keep"]) & (marked["__sha_of"] == keep["__sha"]), "left_semi")
    return out.dropDuplicates([id_col, "__sha_of"]).drop("__sha_of")
