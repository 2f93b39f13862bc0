"""Bounded, deterministic samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo ``modulus``; NULL ids count as the empty string."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: dict[int, int]) -> DataFrame:
    """(doc_id, text, label): at most ``bound[v]`` documents of each label value v for which ``learn`` holds.

    The choice is by hash of the id, so it depends on neither file order nor
    partitioning.  Rows without id or label are skipped; of several labels of
    one document the largest counts.  The bound makes the broadcast safe.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("__label"))
    picked = None
    for value, most in bound.items():
        part = one.where((F.col("__label") == value) & learn).orderBy(F.xxhash64("doc_id", F.lit(label)), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    text = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    return text.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "__label")
