"""Bounded, reproducible training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, fold


def labels_outside(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """(doc_id, y): one label per document whose fold is not the held-out one; null labels and ids are left out."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).filter(fold("doc_id", folds) != held_out)
    return known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))


def thinned(rows: DataFrame, n: int, salt: str) -> DataFrame:
    """About n rows of those with a doc_id, chosen by a hash of the id: the same ones however the table is dealt out."""
    total = rows.count()
    if total <= n:
        return rows
    draw = F.crc32(F.concat(F.lit(f"{salt}:"), F.col("doc_id").cast("string"))) / F.lit(float(1 << 32))
    return rows.filter(draw < n / total)


def texts_of(docs: DataFrame, sample: DataFrame, text: str = "text") -> list[tuple[bytes, int]]:
    """Texts and labels of the sampled ids, at the driver, in an order that depends on ids and texts alone.

    sample is bounded by thinned(), so it is broadcast and the documents are read once without a shuffle.
    """
    ids = sample.select(F.col("doc_id").alias("__id"), "y")
    picked = docs.select("doc_id", F.col(text).cast("string").alias("__t")).join(broadcast_if_small(ids), F.col("doc_id") == F.col("__id"))
    rows = picked.select("doc_id", F.coalesce(F.col("__t"), F.lit("")).cast("binary").alias("__t"), "y").collect()
    return [(bytes(r["__t"]), int(r["y"])) for r in sorted(rows, key=lambda r: (r["doc_id"], bytes(r["__t"])))]
