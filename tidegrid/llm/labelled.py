"""Folds and bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: Column, of: int) -> Column:
    """crc32 of the key as text, modulo `of`; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % of


def sample(docs: DataFrame, labels: DataFrame, label: str, of: int, held_out: int, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """order, label (0 or 1), _text of at most `size` documents of each label that have one label only and are not held out.

    A key with two different labels, or a null label, is left out. Those taken are the first by a
    hash of the key, so that every run takes the same; their keys (at most 2 * size rows) are broadcast. Of several
    rows with one key the text that sorts first stands for it, so that rows are bounded as keys are.
    """
    ok = labels.filter((fold(F.col(key), of) != held_out) & F.col(label).isNotNull() & F.col(key).isNotNull())
    ok = ok.groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("label"), F.max(label).alias("_max")).filter(F.col("label") == F.col("_max"))
    ok = ok.select("_key", "label", F.xxhash64("_key", F.lit(7)).alias("order"))
    ok = ok.filter("label = 0").orderBy("order").limit(size).unionByName(ok.filter("label = 1").orderBy("order").limit(size))
    found = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(ok), "_key")
    return found.groupBy("_key").agg(F.first("order").alias("order"), F.first("label").cast("int").alias("label"), F.min("_text").alias("_text")).drop("_key")
