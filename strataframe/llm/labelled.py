"""Labelled rows for training: held-out folds by a hash of the id, and bounded samples in hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: Column | str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's text leaves this remainder; false for a null id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def clean_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) with label 0 or 1. Null ids and labels are left out, and so are ids with both labels."""
    valid = labels.select("doc_id", F.col(column).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    return valid.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_max")).filter("label = _max").drop("_max")


def sample_per_class(labels: DataFrame, bound: int) -> DataFrame:
    """At most ``bound`` rows of each label, the first in hash order of the id: a sample that reruns agree on."""
    order = F.xxhash64("doc_id")
    return (
        labels.filter("label = 0").orderBy(order, "doc_id").limit(bound)
        .unionByName(labels.filter("label = 1").orderBy(order, "doc_id").limit(bound))
    )
