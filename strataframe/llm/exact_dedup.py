"""Exact deduplication with a split for heavy hitters.

Texts are equal when identical after lower-casing A-Z only; null counts as empty. Misra-Gries counters find the
digests that make up a large share of all rows; their groups are counted exactly and their winners, at most
``1 / support`` rows, are broadcast, so that copies of a frequent text are settled where they lie. All other
digests go through an ordinary shuffle, in which no group can exceed ``support`` of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from strataframe.llm.names import fresh
from strataframe.plans.storage import materialise

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A digest of more than this share of the rows is certain to be found frequent; bounds the broadcast.
SUPPORT = 0.001


def digest(text: Column | str) -> Column:
    """SHA-256 of the normalised text in UTF-8, in lower-case hex."""
    text = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), 256)


def frequent_winners(keys: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Winner and exact size of every group that Misra-Gries names frequent (at most ``1 / support``), stored."""
    named = keys.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    counted = (
        keys.join(F.broadcast(named), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    return materialise(counted.filter("group_size > 1"), "heavy")


def dedup_report(docs: DataFrame, text: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id (largest doc_id of its group), group_size, kept, text_sha256.

    A null doc_id loses to any other; where all are null, keep_id is null and each is kept. Rows that repeat an id
    and its text are alike, so all carry the same verdict (:func:`exact_dedup` keeps one of them). Empty and null
    texts are one group. An empty table gives no rows.
    """
    keys = materialise(docs.select("doc_id", digest(text).alias("text_sha256")), "digests")
    winners = frequent_winners(keys, support)
    return _report(keys, winners)


def _report(keys: DataFrame, winners: DataFrame) -> DataFrame:
    heavy = keys.join(F.broadcast(winners), "text_sha256")
    group = W.partitionBy("text_sha256")
    rest = keys.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti").select(
        "text_sha256", "doc_id", F.max("doc_id").over(group).alias("keep_id"), F.count("*").over(group).alias("group_size")
    )
    return heavy.unionByName(rest).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def exact_dedup(docs: DataFrame, text: str = "text", support: float = SUPPORT) -> DataFrame:
    """The documents that stay, with all their columns: one row per distinct normalised text.

    Copies of frequent texts are removed map-side against the broadcast winners; other losers are taken out by an
    anti join on (digest, doc_id). Texts move at most once. Rows that repeat an id and its text are reduced to one.
    """
    digest_, won, won_id, lost, lost_id, rep = fresh(docs, "digest", "won", "won_id", "lost", "lost_id", "rep")
    keys = materialise(docs.select("doc_id", digest(text).alias("text_sha256")), "digests")
    winners = frequent_winners(keys, support)
    report = materialise(_report(keys, winners), "report")
    losers = (
        report.filter(~F.col("kept"))
        .join(F.broadcast(winners), "text_sha256", "left_anti")
        .select(F.col("text_sha256").alias(lost), F.col("doc_id").alias(lost_id))
    )
    repeated = report.filter("kept").groupBy("text_sha256").count().filter("count > 1")
    repeated = materialise(repeated.select(F.col("text_sha256").alias(rep)), "repeated")
    frequent = winners.select(F.col("text_sha256").alias(won), F.col("keep_id").alias(won_id))
    left = (
        docs.withColumn(digest_, digest(text))
        .join(F.broadcast(frequent), F.col(digest_) == F.col(won), "left")
        .filter(F.col(won).isNull() | F.col("doc_id").eqNullSafe(F.col(won_id)))
        .drop(won, won_id)
        .join(losers, (F.col(digest_) == F.col(lost)) & F.col("doc_id").eqNullSafe(F.col(lost_id)), "left_anti")
    )
    if not repeated.isEmpty():
        again = left.join(repeated, F.col(digest_) == F.col(rep), "left_semi").dropDuplicates([digest_])
        left = left.join(repeated, F.col(digest_) == F.col(rep), "left_anti").unionByName(again)
    return left.drop(digest_)
