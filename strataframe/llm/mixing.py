"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time. Targets share a budget by weight, capped at a multiple of the
source. A source's documents form a stream in hash order, repeated until its target is reached. The integral of
the schedule is the source's cumulative demand; inverting it gives the training time at which each place of the
stream is due, and documents are range-sorted by that time.

Prefix sums run in hash buckets of (source, bucket), so a source that holds a third of all rows is spread over as
many tasks as its rows need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from strataframe.llm.names import fresh
from strataframe.plans.storage import materialise

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_SHARE = 0.5  # buckets of a source: this power of its rows, so that both buckets and their number stay small

#: Weight over training time as (time, factor) knots, one schedule for each weight in turn: the heaviest sources
#: lead and fade, the middle ones stay level, the lightest come in late. Each integrates to 1.
CURRICULUM = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)),
)


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def hash_order(doc_id: Column) -> Column:
    """A fixed pseudo-random 60-bit number of the id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(
    sources: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), budget: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """Rows (source, source_size) with place (from 0, by code point, null last), weight and target.

    Targets are the largest common rate times weight, capped at ``cap * source_size``, that together make
    ``budget`` times all sizes. One row per source, so the two windows over all of them are small.
    """
    n = len(weights)
    ranked = sources.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % n + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    by_fill = W.orderBy(F.col("_cap") / F.col("weight"), "place")
    everything = W.partitionBy()
    filled = ranked.select(
        "*",
        (
            (
                F.sum("source_size").over(everything) * F.lit(float(budget))
                - F.coalesce(F.sum("_cap").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
            )
            / F.sum("weight").over(by_fill.rowsBetween(0, W.unboundedFollowing))
        ).alias("_rate"),
    )
    rate = F.max(F.when(F.col("_cap") / F.col("weight") > F.col("_rate"), F.col("_rate"))).over(everything)
    return filled.withColumn("target", F.least("_cap", F.coalesce(rate * F.col("weight"), F.col("_cap")))).drop("_rate", "_cap")


def _segments(schedule: Sequence[tuple[float, float]]) -> Column:
    """Pieces of a piecewise linear schedule: start time, start weight, slope, demand before (of 1 in all)."""
    pieces, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        pieces.append([t0, w0, (w1 - w0) / (t1 - t0), before])
        before += (w0 + w1) / 2 * (t1 - t0)
    names = ("t0", "w0", "slope", "before")
    scale = (1.0, 1 / before, 1 / before, 1 / before)
    return F.array(*(F.struct(*(F.lit(x * s).alias(k) for x, s, k in zip(p, scale, names))) for p in pieces))


def due_time(demand: Column, segments: Column) -> Column:
    """Inverse of the integrated schedule: the time at which this share of a source's demand is met."""

    def solve(s: Column) -> Column:
        rest = F.greatest(demand - s["before"], F.lit(0.0))
        root = s["w0"] + F.sqrt(F.greatest(s["w0"] * s["w0"] + 2 * s["slope"] * rest, F.lit(0.0)))
        return s["t0"] + F.when(root > 0, 2 * rest / root).otherwise(F.lit(0.0))

    last = F.element_at(F.filter(segments, lambda s: s["before"] <= demand), -1)
    return F.least(solve(last), F.lit(1.0))


def mix_plan(
    docs: DataFrame,
    size: Column | None = None,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    budget: float = 1.5,
    cap: float = 2.0,
    schedules: Sequence[Sequence[tuple[float, float]]] = CURRICULUM,
    bucket_share: float = BUCKET_SHARE,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, positions.

    ``taken`` is copies times size. Whole rounds over a source come first; in the last, partial round documents are
    taken in hash order while they fit, and one more, the one closest to the gap, if that comes nearer to the
    target. ``positions`` holds the training time in [0, 1] of each copy. Nothing is random, so reruns agree.

    A null text has size 0. A null source is a source of its own, last in order. Documents of size 0 are taken as
    often as their place says, for 0 words. Repeated rows are documents of their own. An empty table gives no rows.
    """
    size = n_words() if size is None else size
    rows = materialise(docs.select("doc_id", "source", size.alias("size"), hash_order(F.col("doc_id")).alias("_h")), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    targets = source_targets(sources, weights, budget, cap)
    targets = targets.withColumn("_rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    targets = targets.withColumn("_rest", F.col("target") - F.col("_rounds") * F.col("source_size"))
    targets = targets.withColumn("_buckets", F.ceil(F.pow("_n", F.lit(bucket_share)))).withColumnRenamed("source", "_source")
    targets = materialise(targets.drop("_n"), "targets")

    bucket = F.floor(F.col("_h") / F.lit(float(1 << 60)) * F.col("_buckets"))
    placed = _by_source(rows, targets.select("_source", "_buckets")).withColumn("_b", bucket).drop("_buckets")
    within = W.partitionBy("source", "_b").orderBy("_h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    offsets = placed.groupBy("source", "_b").agg(F.sum("size").alias("_words"))
    before = W.partitionBy("source").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = offsets.select(
        F.col("source").alias("_os"), F.col("_b").alias("_ob"), F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_offset")
    )
    ends = placed.withColumn("_end", F.sum("size").over(within)).join(
        offsets, F.col("source").eqNullSafe(F.col("_os")) & (F.col("_b") == F.col("_ob"))
    )
    ends = ends.select("doc_id", "source", "size", "_h", (F.col("_end") + F.col("_offset")).alias("_end"))
    ends = materialise(_by_source(ends, targets).drop("_buckets"), "ends")

    fits = F.col("_end") <= F.col("_rest")
    gaps = ends.groupBy(F.col("source").alias("_gs")).agg(
        (F.max("_rest") - F.coalesce(F.max(F.when(fits, F.col("_end"))), F.lit(0))).alias("_gap")
    )
    gaps = materialise(gaps, "gaps")
    missed = ends.filter(~fits).join(gaps, F.col("source").eqNullSafe(F.col("_gs")))
    missed = missed.withColumn("_off", F.abs(F.col("size") - F.col("_gap"))).filter(F.col("_off") < F.col("_gap"))
    closing = missed.groupBy(F.col("source").alias("_cs")).agg(
        F.min(F.struct("_off", "_h", "doc_id", "_end")).alias("_closing"), F.first("_gap").alias("_gap")
    )
    closing = materialise(closing, "closing")
    ends = ends.join(closing, F.col("source").eqNullSafe(F.col("_cs")), "left")
    closes = (
        ~fits
        & F.col("_closing.doc_id").eqNullSafe(F.col("doc_id"))
        & F.coalesce(F.col("_closing._end") == F.col("_end"), F.lit(False))
    )
    start = F.when(closes, F.col("_rest") - F.col("_gap")).otherwise(F.col("_end") - F.col("size"))
    copies = F.col("_rounds") + F.when(fits & (F.col("_rest") > 0), 1).when(closes, 1).otherwise(0)
    schedule = F.element_at(F.array(*map(_segments, schedules)), (F.col("place") % len(schedules) + 1).cast("int"))
    counted = ends.withColumns({"copies": copies.cast("long"), "_start": start.cast("double"), "_schedule": schedule})

    def position(i: Column) -> Column:
        offset = F.when(i < F.col("_rounds"), F.col("_end") - F.col("size")).otherwise(F.col("_start"))
        share = F.when(F.col("target") > 0, (i * F.col("source_size") + offset) / F.col("target")).otherwise(0.0)
        return due_time(F.least(share, F.lit(1.0)), F.col("_schedule"))

    rounds = F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    positions = F.coalesce(F.transform(rounds, position), F.array().cast("array<double>"))
    return counted.select(
        "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"), positions.alias("positions"),
    )


def _by_source(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """The per-source columns added; Spark broadcasts the source table while its stored size allows it."""
    return rows.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row of ``docs`` for each copy taken, range-sorted by training time.

    Rows keep the columns of ``docs``. A document's row is repeated once per copy, and rows that repeat an id and
    its text share their copies out among them.
    """
    id_, source_, due_, rows_, time_, row_ = fresh(docs, "id", "source", "due", "rows", "time", "row")
    plan = mix_plan(docs, **options).filter("copies > 0")
    due = plan.groupBy(F.col("doc_id").alias(id_), F.col("source").alias(source_)).agg(
        F.flatten(F.collect_list("positions")).alias(due_), F.count("*").alias(rows_)
    )
    due = materialise(due, "due")
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(source_))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    order = docs.join(due.filter(F.col(rows_) == 1), same).select(*columns, F.explode(due_).alias(time_))
    repeated = due.filter(F.col(rows_) > 1)
    if not repeated.isEmpty():
        row = F.row_number().over(W.partitionBy(id_, source_).orderBy("text")) - 1
        several = docs.join(repeated, same).withColumn(row_, row)
        share = F.filter(due_, lambda x, i: i % F.col(rows_) == F.col(row_))
        order = order.unionByName(several.select(*columns, F.explode(share).alias(time_)))
    return order.repartitionByRange(time_).sortWithinPartitions(time_).drop(time_)
