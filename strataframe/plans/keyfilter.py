"""A Bloom filter of keys, built as an aggregate and read as a scalar: it thins a wide table out before its exchange."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

BITS_PER_KEY = 16  # with two places a key, one row in seventy passes without a reason
MAX_BITS = 1 << 26  # 8 MB; beyond four million keys more rows pass, and none is lost
PART_BITS = 10  # 1,024 words are ordered in one row


def _in_order(at: str, value: str) -> Column:
    """All of a group's values as an array, in the order of ``at``."""
    return F.sort_array(F.collect_list(F.struct(at, value))).getField(value)


def may_hold(df: DataFrame, keys: DataFrame, columns: Sequence[str], max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``df`` whose key occurs in ``keys``, and a few others: a join on the key has to follow.

    No row of ``df`` is shuffled. The filter is at most ``max_bits`` long however many keys there are; its parts are
    combined map-side. ``keys`` is read twice and should be a stored table. A NULL key occurs nowhere. Keys are compared
    in the types of ``keys``; without keys no row is left.
    """
    types = {f.name: f.dataType for f in keys.schema.fields}
    wanted = keys.select(*columns).dropna()
    bits = min(1 << max(10, (BITS_PER_KEY * keys.count()).bit_length()), max_bits)

    def places(cells: Sequence[Column]) -> list[Column]:
        return [F.pmod(h, F.lit(bits).cast("long")) for h in (F.xxhash64(*cells), F.xxhash64(F.lit("second"), *cells))]

    at = wanted.select(F.explode(F.array(*places([F.col(f"`{c}`") for c in columns]))).alias("p"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))
    marks = at.select(F.shiftright("p", 6).alias("word"), mask.alias("mask"))
    empty = df.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
    words = marks.unionByName(empty).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    # words are put in order part by part, so that the last task only strings the parts together
    parts = words.groupBy(F.shiftright("word", PART_BITS).alias("part")).agg(_in_order("word", "mask").alias("words"))
    held = parts.agg(F.flatten(_in_order("part", "words")).alias("words")).scalar()

    own = [F.col(f"`{c}`").cast(types[c]) for c in columns]
    present = reduce(lambda a, b: a & b, [c.isNotNull() for c in own])
    set_ = [F.getbit(F.get(held, F.shiftright(p, 6).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1 for p in places(own)]
    return df.filter(reduce(lambda a, b: a & b, set_, present))
