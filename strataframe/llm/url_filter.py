"""URL rules by a sort-merge range join.

A host's labels in reverse order, ``com.example.www.``, make a key under which a rule's host and all its subdomains
form one interval. Pages and rules are dealt out by ranges of that key, a rule to every range its interval touches,
and sorted. One sweep over a range keeps a stack of the nested hosts that are open at the current key; a page looks
for the longest rule among them whose path its own path starts with.

Ranges come from a bounded sample of keys; they only balance the work. A key with very many pages spans several
ranges, over which its pages are spread.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RANGES_PER_TASK = 4
SAMPLE_PER_RANGE = 20
DEFAULT = "allow"
AFTER_ALL = "\U0010ffff"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    place = F.instr(url, "://")
    return F.when(place > 0, F.substr(url, place + 3)).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot; null for an empty host."""
    return F.when(host != "", F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _bounds(keys: DataFrame, ranges: int) -> list[str]:
    """Upper bounds of all ranges but the last: quantiles of a sample in hash order."""
    sample = keys.orderBy(F.xxhash64("page_id", "key"), "key").limit(ranges * SAMPLE_PER_RANGE)
    found = sorted(r["key"] for r in sample.select("key").collect())
    return [found[len(found) * i // ranges] for i in range(1, ranges)] if found else []


class _Sweep:
    """Open hosts from the outermost to the innermost, each with its rules by path."""

    def __init__(self) -> None:
        self.open: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []  # with the rules' lengths, ascending

    def move(self, key: str) -> None:
        while self.open and not key.startswith(self.open[-1][0]):
            self.open.pop()

    def add(self, key: str, path: str, rule: str, verdict: str) -> None:
        self.move(key)
        if not self.open or self.open[-1][0] != key:
            self.open.append((key, {}, []))
        _, rules, lengths = self.open[-1]
        if path not in rules or verdict == "block":
            rules[path] = (rule, verdict)
        at = bisect_left(lengths, len(path))
        if at == len(lengths) or lengths[at] != len(path):
            lengths.insert(at, len(path))

    def find(self, key: str, path: str) -> tuple[str, str] | None:
        self.move(key)
        best: tuple[str, str] | None = None
        for _, rules, lengths in self.open:
            for n in reversed(lengths[: bisect_right(lengths, len(path))]):
                found = rules.get(path[:n])
                if found:
                    if best is None or len(found[0]) >= len(best[0]):
                        best = found
                    break
        return best


EVENTS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("host", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("verdict", T.StringType()),
    ]
)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none fits) and verdict.

    ``pages``: page_id, url; ``rules``: host, path, verdict (allow or block). A rule fits its host and all subdomains
    if the page's path starts with the rule's; the longest host + path wins, then the longer host;
    block wins between equal rules. Rules
    with a null or empty host are left out, a null path is empty. A null url, or one without ``://``, has an empty
    host and path and gets the default verdict, as does any page that no rule fits. Repeated rows get equal results;
    an empty table gives no rows, and without rules all pages get the default.
    """
    spark = pages.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    read = read.withColumn("key", host_key(F.col("host")))
    hostless = read.filter("key is null").select(
        "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")
    )
    keyed = read.filter("key is not null")
    bounds = _bounds(keyed.select("page_id", "key"), tasks * RANGES_PER_TASK)

    @F.arrow_udf(T.IntegerType())
    def page_range(key: pa.Array, spread: pa.Array) -> pa.Array:
        out = []
        for k, s in zip(key.to_pylist(), spread.to_pylist()):
            low = bisect_left(bounds, k)
            out.append(low + s % (bisect_right(bounds, k, low) - low + 1))
        return pa.array(out, pa.int32())

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def rule_ranges(key: pa.Array) -> pa.Array:
        keys = key.to_pylist()
        return pa.array([list(range(bisect_left(bounds, k), bisect_right(bounds, k + AFTER_ALL) + 1)) for k in keys], pa.list_(pa.int32()))

    placed = keyed.withColumn("_range", page_range("key", F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)))).select(
        "_range", "key", F.lit(1).alias("_kind"), "page_id", "host", "path",
        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"),
    )
    valid = rules.filter("host is not null and host <> ''").select(
        F.translate("host", UPPER, UPPER.lower()).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    )
    valid = valid.withColumn("key", host_key(F.col("host"))).withColumn("_range", F.explode(rule_ranges("key")))
    opened = valid.select(
        "_range", "key", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("page_id"), "host", "path",
        F.concat("host", "path").alias("rule"), "verdict",
    )
    events = placed.unionByName(opened).repartition(tasks, "_range").sortWithinPartitions("_range", "key", "_kind", "path")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Sweep()
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out: list[tuple] = []
            for key, kind, page_id, host, path, rule, verdict in zip(*columns):
                if kind == 0:
                    state.add(key, path, rule, verdict)
                else:
                    found = state.find(key, path)
                    out.append((page_id, host, path, *(found or (None, default))))
            columns = list(zip(*out)) or [()] * len(EVENTS)
            kinds = [pa.int64(), *[pa.string()] * 4]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], EVENTS.names)

    return events.drop("_range").mapInArrow(sweep, EVENTS).unionByName(hostless)
