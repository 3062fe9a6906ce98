"""Best-fit packing of token pieces into fixed-length sequences by exact-complement hashing.

Packing needs only how many pieces there are of each length: at most ``limit`` counts. Gaps are filled from an index
of the sums of one, two and three available lengths, as often as the counts allow; what has no exact complement is
packed best-fit, longest first. That plan, a list of (combination of lengths, how often), is made from the counts on
the driver; its size depends on ``limit`` and not on the documents. Pieces then take the slots of their length by
rank, and ranks come from counts per (length, bucket), so that no length is ordered in one task.
"""

from __future__ import annotations

import json
import math
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F, types as T, Window as W
from tokenizers import Tokenizer

from strataframe.plans.storage import materialise

LIMIT = 1024
END_ID = 2
SPARE = 0.25  # of each length, which exact pairs and triples leave for best fit
BUCKET_SHARE = 0.5  # buckets of a length: this power of its pieces, so that both buckets and their number stay small

PIECES = T.ArrayType(
    T.StructType(
        [
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
)


#: How byte-level tokenizers of this family split text before merging: fixed values. Without the look-ahead the
#: pattern needs no backtracking; the two agree on texts in which no white space stands beside other white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_SPLIT = SPLIT.replace(r"|\s+(?!\S)", "")
DOUBLE_SPACE = re.compile(r"\s\s")  # Python's white space holds all of the pattern's, and a few characters more


class TextEncoder:
    """Token ids of whole texts as tokenizers gives them for a tokenizer file, without added special tokens.

    A byte-level merge list whose ids follow its merges, as is usual, runs on tiktoken, several times as fast for
    equal ids; any other file, and any text that holds the string of an added token, runs on tokenizers itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        model = Tokenizer.from_file(path)
        ranks = byte_ranks(spec)
        added = [t["content"] for t in spec.get("added_tokens") or []]
        if ranks is None:
            self.encode = lambda text: model.encode(text, add_special_tokens=False).ids
            return
        plain, full = (tiktoken.Encoding(p, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (PLAIN_SPLIT, SPLIT))

        def encode(text: str) -> list[int]:
            if any(t in text for t in added):
                return model.encode(text, add_special_tokens=False).ids
            return (full if DOUBLE_SPACE.search(text) else plain).encode_ordinary(text)

        self.encode = encode


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Token bytes to ids, if the file is a plain byte-level merge list with ids in merge order."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and spec.get("normalizer") is None
    if not plain or before.get("add_prefix_space") or not before.get("use_regex", True) or model.get("byte_fallback"):
        return None
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    vocab = model["vocab"]
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    special = {t["content"] for t in spec.get("added_tokens") or []}
    tokens = [t for t in vocab if t not in special]
    if merged != sorted(merged) or len(tokens) != len(merged) + 256 or not all(set(t) <= byte_of.keys() for t in tokens):
        return None
    return {bytes(byte_of[c] for c in t): vocab[t] for t in tokens}


@lru_cache(1)
def _encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def _little_endian(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def encoded_bytes(tokenizer: str, end_id: int = END_ID):
    """A UDF from texts to their ids and the end id, as little-endian 32-bit numbers; null is an empty text."""

    @F.arrow_udf(T.BinaryType())
    def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _encoder(tokenizer)
        for column in columns:
            yield pa.array([_little_endian([*model.encode(text.as_py() or ""), end_id]) for text in column], pa.binary())

    return encode


def cut(ids: bytes, limit: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, length, ids) of a document's pieces: full ones, after a shorter first piece if one is needed."""
    n = len(ids) // 4
    start = 0
    while start < n:
        length = (n - start) % limit or limit
        yield start, length, ids[4 * start : 4 * (start + length)]
        start += length


def token_pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids.

    ``tokenizer`` is the path of a tokenizer file that every executor can open.
    """

    @F.arrow_udf(PIECES)
    def pieces(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _encoder(tokenizer)
        for column in columns:
            offsets, flat = [0], ([], [], [], [], [])
            for text in column:
                ids = _little_endian([*model.encode(text.as_py() or ""), END_ID])
                for k, (start, length, part) in enumerate(cut(ids, limit)):
                    row = (k, start, length, zlib.crc32(part), part if with_ids else None)
                    for values, value in zip(flat, row):
                        values.append(value)
                offsets.append(len(flat[0]))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ("piece", "start", "length", "ids_crc32", "ids")
            struct = pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(flat, kinds)], names)
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)

    exploded = docs.select("doc_id", F.explode(pieces(F.col(text))).alias("p"))
    return exploded.select("doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", *(["p.ids"] if with_ids else []))


def plan_sequences(counts: np.ndarray, limit: int = LIMIT, spare: float = SPARE) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths, longest first, and how often each is used; ``counts[n]`` pieces of length n.

    Gaps are filled exactly by singles first, then by pairs, then by triples, and best fit takes the rest. Pairs and
    triples leave the share ``spare`` of each length that was there when their turn began: short pieces are what best
    fit closes its last gaps with, and a plan that spends them all on exact sums ends with more sequences. Works on
    lengths and counts alone: about ``limit`` squared steps for pairs, and as many again for triples.
    """
    left = counts.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    kept = np.zeros(limit + 1, np.int64)

    def take(*combo: int) -> None:
        """Use a combination as often as the counts allow; the first length may be used up."""
        need: dict[int, int] = {}
        for n in combo:
            need[n] = need.get(n, 0) + 1
        times = min(int(left[n] - (kept[n] if n != combo[0] else 0)) // k for n, k in need.items())
        if times > 0:
            for n, k in need.items():
                left[n] -= k * times
            plan.append((combo, times))

    take(limit)
    for fill in (_fill_by_one, _fill_by_two, _fill_by_three):
        for first in range(limit - 1, 0, -1):
            if left[first]:
                fill(first, limit - first, left, kept, take)
        kept = np.ceil(left * spare).astype(np.int64)
    _best_fit(left, limit, plan)
    return plan


def _fill_by_one(first: int, gap: int, left: np.ndarray, kept: np.ndarray, take) -> None:
    if gap <= first:
        take(first, gap)


def _fill_by_two(first: int, gap: int, left: np.ndarray, kept: np.ndarray, take) -> None:
    """Every available length whose complement is available too; the longer part first, to spare short pieces."""
    x = np.arange(min(gap - 1, first), (gap - 1) // 2, -1)
    for n in x[(left[x] > kept[x]) & (left[gap - x] > kept[gap - x])]:
        take(first, int(n), int(gap - n))
        if not left[first]:
            return


def _fill_by_three(first: int, gap: int, left: np.ndarray, kept: np.ndarray, take) -> None:
    """For each second length, the pairs that sum to what is left of the gap."""
    for second in range(min(gap - 2, first), (gap - 1) // 3, -1):
        if left[second] <= kept[second]:
            continue
        rest = gap - second
        x = np.arange(min(rest - 1, second), (rest - 1) // 2, -1)
        for n in x[(left[x] > kept[x]) & (left[rest - x] > kept[rest - x])]:
            take(first, second, int(n), int(rest - n))
            if not left[first]:
                return
            if left[second] <= kept[second]:
                break


def _best_fit(left: np.ndarray, limit: int, plan: list[tuple[tuple[int, ...], int]]) -> None:
    """Best-fit decreasing on counts: equal bins are kept together as (gap -> combination -> how many)."""
    bins: list[dict[tuple[int, ...], int]] = [{} for _ in range(limit + 1)]
    for n in range(limit, 0, -1):
        todo = int(left[n])
        gap = n
        while todo and gap <= limit:
            if not bins[gap]:
                gap += 1
                continue
            combo, count = bins[gap].popitem()
            used = min(todo, count)
            if count > used:
                bins[gap][combo] = count - used
            _put(bins, gap - n, combo + (n,), used)
            todo -= used
        if todo:
            per = limit // n
            if todo // per:
                _put(bins, limit - per * n, (n,) * per, todo // per)
            if todo % per:
                _put(bins, limit - (todo % per) * n, (n,) * (todo % per), 1)
    plan += [x for same in bins for x in same.items()]


def _put(bins: list[dict], gap: int, combo: tuple[int, ...], count: int) -> None:
    bins[gap][combo] = bins[gap].get(combo, 0) + count


def _slots(plan: list[tuple[tuple[int, ...], int]], limit: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length its slots as (rank of the first piece, sequence of the first, offset, how many)."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used = [0] * (limit + 1)
    sequence = 0
    for combo, times in plan:
        offset = 0
        for n in combo:
            slots.setdefault(n, []).append((used[n], sequence, offset, times))
            used[n] += times
            offset += n
        sequence += times
    return slots


def pack(pieces: DataFrame, limit: int = LIMIT, bucket_share: float = BUCKET_SHARE) -> DataFrame:
    """``pieces`` (doc_id, piece, length and any other columns; stored, as they are read twice) with sequence_id and offset.

    A sequence's pieces are gapless from offset 0. Rows are ranked within their length by (hash bucket, id, piece),
    so equal rows are interchangeable. A piece of length 0 or over ``limit`` is an error. No rows give no rows.
    """
    spark = pieces.sparkSession
    found = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most limit rows
    if any(n is None or not 0 < n <= limit for n in found):
        raise ValueError(f"piece lengths must lie in 1..{limit}")
    counts = np.zeros(limit + 1, np.int64)
    for n, k in found.items():
        counts[n] = k
    slots = _slots(plan_sequences(counts, limit), limit)
    table = {
        n: tuple(np.asarray(x, np.int64) for x in zip(*rows)) for n, rows in slots.items()
    }
    shared = spark.sparkContext.broadcast(table)
    fan = {n: math.ceil(k**bucket_share) for n, k in found.items()}
    buckets = spark.createDataFrame(list(fan.items()), "length long, _buckets long")

    placed = pieces.join(F.broadcast(buckets), "length")
    placed = placed.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_buckets")))
    within = F.row_number().over(W.partitionBy("length", "_b").orderBy("doc_id", "piece")) - 1
    sizes = placed.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy("length").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    ranked = placed.withColumn("_within", within).join(starts, ["length", "_b"])

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def slot(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for x in np.unique(n):
            rows = np.flatnonzero(n == x)
            first, base, place, _ = shared.value[int(x)]
            k = np.searchsorted(first, r[rows], "right") - 1
            sequence[rows] = base[k] + r[rows] - first[k]
            offset[rows] = place[k]
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    out = ranked.withColumn("_slot", slot(F.col("length"), F.col("_first") + F.col("_within")))
    return out.select(*pieces.columns, "_slot.sequence_id", "_slot.offset")


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = LIMIT, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack whole documents: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    A document is its text's ids and an end id; a null or empty text is the end id alone. Only documents longer
    than ``limit`` are cut. Repeated rows are packed as often as they occur. An empty table gives no rows.
    """
    return pack(materialise(token_pieces(docs, tokenizer, limit, text, with_ids), "pieces"), limit)
