"""Near-duplicates by one-permutation MinHash with optimal densification.

A document's shingles are dealt to bins by one hash; the least hash of each bin is its signature, and an empty bin
borrows from bins named by a fixed random sequence until one is filled. Runs of bins form bands, and equal bands form
buckets. A bucket yields a star of candidate links around its smallest member instead of all pairs, and a second star
around its best connected one. Links are confirmed on full shingle sets.

Stars can miss a link between two members that neither centre is linked with. Documents of buckets that still hold
several components therefore go through an exact join: of two sets that similar, the rarest shingles of either must
meet, so documents are paired by those, and pairs in one component already are left out. Shingles are ranked by how
many of these documents hold them; a passage that very many share comes last and pairs nobody.

Documents with equal sets are one class from the start, so copies cost nothing further on. A set too small to be
linked with any but its equal is left out of the buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from strataframe.llm import bytescan as B
from strataframe.llm.components import components
from strataframe.llm.names import fresh
from strataframe.plans.storage import materialise

#: 21 bands of 6 bins: a pair at similarity 0.85 misses all bands with probability 5e-5, one at 0.8 with 2e-3 ...
BANDS, ROWS = 21, 6
#: ... so for lower thresholds bands are shorter and more: 30 bands of 5 bins miss a pair at 0.8 with 7e-6.
WIDE_BANDS, WIDE_ROWS = 30, 5
MISSED = 1e-4  # at most, of the pairs at a threshold below 0.8
MOST_BINS = 160

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(block: B.Block, width: int) -> list[np.ndarray]:
    """For each text its distinct shingle hashes, sorted; with fewer words than ``width``, one for all its words."""
    block = block._replace(data=B.LOWER[block.data])
    spans = B.words(block)
    h = B.span_hashes(block.data, spans.start, spans.end)
    windows, first = B.window_hashes(h, spans.text, width)
    n = len(block.offsets) - 1
    word_bounds = np.searchsorted(spans.text, np.arange(n + 1))
    bounds = np.searchsorted(spans.text[first], np.arange(n + 1))
    sets = [np.unique(windows[a:b]) for a, b in zip(bounds, bounds[1:])]
    for i in np.flatnonzero((np.diff(bounds) == 0) & (np.diff(word_bounds) > 0)):
        few = np.array([word_bounds[i + 1] - word_bounds[i]], np.uint64)
        for k in range(word_bounds[i], word_bounds[i + 1]):
            few = B.mix(few * np.uint64(0x9E3779B97F4A7C15) + h[k : k + 1])
        sets[i] = few
    return sets


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One-permutation signatures (a row per set, none empty) with optimal densification."""
    size = np.array([len(s) for s in sets])
    h = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), size)
    least = np.full(len(sets) * bins, _EMPTY)
    np.minimum.at(least, row * bins + (h % np.uint64(bins)).astype(np.int64), h)
    least = least.reshape(len(sets), bins)
    filled = least != _EMPTY
    r, c = np.nonzero(~filled)
    attempt = 0
    while len(r):
        attempt += 1
        probe = B.mix(np.arange(bins, dtype=np.uint64) + np.uint64(bins * attempt)) % np.uint64(bins)
        source = probe[c].astype(np.int64)
        found = filled[r, source]
        least[r[found], c[found]] = least[r[found], source[found]]
        r, c = r[~found], c[~found]
    return least


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = signature.reshape(len(signature), bands, rows)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), part.shape[:2])
    for k in range(rows):
        out = B.mix(out * np.uint64(0x9E3779B97F4A7C15) + part[:, :, k])
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


SIGNATURE = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("set_id", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)


def _signature_udf(width: int, bands: int, rows: int, least: int):
    @F.arrow_udf(SIGNATURE)
    def signed(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            sizes, ids, lists = [], [], []
            for block in B.blocks(column):
                sets = shingle_sets(block, width)
                sizes += [len(s) for s in sets]
                for s in sets:
                    two = np.array([s.sum(dtype=np.uint64), B.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)])
                    ids.append(two.tobytes() if len(s) else None)
                large = [i for i, s in enumerate(sets) if len(s) >= least]
                found = [np.zeros(0, np.int64)] * len(sets)
                if large:
                    hashed = _signed(band_hashes(signatures([sets[i] for i in large], bands * rows), bands, rows))
                    for i, row in zip(large, hashed):
                        found[i] = row
                lists += found
            yield pa.StructArray.from_arrays(
                [pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), _lists(lists)], ["n", "set_id", "bands"]
            )

    return signed


def _set_udf(width: int):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def shingles(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield _lists([_signed(s) for block in B.blocks(column) for s in shingle_sets(block, width)])

    return shingles


def linked(n_a: Column, n_b: Column, common: Column, percent: int) -> Column:
    return 100 * common >= percent * (n_a + n_b - common)


def band_layout(percent: int) -> tuple[int, int]:
    """(bands, bins in each) for a threshold: the longest bands of which ``MOST_BINS`` bins hold enough.

    A threshold for which none does (below 5 percent) is an error, because too many pairs would be missed.
    """
    if percent >= 85:
        return BANDS, ROWS
    if percent >= 80:
        return WIDE_BANDS, WIDE_ROWS
    for rows in range(WIDE_ROWS - 1, 0, -1):
        meets = (percent / 100) ** rows
        bands = math.ceil(math.log(MISSED) / math.log1p(-meets)) if meets > 0 else MOST_BINS + 1
        if bands * rows <= MOST_BINS:
            return bands, rows
    raise ValueError(f"no banding finds pairs at {percent} percent often enough")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Documents are linked when their sets of
    ``width``-word shingles have ``100 * |intersection| >= percent * |union|``; component_id is the smallest doc_id
    reachable. A document with fewer words has one shingle, all its words; one without words (null and empty texts
    too) has none and is linked with nothing. Rows with a null doc_id are compared with nothing: their component is
    null and they are kept. Rows that share an id are one node; repeated rows get equal results. An empty table gives
    no rows.
    """
    # the smallest set that can be linked with another one; at 100 percent only equal sets are
    least = next((n for n in range(1, 1000) if 100 * n >= percent * (n + 1)), 1 << 62)
    bands, rows = band_layout(percent)
    signed = docs.select("doc_id", _signature_udf(width, bands, rows, least)(F.col(text)).alias("s"))
    signed = materialise(signed.select("doc_id", "s.n", "s.set_id", "s.bands"), "signatures")

    known = signed.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = known.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = materialise(classes, "classes")
    entries = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("_k"), F.min("rep").alias("hub")).filter("_k > 1")
    members = entries.join(shared.select("bucket", "hub"), "bucket")
    members = materialise(members, "members")
    links, found = _star_links(docs, members, width, percent, text)

    # rows that share an id tie their classes together
    nodes = known.select("doc_id", "set_id").join(classes.select("set_id", "rep"), "set_id")
    ties = nodes.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    several = known.select("doc_id", "set_id").distinct().groupBy("doc_id").count().filter("count > 1")
    ties = ties.join(several.select(F.col("doc_id").alias("a")), "a", "left_semi")
    if not several.isEmpty():
        found = components(links.unionByName(ties))
    reached = classes.join(found, F.col("rep") == F.col("node"), "left").select(
        F.col("set_id").alias("_set"), F.least("rep", F.coalesce("component", "rep")).alias("_component")
    )
    out = signed.join(reached, F.col("doc_id").isNotNull() & (F.col("set_id") == F.col("_set")), "left")
    component = F.coalesce("_component", "doc_id")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")
    )


def _star_links(docs: DataFrame, members: DataFrame, width: int, percent: int, text: str) -> tuple[DataFrame, DataFrame]:
    """Confirmed links (a, b) that connect all that the buckets hold, and their components (node, component).

    ``members``: (bucket, rep, n, hub).
    """
    ids = members.select(F.col("rep").alias("_rep")).distinct()
    found = docs.select("doc_id", F.col(text).alias("text")).join(ids, F.col("doc_id") == F.col("_rep"))
    sets = materialise(found.select("_rep", _set_udf(width)(F.col("text")).alias("shingles")), "sets")

    sizes = members.select(F.col("rep").alias("a"), F.col("n").alias("n_a")).distinct()
    stars = members.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"), F.col("n").alias("n_b"))
    compared = _compare(stars.distinct().join(sizes, "a"), sets, percent)
    links = compared.filter("linked").select("a", "b")
    labels = components(links)
    mixed = _mixed(members, labels)

    degrees = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("degree"))
    known = mixed.join(degrees, "rep", "left")
    best = F.max_by(F.struct("rep", "n", "c"), F.struct(F.coalesce("degree", F.lit(0)), -F.col("rep")))
    centres = known.groupBy("bucket").agg(best.alias("x"))
    pairs = mixed.join(centres, "bucket").filter(F.col("c") != F.col("x.c"))
    more = _compare(_ordered(pairs, "x.rep", "x.n", "rep", "n").join(compared, ["a", "b"], "left_anti"), sets, percent)
    compared = compared.unionByName(more)
    if not more.filter("linked").isEmpty():
        links = compared.filter("linked").select("a", "b")
        labels = components(links)
        mixed = _mixed(mixed.drop("c"), labels)

    rest = mixed.select("rep", "n", "c").distinct()
    pairs = _meeting(rest, sets, percent).join(compared, ["a", "b"], "left_anti")
    more = _compare(pairs, sets, percent).filter("linked").select("a", "b")
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links)
    return links, labels


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Stored (bucket, rep, n, c) of the buckets that hold several components c."""
    labelled = members.select("bucket", "rep", "n").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = labelled.select("bucket", "rep", "n", F.coalesce("component", "rep").alias("c"))
    several = labelled.groupBy("bucket").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).filter("_lo <> _hi")
    return materialise(labelled.join(several.select("bucket"), "bucket", "left_semi"), "mixed")


def _ordered(pairs: DataFrame, x: str, n_x: str, y: str, n_y: str) -> DataFrame:
    """Distinct pairs as (a, b, n_a, n_b) with a < b."""
    first = F.col(x) < F.col(y)
    return pairs.select(
        F.least(x, y).alias("a"), F.greatest(x, y).alias("b"),
        F.when(first, F.col(n_x)).otherwise(F.col(n_y)).alias("n_a"),
        F.when(first, F.col(n_y)).otherwise(F.col(n_x)).alias("n_b"),
    ).distinct()


def _meeting(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b) of different components whose rarest shingles meet; loses no linked pair.

    Linked sets share at least ``percent`` percent of either, so in any common order of shingles the first
    ``n - needed + 1`` of each have one in common, and from the first such on there must be enough shingles left in
    both. Shingles that only one document holds count as places, but pair nobody.
    """
    tokens = rest.join(sets, F.col("rep") == F.col("_rep")).select("rep", "c", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    held = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("c").alias("_lo"), F.max("c").alias("_hi")).filter("df > 1")
    shared = tokens.join(held, "token")
    own = W.partitionBy("rep", "c")
    needed = F.floor((F.lit(percent) * F.col("n") + 99) / 100)
    placed = shared.select(
        "*",
        F.row_number().over(own.orderBy("df", "token")).alias("_k"),
        F.count("*").over(own).alias("_shared"),
    )
    left = F.col("_shared") - F.col("_k") + 1  # this shingle and those after it
    first = placed.filter((left >= needed) & (F.col("_lo") != F.col("_hi")))
    first = materialise(first.select("token", "rep", "n", "c", left.alias("left")), "rarest")
    x, y = (first.select("token", *(F.col(k).alias(f"{k}_{side}") for k in ("rep", "n", "c", "left"))) for side in "xy")
    similar = 100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")
    enough = (100 + percent) * F.least("left_x", "left_y") >= percent * (F.col("n_x") + F.col("n_y"))
    apart = (F.col("rep_x") < F.col("rep_y")) & (F.col("c_x") != F.col("c_y"))
    met = x.join(y, (x["token"] == y["token"]) & apart & similar & enough)
    return _ordered(met, "rep_x", "n_x", "rep_y", "n_y")


def _compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Stored (a, b, linked) for candidate pairs (a, b, n_a, n_b); sizes alone rule some out."""
    possible = pairs.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    one = sets.select(F.col("_rep").alias("a"), F.col("shingles").alias("_sa"))
    two = sets.select(F.col("_rep").alias("b"), F.col("shingles").alias("_sb"))
    both = possible.join(two, "b").join(one, "a")
    common = F.size(F.array_intersect("_sa", "_sb"))
    out = both.select("a", "b", linked(F.size("_sa"), F.size("_sb"), common, percent).alias("linked"))
    return materialise(out, "compared")


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: the smallest doc_id of each component.

    Documents without words and rows with a null doc_id all stay.
    """
    (lost,) = fresh(docs, "lost")
    losers = near_duplicates(docs, width, percent, text).filter(~F.col("kept")).select(F.col("doc_id").alias(lost)).distinct()
    return docs.join(losers, F.col("doc_id") == F.col(lost), "left_anti")
