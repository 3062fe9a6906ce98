"""Bagged and boosted trees fitted in tasks on all labelled rows.

Up to ``HELD_CELLS`` cells the rows are broadcast: the trees of a bagged ensemble are dealt over tasks; a boosted one is
a sequence and takes one task. Larger tables are fitted by :mod:`strataframe.operators.blocks`. Tasks store the nodes
they grew, packed, in shared storage: trees grown until pure have about as many nodes as rows, so the driver never holds
them. Scoring joins blocks of rows with groups of trees, ``PASS_BYTES`` of nodes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from strataframe.functions import trees
from strataframe.functions.casts import fill_features
from strataframe.plans.ordering import hashed_head
from strataframe.plans.storage import materialise

HELD_CELLS = 16_000_000  # of a table that every task of a fit may hold, in doubles 128 MB
TREES_PER_TASK = 25
ROWS_AT_ONCE = 1_000_000  # rows of the trees that a task grows side by side
PASS_BYTES = 256_000_000  # of nodes that a task meets at once when it scores
# rows scored in one task, which reads the whole ensemble: so many cells, and no more than so many rows
BLOCK_CELLS = 4_000_000
BLOCK_ROWS = 50_000

# a group of trees, or a part of one that counts as no tree: packed nodes, its share of each column's importance, the
# gain of its first split
_ARRAYS = ", ".join(f"{c} binary" for c in trees.Packed._fields)
GROUPS = f"first int, part long, trees int, {_ARRAYS}, weight array<double>, splits array<long>, gain double"


@dataclass(frozen=True)
class Sample:
    """Labelled rows for fitting and what each stands for."""

    x: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    columns: list[str]
    sizes: dict[tuple[int, int], int]  # rows of the whole table by (fold, label)

    def training(self, columns: Sequence[str], without: int | None) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
        """Values and labels outside a fold, and how many rows of the whole table each label stands for."""
        kept = self.fold != without if without is not None else np.ones(len(self.y), bool)
        at = [self.columns.index(c) for c in columns]
        whole = {v: sum(n for (f, label), n in self.sizes.items() if label == v and f != without) for v in (0, 1)}
        return self.x[kept][:, at], self.y[kept], whole


def class_sizes(rows: DataFrame) -> dict[tuple[int, int], int]:
    """Rows by (fold, label)."""
    return {(r["fold"], r["label"]): r["count"] for r in rows.groupBy("fold", "label").count().collect()}


def gather(rows: DataFrame, columns: Sequence[str], sizes: dict[tuple[int, int], int]) -> Sample:
    """All of ``rows`` (stay_id, label, fold, columns), which must be few, in an order that does not depend on partitions."""
    columns = list(columns)
    cells = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    ordered = fill_features(rows, columns).select("stay_id", "label", "fold", cells.alias("cells"))
    kept = ordered.withColumn("tie", F.xxhash64("label", "fold", "cells")).toArrow().combine_chunks()
    kept = kept.sort_by([("stay_id", "ascending"), ("tie", "ascending")])
    x = kept["cells"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(columns))
    return Sample(x, kept["label"].to_numpy().astype(float), kept["fold"].to_numpy(), columns, sizes)


def draw_sample(df: DataFrame, columns: Sequence[str], fit_rows: int, seed: int = 42) -> Sample:
    """At most ``fit_rows`` rows of each label (0 and 1; other rows are not labelled) of ``df`` (stay_id, label, fold,
    columns), for a look at a table: no fit is made from less than all rows."""
    rows = df.filter("label in (0, 1)")
    sizes = class_sizes(rows)
    if sum(sizes.values()) > fit_rows:
        rows = hashed_head(rows, "label", {0: fit_rows, 1: fit_rows}, "stay_id", seed)
    return gather(rows, columns, sizes)


@dataclass(frozen=True)
class TreeModel:
    """Stored groups of trees (``GROUPS``); ``bagged`` ensembles average their trees' case shares, boosted ones add up
    log-odds."""

    groups: DataFrame
    columns: list[str]
    bagged: bool

    def importance(self) -> list[float]:
        """Bagged: every tree's gains by column as shares of the tree's, averaged over trees that split at all.
        Boosted: the mean gain of a column's splits as a share of all columns'."""
        total, splits = np.zeros(len(self.columns)), np.zeros(len(self.columns))
        for r in self.groups.select("first", "part", "weight", "splits").orderBy("first", "part").toLocalIterator():
            total, splits = total + r["weight"], splits + r["splits"]
        if not splits.any():
            return [0.0] * len(self.columns)
        if not self.bagged:
            total = total / np.maximum(splits, 1)
        return (total / total.sum()).tolist()

    def root(self) -> tuple[int, float, float]:
        """Column, threshold and gain of the first tree's first split; column -1 if it has none."""
        r = self.groups.orderBy("first", "part").first()
        nodes = trees.unpacked([bytes(r[c]) for c in trees.Packed._fields])
        return int(nodes.feature[0]), float(nodes.threshold[0]), r["gain"]

    def score(self, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` and ``prob`` of rows with a ``features`` vector in the order of ``columns``.

        Rows are dealt over blocks by their hash, and each block meets the groups of trees in one task, or in as many
        after each other as it takes to hold ``PASS_BYTES`` of nodes at once.
        """
        bagged, width, keep = self.bagged, len(self.columns), list(keep)
        size = max(1, min(BLOCK_ROWS, BLOCK_CELLS // max(width, 1)))
        blocks = max(1, -(-rows.count() // size))
        cells = rows.select(*keep, vector_to_array("features").alias("_cells"))
        left = cells.withColumn("_block", F.pmod(F.xxhash64(*keep, "_cells"), F.lit(blocks)).cast("int")).withColumn("_total", F.lit(0.0))
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block")
        passes = self._passes()
        number = sum(n for _, _, n in passes)

        def scored(held: pa.Table, grown: pa.Table, last: bool) -> pa.Table:
            x = held["_cells"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            total = held["_total"].to_numpy().copy()
            for row in np.lexsort((grown["part"].to_numpy(), grown["first"].to_numpy())) if len(x) else ():
                nodes = trees.unpacked([grown[c][int(row)].as_buffer() for c in trees.Packed._fields])
                for i in range(0, len(x), 4096):
                    total[i : i + 4096] += trees.leaf_values(nodes, x[i : i + 4096])
            if not last:
                return held.set_column(held.schema.get_field_index("_total"), "_total", pa.array(total))
            prob = total / number if bagged else 1.0 / (1.0 + np.exp(-total))
            return held.select(keep).append_column("prob", pa.array(prob))

        schema = rows.select(*keep, F.lit(0.0).cast("double").alias("prob")).schema
        spot = lambda at: F.struct(F.lit(at[0]).cast("int"), F.lit(at[1]).cast("long"))
        place = F.struct("first", "part")
        for i, (begin, end, _) in enumerate(passes):
            last = i == len(passes) - 1
            right = self.groups.filter((place >= spot(begin)) & (place <= spot(end))).select("first", "part", *trees.Packed._fields, every)
            met = left.groupBy("_block").cogroup(right.groupBy("_block"))
            if last:
                return met.applyInArrow(lambda held, grown: scored(held, grown, True), schema)
            left = materialise(met.applyInArrow(lambda held, grown: scored(held, grown, False), left.schema), "totals")

    def _passes(self) -> list[tuple[tuple[int, int], tuple[int, int], int]]:
        """Runs of groups of at most ``PASS_BYTES`` of nodes (or one group): first, last and trees of each."""
        size = sum((F.length(c) for c in trees.Packed._fields), F.lit(0)).cast("long").alias("bytes")
        found, held = [], 0
        for r in sorted(self.groups.select("first", "part", "trees", size).collect()):
            at, held = (r["first"], r["part"]), held + r["bytes"]
            if found and held <= PASS_BYTES:
                found[-1] = found[-1][0], at, found[-1][2] + r["trees"]
            else:
                found.append((at, at, r["trees"]))
                held = r["bytes"]
        return found or [((0, 0), (0, 0), 0)]


def group_row(nodes: trees.Nodes, columns: int, shares: bool, part: int = 0, own: int = 0) -> pd.DataFrame:
    """One row of ``GROUPS``; a part's gains are those from node ``own`` on. ``shares``: gains count as shares of a tree's."""
    split = np.flatnonzero(nodes.feature >= 0)
    split = split[split >= own]
    feature, gain, tree = nodes.feature[split], nodes.gain[split], nodes.tree[split]
    if shares and len(tree):
        gain = gain / np.maximum(np.bincount(tree, gain)[tree], 1e-300)
    row = {"first": int(nodes.tree[0]), "part": part, "trees": 0 if part else len(np.unique(nodes.tree)), **trees.packed(nodes)._asdict()}
    row |= {"weight": np.bincount(feature, gain, columns), "splits": np.bincount(feature, minlength=columns), "gain": float(nodes.gain[0])}
    return pd.DataFrame([row])


def fit_bagged(spark, shared, columns: Sequence[str], profile, seed: int, without: int | None = None) -> TreeModel:
    """``shared`` is a broadcast :class:`Sample`. Both classes weigh the same in sum."""
    columns = list(columns)

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y, whole = shared.value.training(columns, without)
        binned = trees.cut_bins(x, profile.bins)
        n = sum(whole.values())
        weight = np.where(y == 1, n / 2 / max((y == 1).sum(), 1), n / 2 / max((y == 0).sum(), 1))
        some = max(1, ROWS_AT_ONCE // max(len(y), 1))
        for batch in batches:  # one, of TREES_PER_TASK trees at most
            named = batch["id"].tolist()
            for i in range(0, len(named), some):
                grown = trees.grow_bagged(
                    binned, y, weight, named[i : i + some], seed, profile.tree_depth, profile.bootstrap, profile.split_columns
                )
                yield group_row(grown, len(columns), True)

    parts = -(-profile.trees // TREES_PER_TASK)
    return TreeModel(materialise(spark.range(0, profile.trees, 1, parts).mapInPandas(grow, GROUPS), "trees"), columns, True)


def fit_boosted(spark, shared, columns: Sequence[str], profile, without: int | None = None) -> TreeModel:
    """``shared`` is a broadcast :class:`Sample`. A case weighs as much as there are controls to a case in the whole table."""
    columns = list(columns)

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample = shared.value
        x, y, whole = sample.training(columns, without)
        all_of = {v: sum(n for (_, label), n in sample.sizes.items() if label == v) for v in (0, 1)}
        if not all_of[1]:
            raise ValueError("no cases: the positive weight is undefined")
        up = {v: whole[v] / max((y == v).sum(), 1) for v in (0, 1)}
        weight = np.where(y == 1, all_of[0] / all_of[1] * up[1], up[0])
        for _ in batches:
            binned = trees.cut_bins(x, profile.bins)
            grown = trees.grow_boosted(binned, y, weight, profile.rounds, profile.round_depth, profile.rate)
            if profile.rounds:
                yield group_row(grown, len(columns), False)

    return TreeModel(materialise(spark.range(0, 1, 1, 1).mapInPandas(grow, GROUPS), "trees"), columns, False)
