"""Trees fitted on tables that no task can hold, on all labelled rows, which stay in stored blocks of bin codes.

Bin edges come from counts of every value. A level of nodes is one pass: each block sums A, B and rows by node, column
and code (see :mod:`strataframe.functions.trees`), and the task that meets a node's sums finds its cut. The driver holds
the cuts. Nodes of a bagged tree with few enough rows are not cut so: their rows meet in one task, which grows the rest
of the tree there. Boosted trees go through all their levels; margins are stored with the rows every few rounds. Bootstrap
counts are exact draws with replacement: a tree's rows are dealt over blocks by one multinomial draw, and within each.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strataframe.functions import trees
from strataframe.functions.casts import fill_features
from strataframe.operators import forests
from strataframe.plans.ordering import running_totals, value_counts
from strataframe.plans.storage import discard, fresh_path, materialise

BLOCK_CELLS = 8_000_000
TASK_CELLS = 4_000_000  # of a node whose tree one task grows on
HANDED_CELLS = 2_000_000_000  # that trees grown side by side may hand to tasks
ROUNDS_KEPT = 25  # boosted trees that tasks add to stored margins

_CUT = "node int, " + ", ".join(f"{c} {'int' if c in ('column', 'code') else 'double'}" for c in trees.Cut._fields)


@dataclass(frozen=True)
class Blocks:
    """A training set: ``(block, y, codes)`` with the codes of all columns row by row."""

    table: DataFrame
    edges: list[np.ndarray]
    columns: list[str]
    sizes: list[int]  # rows of each block
    labels: dict[int, int]  # rows of each label

    def reader(self, columns: Sequence[str]) -> Callable:
        """For tasks: batches of the table become each block's row, its labels and the codes of some columns."""
        kind, at = code_type(self.edges), [self.columns.index(c) for c in columns]

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Series, np.ndarray, np.ndarray]]:
            for batch in batches:
                for _, r in batch.iterrows():
                    y = np.frombuffer(r["y"], np.uint8)
                    yield r, y, np.frombuffer(r["codes"], kind).reshape(len(y), -1)[:, at]

        return rows


class Stored:
    """Labelled rows (stay_id, label, fold, columns) in storage; the blocks of each training set are made once."""

    def __init__(self, rows: DataFrame, columns: Sequence[str], sizes: dict[tuple[int, int], int]):
        self.rows, self.columns, self.sizes = rows, list(columns), sizes
        self._made: dict[tuple, Blocks] = {}
        self._lock = threading.Lock()

    def blocks(self, without: int | None, bins: int) -> Blocks:
        with self._lock:
            if (without, bins) not in self._made:
                # a row without a fold is in every training set
                rows = self.rows if without is None else self.rows.filter(~F.col("fold").eqNullSafe(F.lit(without)))
                labels = {v: sum(n for (f, label), n in self.sizes.items() if label == v and (without is None or f != without)) for v in (0, 1)}
                self._made[without, bins] = make_blocks(rows, self.columns, bins, labels)
            return self._made[without, bins]


def training_rows(df: DataFrame, columns: Sequence[str]):
    """All rows labelled 0 or 1 of ``df`` (stay_id, label, fold, columns) as fits take them: a broadcast
    :class:`forests.Sample` of up to ``HELD_CELLS`` cells, otherwise :class:`Stored`."""
    rows = df.filter("label in (0, 1)")
    sizes = forests.class_sizes(rows)
    if sum(sizes.values()) * len(columns) <= forests.HELD_CELLS:
        return df.sparkSession.sparkContext.broadcast(forests.gather(rows, columns, sizes))
    kept = fill_features(rows, columns).select("stay_id", "label", "fold", *[f"`{c}`" for c in columns])
    return Stored(materialise(kept, "training"), columns, sizes)


def code_type(edges: Sequence[np.ndarray]) -> np.dtype:
    return np.min_scalar_type(max((len(e) for e in edges), default=0))


def bin_edges(rows: DataFrame, columns: Sequence[str], bins: int) -> list[np.ndarray]:
    """The edges of :func:`trees.cut_bins` over all rows, from counts of each column's values and their running sums."""
    names = {f"x{i}": c for i, c in enumerate(columns)}
    long = rows.select(*[F.col(f"`{c}`").cast("double").alias(x) for x, c in names.items()]).unpivot([], list(names), "feature", "value")
    counts = materialise(value_counts(long, ["feature"], "value"), "counts")
    located = running_totals(counts, ["feature"], "value", {"n": "upto"}, totals={"n": "size"})
    values = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("values"))
    # whether the rows of a value hold one of the quantiles 1 / bins, 2 / bins ...
    holds = F.expr(f"least(upto * {bins} div size, {bins - 1}) > (upto - n) * {bins} div size")
    picked = located.join(values, "feature").filter((F.col("values") <= bins) | holds).select("feature", "value", "values").collect()
    found: dict[str, list[float]] = {x: [] for x in names}
    few = set()
    for r in picked:
        found[r["feature"]].append(r["value"])
        if r["values"] <= bins:
            few.add(r["feature"])
    ordered = {x: np.sort(np.asarray(v, float)) for x, v in found.items()}
    return [(v[1:] + v[:-1]) / 2 if x in few else v for x, v in ordered.items()]


def make_blocks(rows: DataFrame, columns: Sequence[str], bins: int, labels: dict[int, int]) -> Blocks:
    """Rows dealt over blocks by their hash, so that blocks do not depend on partitions."""
    edges = bin_edges(rows, columns, bins)
    kind, width = code_type(edges), len(columns)
    count = max(1, -(-sum(labels.values()) * width // BLOCK_CELLS))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["cells"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            codes = np.empty(x.shape, kind)
            for j, cuts in enumerate(edges):
                codes[:, j] = np.searchsorted(cuts, x[:, j], "left")
            size = max(1, codes.itemsize * width)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(x), [None, pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([batch["stay_id"], batch["y"], packed.cast(pa.binary())], ["stay_id", "y", "codes"])

    cells = rows.select("stay_id", F.col("label").cast("int").alias("y"), F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("cells"))
    kinds = f"stay_id {dict(rows.dtypes)['stay_id']}, y int, codes binary"
    dealt = cells.mapInArrow(coded, kinds).withColumn("block", F.pmod(F.xxhash64("stay_id", "y", "codes"), F.lit(count)).cast("int"))

    def packed(held: pa.Table) -> pa.Table:
        held = held.sort_by([(c, "ascending") for c in ("stay_id", "y", "codes")])
        y = held["y"].to_numpy().astype(np.uint8)
        row = [held["block"][0].as_py()], [len(y)], [y.tobytes()], [b"".join(held["codes"].to_pylist())]
        return pa.table(dict(zip(("block", "n", "y", "codes"), row)), pa.schema([("block", pa.int32()), ("n", pa.int32()), ("y", pa.binary()), ("codes", pa.binary())]))

    table = dealt.repartition(count, "block").groupBy("block").applyInArrow(packed, "block int, n int, y binary, codes binary")
    table = materialise(table, "blocks")
    found = {r["block"]: r["n"] for r in table.select("block", "n").collect()}
    return Blocks(table.drop("n"), edges, list(columns), [found.get(i, 0) for i in range(count)], labels)


class _Top:
    """The nodes of trees that the driver knows, with codes."""

    def __init__(self, count: int = 0):
        self.rows: list[list] = []  # tree, feature, code, left child, value, gain
        self.path: list[int] = []  # 1 for a root, 2p and 2p + 1 for the children of p
        for tree in range(count):
            self.add(tree, 1, 0.0)

    def add(self, tree: int, path: int, value: float) -> int:
        self.rows.append([tree, -1, 0, -1, value, 0.0])
        self.path.append(path)
        return len(self.rows) - 1

    def split(self, node: int, feature: int, code: int, gain: float, left: float, right: float) -> tuple[int, int]:
        tree, path = self.rows[node][0], self.path[node]
        children = self.add(tree, 2 * path, left), self.add(tree, 2 * path + 1, right)
        self.rows[node] = [tree, feature, code, children[0], self.rows[node][4], gain]
        return children

    def arrays(self, edges: Sequence[np.ndarray]) -> tuple[trees.Nodes, np.ndarray]:
        """Nodes and the codes up to which rows go left."""
        kinds = np.int32, np.int32, np.int64, np.int32, np.float64, np.float64
        tree, feature, code, left, value, gain = (np.asarray(c, k) for c, k in zip(zip(*self.rows), kinds))
        threshold = np.asarray([edges[f][c] if f >= 0 else 0.0 for f, c in zip(feature, code)])
        right = np.where(left >= 0, left + 1, -1).astype(np.int32)
        return trees.Nodes(tree, feature, threshold, left, right, value, gain), code

    def tree(self, nodes: trees.Nodes, tree: int) -> trees.Nodes:
        at = np.flatnonzero(nodes.tree == tree)
        place = np.full(len(nodes.tree) + 1, -1, np.int32)
        place[at] = np.arange(len(at))
        part = trees.Nodes(*[c[at] for c in nodes])
        return part._replace(left=place[part.left], right=place[part.right])

    def path_to(self, nodes: trees.Nodes, node: int) -> tuple[trees.Nodes, int]:
        """A tree of the way to one node, all other leaves 0, and the node's place in it."""
        ways = []
        at, path = {p: i for i, (p, r) in enumerate(zip(self.path, self.rows)) if r[0] == nodes.tree[node]}, self.path[node]
        while path > 1:
            path //= 2
            ways.insert(0, at[path])
        size = 1 + 2 * len(ways)
        tree, feature, left = np.full(size, nodes.tree[node], np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        threshold, here = np.zeros(size), 0
        for k, inner in enumerate(ways):
            feature[here], threshold[here], left[here] = nodes.feature[inner], nodes.threshold[inner], 1 + 2 * k
            here = 1 + 2 * k + (self.path[node] >> (len(ways) - 1 - k) & 1)
        right = np.where(left >= 0, left + 1, -1).astype(np.int32)
        return trees.Nodes(tree, feature, threshold, left, right, np.zeros(size), np.zeros(size)), here


def _cuts(table: DataFrame, sums: Callable, columns: int, shrink: float, least: float, first: bool = False) -> dict[int, trees.Cut]:
    """``sums`` maps blocks to ``(node, block, sums)``, where sums are 3 x columns x codes; each node's best cut."""

    def judged(held: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v).reshape(3, columns, -1) for v in held.sort_values("block")["sums"])
        return pd.DataFrame([(int(held["node"].iloc[0]), *trees.best_cut(total, shrink, least, first))], columns=["node", *trees.Cut._fields])

    found = table.mapInPandas(sums, "node int, block int, sums binary").groupBy("node").applyInPandas(judged, _CUT).collect()
    return {r["node"]: trees.Cut(*r[1:]) for r in found}


def _summed(block: int, nodes: Sequence[int], place: np.ndarray, a: np.ndarray, b: np.ndarray, codes: Callable, columns: int, width: int):
    """Rows of ``(node, block, sums)``; row i belongs to ``nodes[place[i]]``, and ``codes(j)`` are the rows' codes of the
    j-th column that their node looks at."""
    m = len(nodes)
    out = np.zeros((m, 3, columns, width))
    for j in range(columns):
        key = place * width + codes(j)
        for i, weights in enumerate((a, b, None)):
            out[:, i, j] = np.bincount(key, weights, m * width).reshape(m, width)
    return pd.DataFrame({"node": nodes, "block": block, "sums": [v.tobytes() for v in out]})


def _table(spark, rows: list[pd.DataFrame]) -> DataFrame:
    return spark.range(0, 1, 1, 1).mapInPandas(lambda batches: (row for _ in batches for row in rows), forests.GROUPS)


def fit_bagged(spark, stored: Stored, columns: Sequence[str], profile, seed: int, without: int | None = None) -> forests.TreeModel:
    """As :func:`forests.fit_bagged`, though with other draws."""
    columns, blocks = list(columns), stored.blocks(without, profile.bins)
    rows = sum(blocks.sizes)
    at_once = max(1, min(forests.TREES_PER_TASK, HANDED_CELLS // max(1, rows * len(blocks.columns))))
    path = fresh_path(spark, "trees")
    for begin in range(0, profile.trees, at_once):
        _grow_bagged(spark, blocks, columns, profile, seed, list(range(begin, min(begin + at_once, profile.trees))), path)
    raw = spark.read.schema(forests.GROUPS).parquet(path)
    # gains as shares of their tree's, which is in several parts
    whole = raw.groupBy("first").agg(F.sum(F.aggregate("weight", F.lit(0.0), lambda s, v: s + v)).alias("whole"))
    share = F.when(F.col("whole") > 0, F.transform("weight", lambda v: v / F.col("whole"))).otherwise(F.col("weight"))
    groups = materialise(raw.join(whole, "first").withColumn("weight", share).select(*raw.columns), "trees")
    discard(spark, path)
    return forests.TreeModel(groups, columns, True)


def _grow_bagged(spark, blocks: Blocks, columns: list[str], profile, seed: int, named: list[int], path: str) -> None:
    edges = [blocks.edges[blocks.columns.index(c)] for c in columns]
    rows_in = blocks.reader(columns)
    usable = np.flatnonzero([len(e) > 0 for e in edges])
    looked = usable if len(usable) else np.arange(1)  # a column without cuts still has the sums
    width, tries = 1 + max(len(e) for e in edges), profile.split_columns or max(1, int(len(columns) ** 0.5))
    tries = min(tries, len(looked))
    most = max(1, TASK_CELLS // len(columns))
    total, sizes = sum(blocks.sizes), np.asarray(blocks.sizes)
    weight = np.asarray([total / 2 / max(blocks.labels[v], 1) for v in (0, 1)])
    top = _Top(len(named))

    def drawn(tree: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """A tree's rows of a block and how often it has each."""
        n = sizes[block]
        if not profile.bootstrap:
            return np.arange(n), np.ones(n, np.int64)
        draws = np.random.default_rng([seed, named[tree]]).multinomial(total, sizes / total)[block]
        count = np.bincount(np.random.default_rng([seed, named[tree], 1 + block]).integers(0, n, draws), minlength=n)
        rows = np.flatnonzero(count)
        return rows, count[rows]

    def placed(nodes: trees.Nodes, code: np.ndarray, wanted: np.ndarray, block: int, codes: np.ndarray):
        """For each tree: which of the wanted nodes its rows are in, the rows and their counts, without those in none."""
        place = np.full(len(nodes.tree), -1)
        place[wanted] = np.arange(len(wanted))
        for tree in np.unique(nodes.tree[wanted]):
            rows, count = drawn(tree, block)
            at = place[trees.descend(nodes, code, codes, rows, int(tree))]
            yield at[at >= 0], rows[at >= 0], count[at >= 0]

    def cuts(wanted: list[int], begin: int, end: int, first: bool) -> dict[int, tuple[int, trees.Cut]]:
        """The best cuts of nodes by some of the columns in the order in which each node looks at them."""
        if not wanted:
            return {}
        orders = [np.random.default_rng([seed, named[top.rows[i][0]], top.path[i], 0]).permutation(looked)[begin:end] for i in wanted]
        look, (nodes, code), at = np.asarray(orders), top.arrays(edges), np.asarray(wanted)

        def sums(batches):
            for r, y, codes in rows_in(batches):
                for place, rows, count in placed(nodes, code, at, r["block"], codes):
                    if len(rows):
                        own, local = np.unique(place, return_inverse=True)
                        b = count * weight[y[rows]]
                        a = np.where(y[rows] == 1, b, 0.0)
                        seen = look[own][local]
                        yield _summed(r["block"], at[own], local, a, b, lambda j: codes[rows, seen[:, j]], look.shape[1], width)

        found = _cuts(blocks.table, sums, look.shape[1], 0.0, 0.0, first)
        return {i: (int(look[k, found[i].column]), found[i]) for k, i in enumerate(wanted)}

    level, open_, handed = 0, list(range(len(named))), []
    while open_:
        found = cuts(open_, 0, tries, False)
        mixed = [i for i in open_ if 1e-9 * found[i][1].all_b < found[i][1].all_a < (1 - 1e-9) * found[i][1].all_b]
        stuck = [i for i in mixed if found[i][1].column < 0]
        if tries < len(looked):
            found |= cuts(stuck, tries, len(looked), True)
        if level == 0:
            for i in open_:
                top.rows[i][4] = found[i][1].all_a / found[i][1].all_b
        open_ = []
        for i in mixed:
            feature, cut = found[i]
            if cut.column < 0 or (profile.tree_depth is not None and level >= profile.tree_depth):
                continue
            shares = cut.left_a / cut.left_b, (cut.all_a - cut.left_a) / (cut.all_b - cut.left_b)
            for child, n in zip(top.split(i, feature, cut.code, 2.0 * max(cut.gain, 0.0), *shares), (cut.left_n, cut.all_n - cut.left_n)):
                (handed if n <= most else open_).append(child)
        level += 1

    (nodes, code), at = top.arrays(edges), np.asarray(handed, np.int64)
    whole = nodes._replace(value=nodes.value.copy())
    whole.value[at] = 0.0  # other parts have what is below
    own = [top.tree(whole, t) for t in range(len(named))]
    own = [n._replace(tree=np.full(len(n.tree), named[t], np.int32)) for t, n in enumerate(own)]
    _table(spark, [forests.group_row(n, len(columns), False) for n in own]).write.mode("append").parquet(path)
    if not handed:
        return
    ways = {i: top.path_to(nodes, i) for i in handed}
    entropy = {i: (named[top.rows[i][0]], top.path[i]) for i in handed}
    deep = profile.tree_depth

    def rows_of(batches):
        for r, y, codes in rows_in(batches):
            for place, rows, count in placed(nodes, code, at, r["block"], codes):
                order = np.argsort(place, kind="stable")
                for piece in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
                    if len(piece):
                        has = rows[piece]
                        values = {"y": y[has], "count": count[piece].astype(np.int32), "codes": codes[has]}
                        yield pd.DataFrame([{"node": at[place[piece[0]]], "block": r["block"]} | {k: v.tobytes() for k, v in values.items()}])

    kind = code_type(blocks.edges)

    def grown(held: pd.DataFrame) -> pd.DataFrame:
        held, node = held.sort_values("block"), int(held["node"].iloc[0])
        y, count = (np.frombuffer(b"".join(held[c]), k) for c, k in (("y", np.uint8), ("count", np.int32)))
        codes = np.frombuffer(b"".join(held["codes"]), kind).reshape(len(y), -1)
        tree, way = entropy[node]
        left = None if deep is None else deep - (way.bit_length() - 1)
        # a seed of its own for each node
        own = trees.grow_bagged(trees.Binned(edges, codes), y.astype(float), count * weight[y], [tree], (seed << way.bit_length()) + way, left, False, tries)
        begin, place = ways[node]
        begin = trees.Nodes(*[c.copy() for c in begin])
        joined = trees.below(begin, place, own)
        joined = joined._replace(tree=np.full(len(joined.tree), tree, np.int32))
        return forests.group_row(joined, len(columns), False, node + 1, place)

    pieces = blocks.table.mapInPandas(rows_of, "node int, block int, y binary, count binary, codes binary")
    pieces.repartition(len(handed), "node").groupBy("node").applyInPandas(grown, forests.GROUPS).write.mode("append").parquet(path)


def fit_boosted(spark, stored: Stored, columns: Sequence[str], profile, without: int | None = None) -> forests.TreeModel:
    """As :func:`forests.fit_boosted`."""
    columns, blocks = list(columns), stored.blocks(without, profile.bins)
    every = {v: sum(n for (_, label), n in stored.sizes.items() if label == v) for v in (0, 1)}
    if not every[1]:
        raise ValueError("no cases: the positive weight is undefined")
    weight = np.asarray([1.0, every[0] / every[1]])
    edges = [blocks.edges[blocks.columns.index(c)] for c in columns]
    rows_in = blocks.reader(columns)
    usable = np.flatnonzero([len(e) > 0 for e in edges])
    looked = usable if len(usable) else np.arange(1)
    width, shrink = 1 + max(len(e) for e in edges), 1.0
    table, path, kept, done = blocks.table.withColumn("margin", F.lit(None).cast("binary")), None, [], []

    def margin(r, codes: np.ndarray, kept: list) -> np.ndarray:
        """What a row's trees add up to: stored margins and the trees since."""
        total = np.frombuffer(r["margin"]).copy() if r["margin"] is not None else np.zeros(len(codes))
        for nodes, code in kept:
            total += nodes.value[trees.descend(nodes, code, codes, np.arange(len(codes)), 0)]
        return total

    for t in range(profile.rounds):
        top, open_ = _Top(1), [0]
        for level in range(max(1, profile.round_depth)):
            (nodes, code), at, recent = top.arrays(edges), np.asarray(open_), list(kept)

            def sums(batches, nodes=nodes, code=code, at=at, recent=recent):
                place = np.full(len(nodes.tree), -1)
                place[at] = np.arange(len(at))
                for r, y, codes in rows_in(batches):
                    p = 1.0 / (1.0 + np.exp(-margin(r, codes, recent)))
                    here = place[trees.descend(nodes, code, codes, np.arange(len(y)), 0)]
                    rows = np.flatnonzero(here >= 0)
                    if len(rows):
                        own, local = np.unique(here[rows], return_inverse=True)
                        g, h = weight[y[rows]] * (p[rows] - y[rows]), weight[y[rows]] * p[rows] * (1.0 - p[rows])
                        yield _summed(r["block"], at[own], local, g, h, lambda j: codes[rows, looked[j]], len(looked), width)

            found = _cuts(table, sums, len(looked), shrink, 1.0)
            if level == 0:
                top.rows[0][4] = -profile.rate * found[0].all_a / (found[0].all_b + shrink)
            splits = [(i, c) for i, c in sorted(found.items()) if c.column >= 0 and c.gain > 1e-6 and profile.round_depth]
            open_ = []
            for i, c in splits:
                values = -profile.rate * c.left_a / (c.left_b + shrink), -profile.rate * (c.all_a - c.left_a) / (c.all_b - c.left_b + shrink)
                open_ += top.split(i, int(looked[c.column]), c.code, c.gain, *values)
            if not open_:
                break
        kept.append(top.arrays(edges))
        done.append(kept[-1][0]._replace(tree=np.full(len(top.rows), t, np.int32)))
        if len(kept) == ROUNDS_KEPT and t + 1 < profile.rounds:

            def added(batches, recent=tuple(kept)):
                for batch in batches:
                    for r, y, codes in rows_in(iter([batch])):
                        yield pd.DataFrame([{**{c: r[c] for c in ("block", "y", "codes")}, "margin": margin(r, codes, recent).tobytes()}])

            old, path = path, fresh_path(spark, "margins")
            table.mapInPandas(added, table.schema).write.parquet(path)
            table = spark.read.schema(table.schema).parquet(path)
            kept = []
            if old:
                discard(spark, old)
    groups = [forests.group_row(trees.joined(done), len(columns), False)] if done else []
    groups = materialise(_table(spark, groups), "trees")
    if path:
        discard(spark, path)
    return forests.TreeModel(groups, columns, False)
