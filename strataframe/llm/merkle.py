"""A Merkle manifest of a dataset: 16-ary trees of row digests kept as postorder append logs, with proofs.

Rows of one source, in id order, are the leaves of its tree; every run of 16 consecutive nodes becomes a node above,
the last run of a level being shorter, until one node is left. The roots of the sources' trees, in the order of their
names, are the leaves of one more tree in the same way.

A tree is stored as the log that appending its leaves one by one would write: a node follows the nodes below it. Where
a node stands needs no index. With ``c(s)`` the nodes that the first ``s`` leaves complete (``s + s // 16 + s // 256
...``), a node whose subtree begins at leaf ``s`` and holds ``k`` nodes stands at ``c(s) + k - 1``.

Builders work on aligned blocks of 4,096 nodes, each a whole subtree, so they need nothing of each other: the first
round turns leaves into block roots, the next round blocks of those, and so on, one round for every three levels.
Proofs go the other way: each round addresses siblings inside a block's stretch of the log and hands the path that all
nodes of the block share down to the round below. No task holds more than one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from strataframe.plans.storage import materialise

ARITY = 16
BLOCK_LEVELS = 3
BLOCK = ARITY**BLOCK_LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

PROOF = "array<struct<before:string,after:string>>"
_OUT_ROWS = 1_000  # of proofs in one batch


def leaf_digest(columns: Sequence[Column | str] = COLUMNS) -> Column:
    """SHA-256 (32 bytes) of the fields: ``-`` for null, else the value's UTF-8 byte count, ``:`` and the value."""
    fields = []
    for c in columns:
        value = (F.col(c) if isinstance(c, str) else c).cast("string")
        fields.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*fields), 256))


def hexed(digest: Column | str) -> Column:
    return F.lower(F.hex(digest))


def width(n: int, level: int) -> int:
    """Nodes on a level of a tree with ``n`` leaves."""
    return -(-n // ARITY**level)


def completed(leaves: int) -> int:
    """Nodes that stand in the log once so many leaves, fewer than all, have been appended."""
    total = 0
    while leaves:
        total += leaves
        leaves //= ARITY
    return total


def position(n: int, level: int, index: int) -> int:
    """Where a node stands in the log of a tree with ``n`` leaves."""
    first = index * ARITY**level
    end = min(first + ARITY**level, n)
    size = sum(-(-end // ARITY**j) - first // ARITY**j for j in range(level + 1))
    return completed(first) + size - 1


def _parent(digests: Sequence[bytes]) -> bytes:
    return hashlib.sha256("".join([d.hex() for d in digests]).encode()).digest()


class BlockBuilder:
    """Appends the nodes of one level in order; what a run completes follows at once, up to the block's root."""

    def __init__(self, n: int, level: int):
        self.n = n
        self.level = level
        self.top = level + BLOCK_LEVELS
        self.runs: list[list[bytes]] = [[] for _ in range(BLOCK_LEVELS)]

    def append(self, index: int, digest: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(level, index, digest) of the node and of all nodes that it completes."""
        level = self.level
        while True:
            yield level, index, digest
            if level == self.top or width(self.n, level) == 1:
                return
            run = self.runs[level - self.level]
            run.append(digest)
            if len(run) < ARITY and index + 1 < width(self.n, level):
                return
            digest = _parent(run)
            run.clear()
            level, index = level + 1, index // ARITY


_LOG = "tree string, n long, block long, level int, index long, position long, digest binary"


def _build_round(nodes: DataFrame, round_: int) -> DataFrame:
    """Log rows of all blocks of ``nodes`` (tree, n, index, digest), which are on level 3 * round. Stored."""
    level = BLOCK_LEVELS * round_

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, builder = None, None
        for batch in batches:
            rows: list[tuple] = []
            for tree, n, block, index, digest in zip(*(batch[c].to_pylist() for c in ("tree", "n", "block", "index", "digest"))):
                if at != (tree, block):
                    at, builder = (tree, block), BlockBuilder(n, level)
                for lv, i, d in builder.append(index, digest):
                    if lv > level or not round_:  # later rounds find their lowest level in the log already
                        rows.append((tree, n, block, lv, i, position(n, lv, i), d))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            columns = zip(*rows) if rows else [()] * len(kinds)
            names = ["tree", "n", "block", "level", "index", "position", "digest"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    blocks = nodes.select("tree", "n", F.expr(f"index div {BLOCK}").alias("block"), "index", "digest")
    ordered = blocks.repartition("tree", "block").sortWithinPartitions("tree", "block", "index")
    return materialise(ordered.mapInArrow(build, _LOG), "log")


def number_leaves(rows: DataFrame, order: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``index`` (from 0) and ``n`` within ``tree``, ascending by ``order`` and then ``ties``. Stored.

    One range sort of the whole table; counts per (partition, tree) become offsets, so no tree is ordered in one task.
    """
    by = ["tree", *order, *ties]
    ranged = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by])
    ordered = ranged.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in by])
    placed = materialise(ordered.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), "ordered")
    counts = placed.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    parts = W.partitionBy("tree").orderBy("_part")  # a row per partition of the table at most
    starts = counts.select(
        "tree", "_part", "_first", F.sum("_n").over(W.partitionBy("tree")).alias("n"),
        F.coalesce(F.sum("_n").over(parts.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
    )
    joined = placed.join(materialise(starts, "starts"), ["tree", "_part"])
    numbered = joined.withColumn("index", F.col("_start") + F.col("_row") - F.col("_first"))
    return materialise(numbered.drop("_part", "_row", "_first", "_start"), "leaves")


@dataclass(frozen=True)
class Forest:
    """Numbered leaves and the logs of their trees, one stored table per round."""

    leaves: DataFrame  # tree, n, index, digest and what was carried along
    logs: list[DataFrame]

    def log(self) -> DataFrame:
        """All nodes: (tree, position, level, index, digest); ordered by position, a tree's rows are its append log."""
        parts = [log.select("tree", "position", "level", "index", "digest") for log in self.logs]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def roots(self) -> DataFrame:
        """(tree, n, digest) of each tree's last node."""
        parts = [log.filter(F.col("n") <= F.pow(F.lit(float(ARITY)), F.col("level"))) for log in self.logs]
        out = parts[0].select("tree", "n", "digest")
        for part in parts[1:]:
            out = out.unionByName(part.select("tree", "n", "digest"))
        return out


def grow(leaves: DataFrame) -> Forest:
    """Build the trees of numbered leaves (tree, n, index, digest), round by round."""
    largest = leaves.agg(F.max("n")).first()[0] or 0
    logs = [_build_round(leaves, 0)]
    while largest > BLOCK ** len(logs):
        level = BLOCK_LEVELS * len(logs)
        nodes = logs[-1].filter((F.col("level") == level) & (F.col("n") > ARITY**level))
        logs.append(_build_round(nodes, len(logs)))
    return Forest(leaves, logs)


def _extract(nodes: DataFrame, log: DataFrame, above: DataFrame, level: int) -> DataFrame:
    """Proofs of ``nodes`` (tree, n, index, digest, carried), which lie on ``level``.

    ``log`` (tree, block, position, digest) holds their blocks with the nodes themselves, ``above`` (tree, block,
    proof, and columns of the block's tree) what is above each block. The three meet by block, the log first.
    """
    carried = nodes.schema["carried"].dataType
    tree_columns = above.drop("tree", "block", "proof").columns
    kinds = {f.name: f.dataType for f in above.schema.fields}
    null = lambda kind: F.lit(None).cast(kind)
    empty = {"n": null("long"), "at": null("long"), "digest": null("binary"), "proof": null(PROOF), "carried": null(carried)}
    empty |= {c: null(kinds[c]) for c in tree_columns}
    layout = ["tree", "block", "kind", *empty]

    def part(kind: int, df: DataFrame, **given: Column) -> DataFrame:
        return df.select("tree", "block", F.lit(kind).alias("kind"), *[given.get(c, e).alias(c) for c, e in empty.items()])

    of_tree = {c: F.col(c) for c in tree_columns}
    nodes = nodes.withColumn("block", F.expr(f"index div {BLOCK}"))
    merged = (
        part(0, above, proof=F.col("proof"), **of_tree)
        .unionByName(part(1, log, at=F.col("position"), digest=F.col("digest")))
        .unionByName(part(2, nodes, n=F.col("n"), at=F.col("index"), digest=F.col("digest"), carried=F.col("carried")))
        .select(*layout)
    )
    ordered = merged.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "at")
    out_type = T.StructType(
        [
            T.StructField("tree", T.StringType()), T.StructField("n", T.LongType()), T.StructField("index", T.LongType()),
            T.StructField("digest", T.BinaryType()), T.StructField("carried", carried),
            T.StructField("proof", T.ArrayType(T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())]))),
            *[T.StructField(c, kinds[c]) for c in tree_columns],
        ]
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None
        for batch in batches:
            trees, blocks, kind = (batch[c].to_pylist() for c in ("tree", "block", "kind"))
            for begin in range(0, len(trees), _OUT_ROWS):
                picked: list[int] = []
                befores, afters, offsets = [], [], [0]
                of = {c: [] for c in tree_columns}
                for row in range(begin, min(begin + _OUT_ROWS, len(trees))):
                    if key != (trees[row], blocks[row]):
                        key, block = (trees[row], blocks[row]), BlockProofs(level)
                    if kind[row] == 0:
                        block.shared = [(p["before"], p["after"]) for p in batch["proof"][row].as_py()]
                        block.of_tree = {c: batch[c][row].as_py() for c in tree_columns}
                    elif kind[row] == 1:
                        block.nodes[batch["at"][row].as_py()] = batch["digest"][row].as_py().hex()
                    else:
                        picked.append(row)
                        for before, after in block.proof(batch["n"][row].as_py(), batch["at"][row].as_py()):
                            befores.append(before)
                            afters.append(after)
                        offsets.append(len(befores))
                        for c in tree_columns:
                            of[c].append(block.of_tree[c])
                if picked:
                    rows = batch.take(pa.array(picked))
                    steps = pa.StructArray.from_arrays([pa.array(befores, pa.string()), pa.array(afters, pa.string())], ["before", "after"])
                    proofs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps)
                    columns = [rows["tree"], rows["n"], rows["at"], rows["digest"], rows["carried"], proofs]
                    columns += [pa.array(of[c], batch[c].type) for c in tree_columns]
                    yield pa.RecordBatch.from_arrays(columns, ["tree", "n", "index", "digest", "carried", "proof", *tree_columns])

    return ordered.mapInArrow(extract, out_type)


class BlockProofs:
    """One block's stretch of the log, its siblings addressed by position."""

    def __init__(self, level: int):
        self.level = level
        self.nodes: dict[int, str] = {}
        self.shared: list[tuple[str, str]] = []
        self.of_tree: dict[str, object] = {}
        self.runs: dict[tuple[int, int], list[str]] = {}

    def proof(self, n: int, index: int) -> list[tuple[str, str]]:
        """The siblings before and after, joined, on each level from the node's to the one below the root."""
        steps = []
        for level in range(self.level, self.level + BLOCK_LEVELS):
            if width(n, level) == 1:
                break
            run, place = divmod(index, ARITY)
            if (level, run) not in self.runs:
                ends = min((run + 1) * ARITY, width(n, level))
                self.runs[level, run] = [self.nodes[position(n, level, i)] for i in range(run * ARITY, ends)]
            digests = self.runs[level, run]
            steps.append(("".join(digests[:place]), "".join(digests[place + 1 :])))
            index = run
        return steps + self.shared


def _prove(forest: Forest, tops: DataFrame) -> DataFrame:
    """Proofs of all leaves; ``tops`` (tree, n, proof, columns of the tree) is what lies above each tree."""
    above, rows = None, None
    for round_ in reversed(range(len(forest.logs))):
        level = BLOCK_LEVELS * round_
        # trees that end in this round: their one block lies below the tree's own top
        ends = (F.col("n") <= BLOCK ** (round_ + 1)) & ((F.col("n") > BLOCK**round_) | F.lit(round_ == 0))
        whole = tops.filter(ends).drop("n").withColumn("block", F.lit(0).cast("long"))
        above = whole if above is None else above.unionByName(whole)
        log = forest.logs[round_].select("tree", "block", "position", "digest")
        if not round_:
            fixed = {"tree", "n", "index", "digest"}
            carried = F.struct(F.lit(1).alias("_"), *[c for c in forest.leaves.columns if c not in fixed])
            return _extract(forest.leaves.select(*sorted(fixed), carried.alias("carried")), log, above, 0)
        nodes = forest.logs[round_ - 1].filter((F.col("level") == level) & (F.col("n") > ARITY**level))
        lowest = nodes.select("tree", F.expr(f"index div {BLOCK}").alias("block"), "position", "digest")
        proved = nodes.select("tree", "n", "index", "digest", F.struct(F.lit(1).alias("_")).alias("carried"))
        rows = _extract(proved, log.unionByName(lowest), above, level)
        above = materialise(rows.select("tree", F.col("index").alias("block"), "proof", *tops.drop("tree", "n", "proof").columns), "above")
    return rows


@dataclass(frozen=True)
class Manifest:
    """The trees of all sources and the tree of their roots."""

    sources: Forest
    top: Forest
    names: list[str]  # of the columns that were carried along, the order first

    def root(self) -> Column:
        """The root of all, hex text; null for an empty table."""
        return self.top.roots().select(hexed("digest").alias("root")).scalar()

    def roots(self) -> DataFrame:
        """(source, n, subroot, root), a row per source."""
        name = F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30))
        rows = self.sources.roots().select(name.alias("source"), "n", hexed("digest").alias("subroot"))
        return rows.withColumn("root", self.root())

    def proofs(self) -> DataFrame:
        """Every row's id and carried columns with ``leaf``, ``proof``, ``subroot`` and ``root``; digests as hex text.

        ``proof`` is an array over levels, from the leaf to the one below the root, of the siblings' digests before
        and after the node, each joined to one text. See :func:`fold`.
        """
        none = F.array().cast(PROOF)
        top = _prove(self.top, self.top.roots().select("tree", "n", none.alias("proof")))
        subroot = hexed("digest").alias("subroot")
        tops = top.select(F.col("carried.name").alias("tree"), F.col("carried.leaves").alias("n"), "proof", subroot)
        rows = _prove(self.sources, materialise(tops, "tops"))
        carried = [F.col(f"carried.c{i}").alias(c) for i, c in enumerate(self.names)]
        return rows.select(*carried, hexed("digest").alias("leaf"), "proof", "subroot").withColumn("root", self.root())


def build_manifest(
    docs: DataFrame,
    columns: Sequence[str] = COLUMNS,
    by: str = "source",
    order: str = "doc_id",
    carry: Mapping[str, Column] | None = None,
) -> Manifest:
    """Digest every row and grow the trees of each ``by``, leaves ascending by ``order``.

    Null sources are a tree of their own, the first one; null ids come first. Rows with equal ids follow their
    digests, so equal rows are leaves of their own and interchangeable. An empty table gives trees without nodes.
    ``carry`` names small columns (expressions on ``docs``) that come back with the proofs, after ``order``.
    Texts, null, empty or very long, are digested where they lie; only digests move.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))
    carried = {order: F.col(order), **(carry or {})}
    slim = docs.select(
        tree.alias("tree"), leaf_digest(columns).alias("digest"), *[e.alias(f"c{i}") for i, e in enumerate(carried.values())]
    )
    sources = grow(number_leaves(materialise(slim, "digests"), ["c0"], ["digest"]))
    roots = sources.roots().select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("n").alias("leaves"), "digest")
    return Manifest(sources, grow(number_leaves(roots, ["name"])), list(carried))


def fold(leaf: Column | str, proof: Column | str) -> Column:
    """The root that a leaf (hex text) and its siblings give."""
    leaf = F.col(leaf) if isinstance(leaf, str) else leaf
    return F.aggregate(proof, leaf, lambda d, step: F.sha2(F.concat(step["before"], d, step["after"]), 256))


def proof_digest(proof: Column | str) -> Column:
    """SHA-256 of all siblings, level by level and left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda s: F.array(s["before"], s["after"]))), ""), 256)
