"""Merkle manifests: closed-form positions, logs against appending one by one, proofs against brute force, odd rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strataframe.llm import merkle
from tests.llm.conftest import rows_of


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields) -> str:
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def levels(digests: list[str]) -> list[list[str]]:
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def path(tree: list[list[str]], i: int) -> list[tuple[str, str]]:
    steps = []
    for level in tree[:-1]:
        a = i // 16 * 16
        run = level[a : a + 16]
        steps.append(("".join(run[: i - a]), "".join(run[i - a + 1 :])))
        i //= 16
    return steps


def by_source(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    key = lambda s: (s is not None, (s or "").encode())
    return [(s, sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))) for s in sorted(groups, key=key)]


def brute_force(rows):
    """(id, leaf, subroot, root, proof) of every row."""
    groups = [(g, levels([leaf(*r) for r in g])) for _, g in by_source(rows)]
    top = levels([tree[-1][0] for _, tree in groups]) if groups else []
    return [
        (r[0], tree[0][i], tree[-1][0], top[-1][0], path(tree, i) + path(top, s))
        for s, (g, tree) in enumerate(groups)
        for i, r in enumerate(g)
    ]


def postorder(n: int) -> list[tuple[int, int]]:
    """(level, index) in the order in which appending leaves completes nodes."""
    out = []

    def visit(level, i):
        if level:
            for child in range(16 * i, min(16 * i + 16, -(-n // 16 ** (level - 1)))):
                visit(level - 1, child)
        out.append((level, i))

    height = 0
    while 16**height < n:
        height += 1
    visit(height, 0)
    return out


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 32, 33, 255, 256, 257, 273, 4096, 4097, 5000])
def test_positions_in_closed_form(n):
    order = postorder(n)
    assert [merkle.position(n, level, i) for level, i in order] == list(range(len(order)))


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def many_rows():
    rng = random.Random(5)
    sizes = {None: 3, "": 1, "a": 4300, "b": 17, "é": 16, "z": 256, "=": 2, "\U0001f600": 273, **{f"s{i}": rng.randint(1, 40) for i in range(20)}}
    ids = list(range(sum(sizes.values())))
    rng.shuffle(ids)
    return [(ids.pop(), s, rng.choice(["en", None]), i, rng.choice([None, "", f"Text {i} É"])) for s, k in sizes.items() for i in range(k)]


@pytest.fixture(scope="module")
def grown(spark):
    rows = many_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    return rows, merkle.build_manifest(docs, carry={"n": F.col("n_chars")})


def test_proofs_equal_brute_force(grown):
    rows, manifest = grown
    assert len(manifest.sources.logs) == 2 and len(manifest.top.logs) == 1
    got = [
        (r.doc_id, r.leaf, r.subroot, r.root, [(s.before, s.after) for s in r.proof])
        for r in manifest.proofs().select("doc_id", "leaf", "subroot", "root", "proof").collect()
    ]
    assert sorted(got) == sorted(brute_force(rows))
    carried = dict(rows_of(manifest.proofs(), "doc_id", "n"))
    assert carried == {r[0]: r[3] for r in rows}


def test_logs_are_what_appending_writes(grown):
    rows, manifest = grown
    logs = {}
    for r in manifest.sources.log().collect():
        logs.setdefault(r.tree, []).append((r.position, r.level, r["index"], r.digest.hex()))
    for source, group in by_source(rows):
        tree = levels([leaf(*r) for r in group])
        want = [(k, level, i, tree[level][i]) for k, (level, i) in enumerate(postorder(len(group)))]
        assert sorted(logs.pop("" if source is None else f"={source}")) == want
    assert not logs


def test_roots(grown):
    rows, manifest = grown
    groups = by_source(rows)
    subroots = [levels([leaf(*r) for r in g])[-1][0] for _, g in groups]
    want = [(s, len(g), r, levels(subroots)[-1][0]) for (s, g), r in zip(groups, subroots)]
    assert rows_of(manifest.roots(), "source", "n", "subroot", "root") == sorted(want, key=repr)


def test_tampered_rows_do_not_verify(spark, grown):
    rows, manifest = grown
    proofs = manifest.proofs().select("doc_id", "leaf", "root", "proof")
    assert proofs.filter(merkle.fold("leaf", "proof") != F.col("root")).count() == 0
    other = F.when(F.col("doc_id") % 9 == 0, F.sha2(F.col("leaf"), 256)).otherwise(F.col("leaf"))
    bad = proofs.withColumn("seen", other).filter(merkle.fold("seen", "proof") != F.col("root"))
    assert {r.doc_id for r in bad.select("doc_id").collect()} == {r[0] for r in rows if r[0] % 9 == 0}
    digest = {r.doc_id: r.d for r in proofs.select("doc_id", merkle.proof_digest("proof").alias("d")).collect()}
    assert digest == {r[0]: sha("".join(b + a for b, a in r[4])) for r in brute_force(rows)}


def test_rows_in_any_order_and_partitioning_give_the_same_root(spark, grown):
    rows, manifest = grown
    root = manifest.roots().first().root
    shuffled = spark.createDataFrame(rows[::-1], SCHEMA).repartition(3, "n_chars")
    assert merkle.build_manifest(shuffled).roots().first().root == root


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select(*merkle.COLUMNS).collect()]
    got = merkle.build_manifest(odd_docs, carry={"score": F.col("score")}).proofs()
    assert got.columns == ["doc_id", "score", "leaf", "proof", "subroot", "root"]
    found = [(r.doc_id, r.leaf, r.subroot, r.root, [(s.before, s.after) for s in r.proof]) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(brute_force(rows), key=repr)
    nothing = merkle.build_manifest(no_docs)
    assert nothing.proofs().count() == nothing.roots().count() == nothing.sources.log().count() == 0
    one = merkle.build_manifest(odd_docs.filter("doc_id = 8")).proofs().first()
    assert one.leaf == one.subroot == one.root and one.proof == []
