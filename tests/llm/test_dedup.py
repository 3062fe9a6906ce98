"""Exact and near duplicates against brute force, and on odd rows."""

import collections
import re

import numpy as np
import pytest

from strataframe.llm import bytescan, exact_dedup, minhash
from strataframe.llm.components import components
from tests.llm.conftest import rows_of

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute_components(texts: dict[int, str], width: int, percent: int):
    sets = {}
    for i, text in texts.items():
        words = WORDS.findall((text or "").translate(FOLD))
        few = [tuple(words)] if 0 < len(words) < width else zip(*(words[k:] for k in range(width)))
        sets[i] = frozenset(few)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i in sorted(sets):
        common = collections.Counter(j for s in sets[i] for j in holders[s])
        for j, k in common.items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in sets[i]:
            holders[s].append(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, width, percent):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_components({r.doc_id: r.text for r in docs.collect()}, width, percent)
    got = minhash.near_duplicates(docs, width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_stars_lose_no_link_behind_an_unlinked_hub(spark):
    """A chain in which the smallest id is near the others but linked with few: later centres must find the rest."""
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(200)]
    texts = {0: base}
    for i in range(1, 25):
        words = list(texts[max(0, i - 3)])
        for k in rng.choice(200, 4, replace=False):
            words[k] = f"n{i}x{k}"
        texts[i] = words
    texts = {i: " ".join(w) for i, w in texts.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_components(texts, 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 3, 85).collect()} == want


@pytest.mark.parametrize("percent", [30, 50, 70, 85, 100])
def test_pairs_at_the_threshold_are_found(spark, percent):
    """300 pairs of texts whose sets are just similar enough, at any threshold."""
    rng = np.random.default_rng(percent)
    common = next(n for n in range(1, 400) if 100 * n >= percent * (400 - n))  # of two sets of 200
    rows = []
    for i in range(300):
        shared, own = [f"{i}s{k}" for k in range(common + 2)], [[f"{i}{side}{k}" for k in range(200 - common)] for side in "ab"]
        rows += [(2 * i, " ".join(shared + own[0])), (2 * i + 1, " ".join(shared + own[1]))]
    docs = spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 3, percent).collect()}
    texts = dict(rows)
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in texts.items()}
    linked = [i for i in range(0, 600, 2) if 100 * len(sets[i] & sets[i + 1]) >= percent * len(sets[i] | sets[i + 1])]
    assert len(linked) == 300
    assert np.mean([found[i] == found[i + 1] for i in linked]) >= 0.97
    assert all(found[i] == i for i in range(0, 600, 2))


def test_thresholds_without_a_banding_are_refused(spark):
    with pytest.raises(ValueError, match="no banding"):
        minhash.band_layout(2)
    for percent in (5, 20, 40, 60, 75):
        bands, size = minhash.band_layout(percent)
        assert (1 - (percent / 100) ** size) ** bands <= 1e-4 and bands * size <= 160


def test_near_duplicates_on_odd_rows(odd_docs):
    got = rows_of(minhash.near_duplicates(odd_docs), "doc_id", "n_shingles", "component_id", "kept")
    assert [r for r in got if r[0] in (1, 2, 3, 4, 5, 8)] == [
        (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (8, 1, 8, True)
    ]
    assert [r[2:] for r in got if r[0] in (6, 7)] == [(6, True), (6, False)]
    assert [r[2:] for r in got if r[0] is None] == [(None, True)] * 2
    assert len(got) == 13


def test_near_dedup_keeps_columns_and_one_of_each(odd_docs):
    kept = minhash.near_dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.select("doc_id").collect()) == [0, 0, 1, 3, 4, 5, 6, 8, 9, 10]


def test_rows_that_share_an_id_are_one_node(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j"), (2, "k l m n o p q r s t"), (3, "k l m n o p q r s t")],
        "doc_id long, text string",
    )
    assert rows_of(minhash.near_duplicates(docs, 3, 85), "doc_id", "component_id") == [(1, 1), (2, 1), (2, 1), (3, 1)]


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    a = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 10).astype(np.uint64)]))
    b = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 10).astype(np.uint64)]))
    one, two = minhash.signatures([a, b], 1024)
    assert abs((one == two).mean() - 40 / 60) < 0.12


def test_components_of_long_chains_and_big_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1, i) for i in range(300, 400)] + [(5, 1)]
    links = spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 1 for i in (1, 5, *range(300, 400))}


def test_exact_dedup_on_odd_rows(odd_docs):
    got = rows_of(exact_dedup.dedup_report(odd_docs), "doc_id", "keep_id", "group_size", "kept")
    assert [r for r in got if r[0] in (1, 2, 3, 4, 8)] == [
        (1, 2, 3, False), (2, 2, 3, True), (2, 2, 3, True), (3, 4, 3, False), (4, 4, 3, True), (8, 8, 1, True)
    ]
    assert (None, 4, 3, False) in got
    kept = exact_dedup.exact_dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.select("doc_id").collect()) == [0, 2, 4, 5, 6, 7, 8, 9, 10]


def test_exact_dedup_settles_frequent_and_rare_texts_alike(spark):
    rows = [(i, "Frequent" if i % 3 else f"rare {i // 2}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    winners = exact_dedup.frequent_winners(docs.select("doc_id", exact_dedup.digest("text").alias("text_sha256")))
    assert (2999, 2000) in rows_of(winners, "keep_id", "group_size")
    assert exact_dedup.exact_dedup(docs).count() == len({t for _, t in rows})
    report = exact_dedup.dedup_report(docs)
    assert report.filter("kept").count() == len({t for _, t in rows}) and report.count() == 3000


def test_no_rows(no_docs):
    assert exact_dedup.dedup_report(no_docs).count() == exact_dedup.exact_dedup(no_docs).count() == 0
    assert minhash.near_duplicates(no_docs).count() == minhash.near_dedup(no_docs).count() == 0


def test_word_spans_never_cross_texts():
    import pyarrow as pa

    texts = ["ab", "cd  e", "", None, " f", "g\x0bh"]
    (block,) = bytescan.blocks(pa.array(texts))
    spans = bytescan.words(block)
    found = [(int(t), bytes(block.data[a:b]).decode()) for a, b, t in zip(*spans)]
    assert found == [(0, "ab"), (1, "cd"), (1, "e"), (4, "f"), (5, "g"), (5, "h")]
