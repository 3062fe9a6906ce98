"""Mixing and packing: targets, the curriculum, token ids, gapless sequences, and odd rows."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataframe.llm import mixing, packing
from strataframe.llm.queries import TOKENIZER
from tests.llm.conftest import rows_of

SF = "/root/testdata/sf0.01"


def fill(sizes: list[int], weights: list[float], budget: float, cap: float) -> list[float]:
    """Targets by repeated resharing of what lies above the caps."""
    caps = [cap * s for s in sizes]
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        rest = budget * sum(sizes) - sum(target[i] for i in range(len(sizes)) if i not in open_)
        rate = rest / sum(weights[i] for i in open_)
        over = {i for i in open_ if rate * weights[i] >= caps[i]}
        for i in over or open_:
            target[i] = caps[i] if over else rate * weights[i]
        open_ -= over or open_
    return target


def test_targets_equal_repeated_resharing(spark):
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in rng.integers(0, 2000, 23)] + [0, 0]
    names = [f"s{i:02d}" for i in range(24)] + [None]
    got = mixing.source_targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).collect()
    want = fill(sizes, [(5.0, 2.0, 1.0)[i % 3] for i in range(25)], 1.5, 2.0)
    found = {r.source: r.target for r in got}
    assert [found[n] for n in names] == pytest.approx(want)


def test_sources_come_near_their_targets(spark):
    plan = mixing.mix_plan(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    assert (plan.taken <= 2 * plan["size"]).all()
    by = plan.groupby("source").agg(taken=("taken", "sum"), target=("target", "max"))
    assert ((by.taken - by.target).abs() <= 0.03 * by.target).all()
    assert plan.positions.map(len).equals(plan.copies.astype(int))


def test_due_time_inverts_the_integral(spark):
    schedule = ((0.0, 0.5), (0.25, 2.0), (0.6, 0.0), (1.0, 1.0))
    got = spark.range(101).select((F.col("id") / 100).alias("y")).withColumn("t", mixing.due_time(F.col("y"), mixing._segments(schedule)))
    x = np.linspace(0, 1, 20001)
    w = np.interp(x, *zip(*schedule))
    demand = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(x))])
    for r in got.collect():
        assert np.interp(r.t, x, demand / demand[-1]) == pytest.approx(r.y, abs=1e-6)


def test_mix_follows_the_curriculum(spark):
    """Halfway, a source whose weight falls from 1.5 to 0.5 has had more than half of its words, and so on."""
    plan = mixing.mix_plan(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    place = {s: i % 3 for i, s in enumerate(sorted(plan.source.unique()))}
    for kind, low, high in ((0, 0.59, 0.66), (1, 0.46, 0.54), (2, 0.27, 0.36)):
        rows = plan[plan.source.map(place) == kind]
        early = sum(size * sum(t < 0.5 for t in times) for size, times in zip(rows["size"], rows.positions))
        assert low < early / rows.taken.sum() < high


def test_training_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = {r.doc_id: (r.copies, list(r.positions)) for r in mixing.mix_plan(docs).collect()}
    got = [r.doc_id for r in mixing.training_order(docs).collect()]
    assert Counter(got) == Counter({i: n for i, (n, _) in plan.items() if n})
    seen = Counter()
    times = []
    for i in got:
        times.append(plan[i][1][seen[i]])
        seen[i] += 1
    assert times == sorted(times)


def test_mixing_odd_rows(odd_docs, no_docs):
    plan = mixing.mix_plan(odd_docs)
    assert plan.count() == 13
    assert [r[1:] for r in rows_of(plan, "doc_id", "size") if r[0] in (3, 4, 5)] == [(0,)] * 3
    order = mixing.training_order(odd_docs)
    assert order.columns == odd_docs.columns
    assert order.count() == plan.agg(F.sum("copies")).first()[0]
    assert mixing.mix_plan(no_docs).count() == mixing.training_order(no_docs).count() == 0


TRICKY = [
    "", " ", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n b", "\n\na", "it's we'll I'm 'tis", "x1 22 !? ...", "<|endoftext|> <|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>", "<|endoftext",
    "tab\tand\u00a0nbsp \u2003em", "Été ünïcode \U0001f600\U0001f600", "a\r\nb", "日本語 テキスト", "word\n", "\x1cfs\x1f us",
]


def test_encoder_equals_tokenizers(spark):
    model = Tokenizer.from_file(TOKENIZER)
    texts = TRICKY + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    encoder = packing.TextEncoder(TOKENIZER)
    assert [encoder.encode(t) for t in texts] == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode("a <|endoftext|> b") == [64, 220, 50256, 275]


def test_white_space_beside_other_white_space():
    """Every pair and triple of white space between letters, also where counts of blanks and of words agree."""
    model = Tokenizer.from_file(TOKENIZER)
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    gaps = [a + b for a in spaces for b in spaces] + [f" {a} " for a in spaces]
    texts = ["a\t b", "a\u00a0 b", "a\tb c", "a\x1cb c", *(t for g in gaps for t in (f"a{g}b", f"a{g}", f"{g}b", f"a{g[0]}b c"))]
    encoder = packing.TextEncoder(TOKENIZER)
    assert [encoder.encode(t) for t in texts] == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


def check_sequences(rows, limit=1024):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        place = 0
        for offset, length in sorted(parts):
            assert offset == place
            place += length
        assert place <= limit
    return len(by_sequence)


def test_packed_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack_documents(docs, TOKENIZER).collect()
    n = check_sequences(rows)
    total = sum(r.length for r in rows)
    assert -(-total // 1024) <= n <= 1.02 * total / 1024
    model = Tokenizer.from_file(TOKENIZER)
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for d in docs.collect():
        ids = np.asarray(model.encode(d.text or "", add_special_tokens=False).ids + [2], "<u4")
        place = 0
        for k, (piece, start, length, crc) in enumerate(sorted(pieces.pop(d.doc_id))):
            assert (piece, start) == (k, place) and crc == zlib.crc32(ids[start : start + length].tobytes())
            assert length == 1024 or k == 0
            place += length
        assert place == len(ids)
    assert not pieces


def test_packing_odd_rows(odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, TOKENIZER, with_ids=True).collect()
    check_sequences(rows)
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert sum(r.doc_id == 2 and r.piece == 0 for r in rows) == 2
    assert [(r.piece, r.length) for r in rows if r.doc_id == 3] == [(0, 1)]
    assert packing.pack_documents(no_docs, TOKENIZER).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    limit = int(rng.integers(5, 200))
    counts = np.bincount(rng.integers(1, limit + 1, int(rng.integers(1, 500))), minlength=limit + 1)
    plan = packing.plan_sequences(counts, limit)
    used = Counter()
    for combo, times in plan:
        assert sum(combo) <= limit and times > 0
        for n in combo:
            used[n] += times
    assert used == Counter({n: int(k) for n, k in enumerate(counts) if k})


def test_exact_complements_are_found():
    """A single, a pair and a triple of lengths that each fill a gap exactly, as often as the counts allow."""
    counts = np.zeros(101, np.int64)
    counts[[60, 40, 70, 19, 11, 80, 9, 8, 3, 100]] = [5, 5, 2, 2, 2, 3, 3, 3, 3, 1]
    plan = packing.plan_sequences(counts, 100, spare=0)
    assert sum(times for _, times in plan) == 11 and all(sum(combo) == 100 for combo, _ in plan)


def test_singles_pairs_and_triples_are_all_in_the_plan(spark):
    """On the documents themselves, and near the bound that their tokens set."""
    pieces = packing.token_pieces(spark.read.parquet(f"{SF}/documents.parquet"), TOKENIZER)
    counts = np.zeros(1025, np.int64)
    for r in pieces.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    plan = packing.plan_sequences(counts)
    exact = Counter()
    for combo, times in plan:
        exact[len(combo)] += times * (sum(combo) == 1024)
    assert exact[2] and exact[3] and exact[4]
    bound = -(-int((counts * np.arange(1025)).sum()) // 1024)
    assert sum(times for _, times in plan) <= bound + 2


def test_lengths_out_of_range_are_refused(spark):
    pieces = spark.createDataFrame([(1, 0, 0)], "doc_id long, piece int, length long")
    with pytest.raises(ValueError, match="lengths"):
        packing.pack(pieces, 10)
