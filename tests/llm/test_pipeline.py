"""Every stage of the pipeline against a brute-force version of it, on what the stage before kept."""

from collections import Counter

import corpus_pipeline
from strataframe.llm import mixing, packing
from strataframe.llm.queries import TOKENIZER
from tests.llm.test_dedup import FOLD, brute_components
from tests.llm.test_mix_and_pack import check_sequences

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "exact_dedup", "minhash_near_dedup", "mixing", "best_fit_packing"]

    rows = {r.doc_id: r for r in docs.collect()}
    kept = stages["quality_classifier"](spark, docs, SF)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    judged = [(i in ids) == bool(q) for i, q in quality.items()]
    assert sum(judged) >= 0.97 * len(judged) and len(ids) < len(rows)

    unique = stages["exact_dedup"](spark, kept, SF)
    assert unique.columns == docs.columns
    best: dict[str, int] = {}
    for i in ids:
        text = (rows[i].text or "").translate(FOLD)
        best[text] = max(best.get(text, -1), i)
    found = unique.collect()
    assert sorted(r.doc_id for r in found) == sorted(best.values())
    assert all(r == rows[r.doc_id] for r in found)

    near = stages["minhash_near_dedup"](spark, unique, SF)
    assert near.columns == docs.columns
    components = brute_components({r.doc_id: r.text for r in found}, 5, 80)
    ids = sorted(i for i, (_, c) in components.items() if i == c)
    assert sorted(r.doc_id for r in near.collect()) == ids

    mixed = stages["mixing"](spark, near, SF)
    assert mixed.columns == docs.columns
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(near).collect()}
    copies = Counter(r.doc_id for r in mixed.collect())
    assert copies == Counter({i: n for i, n in plan.items() if n})

    packed = stages["best_fit_packing"](spark, mixed, SF).collect()
    check_sequences(packed)
    encoder = packing.TextEncoder(TOKENIZER)
    tokens = Counter()
    for r in packed:
        tokens[r.doc_id] += r.length
    assert tokens == Counter({i: n * (len(encoder.encode(rows[i].text or "")) + 1) for i, n in copies.items()})


def test_run_is_all_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert check_sequences(rows) > 0
    again = corpus_pipeline.run(spark, SF).collect()
    place = lambda rows: Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)
    assert place(rows) == place(again)
