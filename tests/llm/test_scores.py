"""Learned scores: held-out accuracy, exact measures against brute force, and odd rows."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataframe.llm import bytescan, labelled, language_nb, quality_mil, quality_rules, queries, toxicity
from tests.llm.conftest import rows_of

SF = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def scored(spark, query, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(label).alias("truth"))
    rows = query(spark, SF).join(labels, "doc_id", "left").toPandas()
    assert len(rows) == 1000 and rows.score.between(0, 1).all()
    return rows


def test_quality_classifier_on_held_out_rows(spark):
    rows = scored(spark, queries.op2, "quality")
    assert ((rows.score >= 0.7) == (rows.predicted == 1)).all()
    held = rows[rows.held_out & rows.truth.notna()]
    assert len(held) > 60 and (held.predicted == held.truth).mean() >= 0.97


def test_toxicity_on_held_out_rows(spark):
    rows = scored(spark, queries.op5, "toxic")
    held = rows[rows.held_out & rows.truth.notna()]
    assert (held.predicted == held.truth).mean() >= 0.92
    assert held[held.truth == 0].predicted.mean() <= 0.03


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = queries.op9(spark, SF).join(docs, "doc_id").toPandas()
    held = rows[rows.held_out]
    assert len(rows) == 1000 and (held.lang == held.lang_pred).mean() >= 0.98 and rows.score.between(0, 1).all()


def test_held_out_rows_do_not_teach(spark):
    """Turning over every held-out label changes no score."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    held = labelled.held_out("doc_id", 4, 2)
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (
        rows_of(docs.select("doc_id", toxicity.toxicity_score(toxicity.fit_toxicity(docs.filter(~held), x.filter(~held)), docs).alias("s")), "doc_id", "s")
        for x in (labels, turned)
    )
    assert one == two


def brute_measures(text):
    text = text or ""
    words = WORDS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_quality_rules_equal_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = queries.op10(spark, SF).collect()
    assert {r.doc_id: tuple(r[n] for n in names) for r in rows} == {i: brute_measures(t) for i, t in texts.items()}
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(r.kept, labels[r.doc_id]) for r in rows if r.doc_id in labels and not r.base_failed]
    assert np.mean([kept == bool(label) for kept, label in judged]) >= 0.97


@pytest.mark.parametrize("text", ["a b a b a b", "a\na\n\n\nb\na", "é é é é", "", " ", "x " * 300, "a b c\na b c\na  b\tc", "\na b", "###"])
def test_measures_of_small_texts(text):
    (block,) = bytescan.blocks(pa.array([text]))
    assert tuple(int(x[0]) for x in quality_rules.measures(block)) == brute_measures(text)


def all_segments(scores):
    """Ruzzo and Tompa's definition: take the best segment, then go on left and right of it."""
    if not scores or max(scores) <= 0:
        return []
    best = max(
        ((sum(scores[i:j]), -(j - i), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), key=lambda t: t[:2]
    )
    return all_segments(scores[: best[2]]) + [best[0]] + all_segments(scores[best[3] :])


def test_segments_equal_their_definition():
    rng = np.random.default_rng(5)
    for _ in range(60):
        scores = [float(x) for x in np.round(rng.normal(-0.2, 1.5, rng.integers(0, 14)), 3)]
        assert np.allclose(toxicity.segments(np.array(scores)), all_segments(scores))


def odd_labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (2, 0, 1), (6, 1, 0), (7, None, None), (None, 1, 1), (8, 0, 1), (8, 1, 0), (9, 1, 0), (10, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_labels_are_cleaned(spark):
    assert rows_of(labelled.clean_labels(odd_labels(spark), "quality"), "doc_id", "label") == [
        (1, 1), (10, 0), (2, 0), (6, 1), (9, 1)
    ]


def test_scores_of_odd_rows(spark, odd_docs):
    labels = odd_labels(spark)
    model = quality_mil.fit_quality(odd_docs, labels)
    quality = rows_of(odd_docs.select("doc_id", quality_mil.quality_score(model, odd_docs).alias("s")), "doc_id", "s")
    tox = toxicity.fit_toxicity(odd_docs, labels)
    toxic = rows_of(odd_docs.select("doc_id", toxicity.toxicity_score(tox, odd_docs).alias("s")), "doc_id", "s")
    for rows in (quality, toxic):
        assert len(rows) == 13 and all(0 <= s <= 1 for _, s in rows)
        by_id = collections.defaultdict(set)
        for i, s in rows:
            by_id[i].add(s)
        assert len(by_id[2]) == 1 and by_id[3] == by_id[4]
    kept = quality_mil.quality_filter(odd_docs, labels)
    assert kept.columns == odd_docs.columns and 1 in [r.doc_id for r in kept.select("doc_id").collect()]
    rules = quality_rules.quality_rules(odd_docs, labels)
    assert rules.count() == 13 and not rules.filter("kept and n_words < 50").count()


def test_languages_of_odd_rows(odd_docs):
    model = language_nb.fit_languages(odd_docs)
    rows = rows_of(odd_docs.select("doc_id", language_nb.predict_language(model, odd_docs).alias("p")).select("doc_id", "p.*"), "doc_id", "lang_pred")
    assert len(rows) == 13
    assert {(3, "und"), (4, "und"), (5, "und"), (10, "en"), (9, "fr")} <= set(rows)


def test_nothing_to_learn(spark, odd_docs, no_docs):
    none = odd_labels(spark).limit(0)
    docs = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert quality_mil.quality_filter(docs, none).count() == 13
    assert quality_mil.fit_quality(no_docs, none).base_rate == 0.5
    tox = toxicity.fit_toxicity(docs, none)
    assert docs.select(toxicity.toxicity_score(tox, docs).alias("s")).distinct().collect()[0].s == pytest.approx(0.5)
    rules = quality_rules.quality_rules(docs, none)
    assert rules.filter(F.col("kept") == F.col("base_failed")).count() == 0
    languages = docs.select(language_nb.predict_language(language_nb.fit_languages(docs), docs).alias("p")).select("p.*").distinct()
    assert [tuple(r) for r in languages.collect()] == [("und", 0.0)]


def test_no_rows(spark, no_docs):
    labels = odd_labels(spark)
    assert quality_mil.quality_filter(no_docs, labels).count() == 0
    assert quality_rules.quality_rules(no_docs, labels).count() == 0
    model = toxicity.fit_toxicity(no_docs, labels)
    assert no_docs.select(toxicity.toxicity_score(model, no_docs)).count() == 0
    assert no_docs.select(language_nb.predict_language(language_nb.fit_languages(no_docs), no_docs)).count() == 0
