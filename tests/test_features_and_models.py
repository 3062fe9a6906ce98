"""Imputation, encoding, PCA and model fits by property and against direct solutions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from strataframe.functions import trees
from strataframe.operators import blocks, features, forests, knn, matrix, models
from strataframe.operators.embed import embed_text, hashing_encoder, pca_fit
from strataframe.operators.evaluate import auroc
from strataframe.operators.knn import knn_impute
from strataframe.plans.ledger import fingerprint
from strataframe.plans.storage import materialise
from suite import ALL_QUERIES, features_and_models
from suite.views import stored_cohort


def distances(a, b):
    total, shared = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        diff = a[:, j, None] - b[None, :, j]
        both = ~np.isnan(diff)
        total += np.where(both, diff * diff, 0.0)
        shared += both
    with np.errstate(all="ignore"):
        return np.sqrt(total / shared * a.shape[1])


def brute_force(x, k):
    out, dist = x.copy(), distances(x, x)
    for i, j in zip(*np.where(np.isnan(x))):
        donors = np.where(~np.isnan(x[:, j]) & ~np.isnan(dist[i]))[0]
        if not len(donors):
            out[i, j] = np.nanmean(x[:, j])
            continue
        best = donors[np.lexsort((x[donors, j], dist[i, donors]))][:k]
        d = dist[i, best]
        w = (d == 0).astype(float) if (d == 0).any() else 1 / d
        out[i, j] = (w * x[best, j]).sum() / w.sum()
    return out


@pytest.mark.parametrize("block", [30, 10**6])
def test_knn_equals_brute_force(spark, block):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(600, 4)) * 3)
    x[rng.random(x.shape) < 0.15] = np.nan
    x[:40] = np.nan  # rows without any value
    x[40:80, 1:] = np.nan
    x[80:280] = [1, 2, np.nan, 4]  # a third of the rows are copies
    cols = list("abcd")
    raw = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(id=range(len(x))))
    df = raw.select("id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in cols])
    got = knn_impute(df, cols, "id", 5, block_tuples=block).orderBy("id").toPandas()
    assert np.array_equal(got["id"], np.arange(len(x)))
    np.testing.assert_allclose(got[cols].to_numpy(float), brute_force(x, 5), rtol=0, atol=1e-12)


def _holed(rows: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(rows, 5)) * 6)
    x[rng.random(x.shape) < 0.12] = np.nan
    return x


@pytest.mark.parametrize("boxes", [1, 4])
def test_knn_over_many_blocks(spark, boxes):
    """Receivers whose neighbours lie in several blocks of several boxes, with more leaves than one."""
    x, cols = _holed(1_500, 5), list("abcde")
    raw = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(id=range(len(x))))
    df = raw.select("id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in cols])
    got = knn_impute(df, cols, "id", 5, block_tuples=50, block_boxes=boxes).orderBy("id").toPandas()
    np.testing.assert_allclose(got[cols].to_numpy(float), brute_force(x, 5), rtol=0, atol=1e-12)


def test_knn_visits_few_blocks(spark, monkeypatch):
    """Rare missing patterns share a block, so a receiver does not visit one block for each of them."""
    stored = {}

    def keep(df, name="table"):
        stored[name] = materialise(df, name)
        return stored[name]

    monkeypatch.setattr(knn, "materialise", keep)
    x, cols = _holed(1_500, 7), list("abcde")
    raw = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(id=range(len(x))))
    df = raw.select("id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in cols])
    knn_impute(df, cols, "id", 5, block_tuples=25).count()
    cells = int(np.isnan(np.unique(x, axis=0)).sum())
    assert stored["tuples"].count() > 60 * 20  # so there are far more boxes than visits
    assert stored["routes"].count() <= 2 * cells


def test_knn_column_without_values_stays_missing(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, 5.0, None)], "id long, a double, b double")
    rows = {r["id"]: (r["a"], r["b"]) for r in knn_impute(df, ["a", "b"], "id").collect()}
    assert rows == {1: (1.0, None), 2: (3.0, None), 3: (5.0, None)}


def test_simple_imputation(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (4.0, None), (9.0, "a"), (None, "b")], "x double, t string")
    assert [r["x"] for r in features.median_impute(df, ["x"]).collect()][-1] == 3.0
    assert [r["t"] for r in features.mode_impute(df, ["t"]).collect()][2] == "a"


def test_encoding_and_alignment(spark):
    df = spark.createDataFrame([("F",), ("M",), (None,)], "gender string")
    hot = features.one_hot_drop_first(df, "gender", features.sorted_levels(df, "gender"))
    assert [r["gender_M"] for r in hot.collect()] == [0.0, 1.0, 0.0] and "gender_F" not in hot.columns
    aligned = features.align_features(hot, ["race_X", "gender_M"])
    assert aligned.columns == ["race_X", "gender_M"] and aligned.agg(F.sum("race_X")).first()[0] == 0.0
    assert features.align_report(["a", "b"], ["b", "c"]) == {"filled": ["c"], "dropped": ["a"]}
    with pytest.raises(ValueError, match="position 1"):
        features.check_schema(["a", "b"], ["a", "c"])
    sets = features.option_columns(["x"], ["k"], pca=2)
    assert sets["Option3_Hybrid"] == ["x", "k", "cc_pca_0", "cc_pca_1"] and sets["Option4_No_CC"] == ["x"]
    assert "Option2_PCA_Embeddings" not in features.option_columns(["x"], ["k"])


def test_standardize_uses_the_training_rows(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    test = spark.createDataFrame([(4.0, 6.0)], "x double, c double")
    a, b = features.standardize(train, test, ["x", "c"])
    assert [tuple(r) for r in a.collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    assert [tuple(r) for r in b.collect()] == [(2.0, 1.0)]
    a, b = (features.assemble(d, ["x", "c"]) for d in (train, test))
    a, b = features.standardize_vectors(a, b, keep=())
    assert [list(r["features"]) for r in a.collect()] == [pytest.approx([-1.0, 0.0]), pytest.approx([1.0, 0.0])]
    # a constant column says nothing: it is 0 everywhere
    assert list(b.first()["features"]) == pytest.approx([2.0, 0.0])


def test_pca_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 4
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, e array<double>")
    model = pca_fit(df, "e", 3)
    got = model.transform(df, "e").orderBy("id").toPandas()[["cc_pca_0", "cc_pca_1", "cc_pca_2"]].to_numpy()
    centred = x - x.mean(axis=0)
    _, sizes, loadings = np.linalg.svd(centred, full_matrices=False)
    want = centred @ loadings[:3].T
    signs = np.sign([row[np.argmax(np.abs(row))] for row in loadings[:3]])
    np.testing.assert_allclose(got, want * signs, atol=1e-9)
    np.testing.assert_allclose(model.explained_variance, (sizes**2 / (sizes**2).sum())[:3], atol=1e-9)


def test_embed_text_holds_few_texts_at_once(spark):
    """Of a batch of 10,000 texts, only those that are encoded next are Python's objects."""

    def encoder():
        import sys

        before = sys.getallocatedblocks()
        return lambda texts: np.full((len(texts), 1), sys.getallocatedblocks() - before)

    texts = spark.range(0, 10_000, 1, 1).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("t"))
    blocks = embed_text(texts, "t", encoder, batch_size=64).select(F.col("embedding")[0].alias("n"))
    assert blocks.count() == 10_000
    assert blocks.agg(F.max("n")).first()[0] < 5_000


def test_embedding_reads_whole_texts(spark):
    df = spark.createDataFrame([("a b a",), (None,), (" ".join(["w"] * 500),)], "t string")
    whole = [np.array(r["embedding"]) for r in embed_text(df, "t", hashing_encoder(16)).collect()]
    assert [v.sum() for v in whole] == [3.0, 0.0, 500.0] and all(len(v) == 16 for v in whole)
    limited = [sum(r["embedding"]) for r in embed_text(df, "t", hashing_encoder(16, max_tokens=64)).collect()]
    assert limited == [3.0, 0.0, 64.0]


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(1)
    label = (rng.random(400) < 0.3).astype(int)
    x = rng.normal(size=(400, 4)) + label[:, None] * [1.5, 0.0, -1.0, 0.0]
    rows = [(i, int(label[i]), i % 5, *map(float, x[i])) for i in range(400)]
    return spark.createDataFrame(rows, "stay_id long, label int, fold int, a double, b double, c double, d double").cache()


def test_l1_logistic_regression_solves_the_weighted_objective(separable):
    cols = ["a", "b", "c", "d"]
    train, _ = features.standardize(separable, separable, cols)
    model = models.fit_lr_l1(features.assemble(train, cols))
    pdf = train.toPandas()
    x, y = pdf[cols].to_numpy(), pdf["label"].to_numpy()
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    beta, b0, step = np.zeros(4), 0.0, 1 / (0.25 * (w[:, None] * x * x).sum() + w.sum())
    for _ in range(40_000):
        residual = w * (1 / (1 + np.exp(-(x @ beta + b0))) - y)
        beta = beta - step * (x.T @ residual)
        beta = np.sign(beta) * np.maximum(np.abs(beta) - step, 0)
        b0 -= step * residual.sum()
    np.testing.assert_allclose(model.coefficients.toArray(), beta, atol=2e-3)
    assert model.intercept == pytest.approx(b0, abs=2e-3)


def test_cross_validation_covers_every_row_once(spark, separable):
    small = models.Profile(trees=25, tree_depth=4, rounds=10, round_depth=3, iterations=50, bins=32)
    options = {"all": ["a", "b", "c", "d"], "noise": ["b", "d"]}
    preds, imps = models.cross_validate(
        separable.withColumn("fold", F.col("fold") % 2), options, folds=2, profile=small
    )
    sizes = preds.groupBy("option", "model").agg(F.count("*").alias("n"), F.countDistinct("stay_id").alias("d")).collect()
    assert len(sizes) == 6 and all(r["n"] == 400 and r["d"] == 400 for r in sizes)
    scores = {(r["option"], r["model"]): r["AUROC"] for r in auroc(preds, ["option", "model"]).collect()}
    assert all(v > 0.8 for (o, _), v in scores.items() if o == "all")
    assert all(v < 0.7 for (o, _), v in scores.items() if o == "noise")
    top = models.top_features(models.cv_importance(imps), 2).filter("option = 'all'").collect()
    assert {r["feature"] for r in top} == {"a", "c"}


SMALL = models.Profile(trees=5, tree_depth=4, rounds=3, round_depth=3, iterations=50, bins=32)


def test_a_killed_cross_validation_goes_on_where_it_stopped(spark, separable, tmp_path, monkeypatch):
    """Only fits that were not committed are made again, also those that left uncommitted tables behind."""
    options = {"all": ["a", "b", "c", "d"]}
    fits = []
    real = models._fit_trees

    def fit(name, spark_, shared, columns, profile, without=None):
        fits.append((name, without))
        if len(fits) == 3:
            raise RuntimeError("executor lost")
        return real(name, spark_, shared, columns, profile, without)

    monkeypatch.setattr(models, "_fit_trees", fit)
    thirds = separable.withColumn("fold", F.col("fold") % 3)
    call = lambda df=thirds: models.cross_validate(df, options, folds=3, profile=SMALL, parallel=1, ledger=str(tmp_path))
    with pytest.raises(RuntimeError, match="executor lost"):
        call()
    committed = {(p.parts[-4], int(p.parts[-3][-1])) for p in tmp_path.glob("*/*/*/*/importances/_SUCCESS")}
    begun = len(fits)  # the fit after the lost one may have begun
    assert committed == set(fits) - {fits[2]} and begun <= 4
    orphan = next(tmp_path.glob("*/*")) / fits[2][0] / f"fold-{fits[2][1]}" / "predictions"  # of a fit that was not committed
    spark.createDataFrame([("all", fits[2][0], fits[2][1], -1, 0, 0.5)], models.PREDICTIONS).write.parquet(str(orphan))
    preds, imps = call()
    assert not committed & set(fits[begun:]) and len(set(fits)) == 6 == len(fits) - 1
    assert preds.count() == 3 * 400 and imps.count() == 9 * 4 and preds.filter("stay_id < 0").isEmpty()
    again = call()
    assert len(fits) == 7 and sorted(again[0].collect()) == sorted(preds.collect())
    assert len(list(tmp_path.glob("*"))) == 1
    del fits[2:]
    with pytest.raises(RuntimeError):
        call(thirds.withColumn("a", F.col("a") + 1))  # other data: nothing of the other entries counts
    assert len(fits) > 2


def test_fits_do_not_depend_on_partitions_or_order(spark, separable, tmp_path):
    found = []
    for i, df in enumerate((separable.repartition(7), separable.orderBy(F.desc("stay_id")).coalesce(1))):
        preds, imps = models.cross_validate(df, {"all": ["a", "b", "c", "d"]}, models.MODELS[1:], profile=SMALL, ledger=f"{tmp_path}/{i}")
        found.append((sorted(preds.collect()), sorted(imps.collect())))
    assert found[0] == found[1]


def test_fingerprints(spark):
    df = spark.createDataFrame([(1, "a", 0.1), (2, None, None), (2, None, None)], "i int, s string, x double")
    base = fingerprint(df)
    assert base == fingerprint(df.repartition(3)) == fingerprint(df.withColumn("x", F.col("x") + 1e-12))
    others = [df.distinct(), df.withColumn("x", F.col("x") + 1e-3), df.withColumnRenamed("s", "t"), df.withColumn("i", F.col("i").cast("long")), df.limit(0)]
    assert len({base, *map(fingerprint, others)}) == 6


def plain_tree(x, y, w):
    """The best first split by trying every value of every column: (column, threshold, decrease of the Gini impurity)."""
    def gini(rows):
        share = (w[rows] * y[rows]).sum() / w[rows].sum()
        return 2 * share * (1 - share) * w[rows].sum()

    best = None
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for a, b in zip(values, values[1:]):
            left = x[:, j] <= (a + b) / 2
            gain = gini(np.ones(len(y), bool)) - gini(left) - gini(~left)
            if best is None or gain > best[2] + 1e-9:
                best = (j, (a + b) / 2, gain)
    return best


@pytest.mark.parametrize("seed", range(5))
def test_first_split_equals_trying_all(seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(60, 3)), 1)
    y, w = (x[:, seed % 3] + rng.normal(size=60) > 0).astype(float), rng.random(60) + 0.5
    nodes = trees.grow_bagged(trees.cut_bins(x, 256), y, w, [0], 1, depth=1, bootstrap=False, tries=3)
    column, threshold, gain = plain_tree(x, y, w)
    assert nodes.feature[0] == column and nodes.threshold[0] == pytest.approx(threshold) and nodes.gain[0] == pytest.approx(gain)


def test_trees_grow_until_pure_and_ensembles_tell_classes_apart():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    y = ((x[:, 1] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    x[:, 4] = 1.0  # constant: never split
    binned = trees.cut_bins(x, 64)
    one = trees.grow_bagged(binned, y, np.ones(300), [7], 1, bootstrap=False)
    assert set(np.round(one.value[one.feature < 0], 9)) == {0.0, 1.0} and 4 not in one.feature
    assert np.array_equal(trees.leaf_values(one, x), y)
    held, truth = rng.normal(size=(400, 5)), None
    truth = (held[:, 1] > 0) ^ (held[:, 3] > 0.5)
    forest = trees.leaf_values(trees.grow_bagged(binned, y, np.ones(300), list(range(40)), 1), held) / 40
    boosted = trees.leaf_values(trees.grow_boosted(binned, y, np.ones(300), 60, 3, 0.1), held)
    assert np.mean((forest > 0.5) == truth) > 0.85 and np.mean((boosted > 0) == truth) > 0.9
    parts = [trees.grow_bagged(binned, y, np.ones(300), t, 1) for t in ([2, 3], [0, 1])]
    assert np.allclose(trees.leaf_values(trees.joined(parts), held), sum(trees.leaf_values(p, held) for p in parts))


def test_first_boosted_round_by_hand():
    x = np.array([[0.0], [0.0], [1.0], [1.0], [1.0], [1.0]] * 4)
    y = np.array([0, 0, 1, 1, 1, 0] * 4, float)
    nodes = trees.grow_boosted(trees.cut_bins(x, 256), y, np.ones(24), 1, 6, 0.05, least=0.5)
    g, h = (0.5 - y), np.full(24, 0.25)
    left = x[:, 0] == 0
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    assert nodes.gain[0] == pytest.approx(part(left) + part(~left) - part(left | ~left))
    assert nodes.value[nodes.left[0]] == pytest.approx(-0.05 * g[left].sum() / (h[left].sum() + 1))


def test_bounded_samples_stand_for_all_rows(spark, separable):
    """Weights of a class add up to what the whole class's would, and the drawn rows are the same each time."""
    sample = forests.draw_sample(separable.repartition(3), ["a", "b"], fit_rows=50)
    again = forests.draw_sample(separable.repartition(5), ["a", "b"], fit_rows=50)
    assert np.array_equal(sample.x, again.x) and sorted(np.bincount(sample.y.astype(int))) == [50, 50]
    x, y, whole = sample.training(["b"], without=2)
    labels = separable.filter("fold <> 2").groupBy("label").count().collect()
    assert whole == {r["label"]: r["count"] for r in labels} and x.shape == (len(y), 1)


@pytest.fixture(scope="module")
def many(spark):
    """12,000 rows of each class, a fold each third row, in 7 partitions."""
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(24_000, 2)), 1)
    y = np.argsort(np.argsort(x[:, 0] + rng.normal(size=24_000))) >= 12_000
    rows = pd.DataFrame({"stay_id": np.arange(24_000), "label": y.astype(int), "fold": np.arange(24_000) % 3, "a": x[:, 0], "b": x[:, 1]})
    return spark.createDataFrame(rows).repartition(7).cache()


@pytest.mark.parametrize("held", [16_000_000, 1_000])
def test_fits_take_every_row(spark, many, monkeypatch, held):
    """The first splits are those of all rows, not of a number of rows of each class; of a fold's training rows as well."""
    monkeypatch.setattr(forests, "HELD_CELLS", held)
    monkeypatch.setattr(blocks, "BLOCK_CELLS", 10_000)  # five blocks
    pdf = many.toPandas()
    stump = models.Profile(trees=1, tree_depth=1, bootstrap=False, split_columns=2, rounds=1, round_depth=1)

    def best(rows, a, b, shrink):
        part = lambda m: a[m].sum() ** 2 / (b[m].sum() + shrink)
        cuts = [(c, v) for c in ("a", "b") for v in np.unique(rows[c])[:-1]]
        return max(part(rows[c] <= v) + part(rows[c] > v) - part(rows[c] == rows[c]) for c, v in cuts)

    def judged(name, rows):
        y = rows["label"].to_numpy()
        if name == "RandomForest":
            w = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum()))
            return 2 * best(rows, w * y, w, 0.0)
        return best(rows, 0.5 - y, np.full(len(y), 0.25), 1.0)

    for name in models.MODELS[1:]:
        assert models.fit_trees(name, many.drop("fold"), ["a", "b"], stump).root()[2] == pytest.approx(judged(name, pdf))
    shared = blocks.training_rows(many, ["a", "b"])
    for name in models.MODELS[1:]:
        root = models._fit_trees(name, spark, shared, ["a", "b"], stump, 2).root()
        assert root[2] == pytest.approx(judged(name, pdf[pdf["fold"] != 2]))


def test_trees_over_blocks_are_those_of_one_task(spark, separable, monkeypatch):
    """Without draws both ways of fitting give the same scores and importances, also of some columns and folds only."""
    cols, some = ["a", "b", "c", "d", "one"], ["c", "one", "a"]
    rows = separable.withColumns({"one": F.lit(1.0), "b": F.round("b")})
    test = features.assemble(rows, some)
    profile = models.Profile(trees=2, tree_depth=4, bootstrap=False, split_columns=3, rounds=5, round_depth=3, bins=64)
    found = []
    monkeypatch.setattr(blocks, "BLOCK_CELLS", 300)
    monkeypatch.setattr(blocks, "TASK_CELLS", 150)
    monkeypatch.setattr(blocks, "ROUNDS_KEPT", 2)
    monkeypatch.setattr(blocks, "HANDED_CELLS", 3_000)  # a tree at a time
    for held in (16_000_000, 100):
        monkeypatch.setattr(forests, "HELD_CELLS", held)
        shared = blocks.training_rows(rows, cols)
        assert isinstance(shared, blocks.Stored) == (held == 100)
        for name in models.MODELS[1:]:
            model = models._fit_trees(name, spark, shared, some, profile, 1)
            scores = {r["stay_id"]: r["prob"] for r in models.score(model, test).collect()}
            found.append(([scores[i] for i in range(400)], model.importance()))
    for one, other in ((0, 2), (1, 3)):
        np.testing.assert_allclose(found[one][0], found[other][0], atol=1e-9)
        np.testing.assert_allclose(found[one][1], found[other][1], atol=1e-9)


def test_forests_over_blocks_grow_until_pure(spark, separable, monkeypatch):
    """Bootstrapped, whatever the partitions; scored in one pass or many, and by cross-validation."""
    cols = ["a", "b", "c", "d"]
    monkeypatch.setattr(forests, "HELD_CELLS", 100)
    monkeypatch.setattr(blocks, "BLOCK_CELLS", 400)
    monkeypatch.setattr(blocks, "TASK_CELLS", 200)
    profile = models.Profile(trees=12, rounds=5, round_depth=2, iterations=50)
    found = []
    for df, size in ((separable.repartition(7), 10**9), (separable.coalesce(1), 3_000)):
        model = models.fit_trees("RandomForest", df.drop("fold"), cols, profile)
        monkeypatch.setattr(forests, "PASS_BYTES", size)
        assert (len(model._passes()) == 1) == (size == 10**9)
        found.append(sorted(models.score(model, features.assemble(separable, cols)).collect()))
        assert sum(model.importance()) == pytest.approx(1.0)
    assert found[0] == found[1]
    assert np.mean([(r["prob"] > 0.5) == (r["label"] == 1) for r in found[0]]) > 0.97
    pure = models.fit_trees("RandomForest", separable.drop("fold"), cols, models.Profile(trees=1, bootstrap=False))
    assert all(r["prob"] == pytest.approx(r["label"], abs=1e-9) for r in models.score(pure, features.assemble(separable, cols)).collect())
    preds, imps = models.cross_validate(separable.withColumn("fold", F.col("fold") % 2), {"all": cols}, models.MODELS[1:], 2, profile)
    assert preds.count() == 800 and preds.select("stay_id", "model").distinct().count() == 800 and imps.count() == 16
    assert min(r["AUROC"] for r in auroc(preds, ["model"]).collect()) > 0.75


@pytest.mark.parametrize("bins", [7, 64])
def test_bin_edges_over_blocks(spark, bins):
    rng = np.random.default_rng(bins)
    x = np.column_stack([rng.normal(size=500), np.round(rng.normal(size=500), 1), np.ones(500), rng.integers(0, bins, 500)])
    rows = spark.createDataFrame(pd.DataFrame(x, columns=["p", "q", "r", "s"])).repartition(3)
    for found, edges in zip(blocks.bin_edges(rows, ["p", "q", "r", "s"], bins), trees.cut_bins(x, bins).edges):
        np.testing.assert_array_equal(found, edges)


def test_auroc_properties(separable):
    scores = separable.withColumn("prob", F.round(F.col("a") - F.col("c"), 1))
    area = auroc(scores).first()[0]
    same = auroc(scores.withColumn("prob", F.exp("prob"))).first()[0]
    flipped = auroc(scores.withColumn("prob", -F.col("prob"))).first()[0]
    assert area == pytest.approx(same) and flipped == pytest.approx(1 - area)
    assert auroc(scores.filter("label = 1")).first()[0] is None


def test_sparse_features_equal_columns(spark):
    rows = [(i, None if i % 7 == 0 else f"l{i % 5}", "one", float(i % 3) if i % 4 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, c string, same string, x double")
    levels = features.sorted_levels(df, "c")
    dense = ["x", *features.one_hot_names("c", levels)]
    columns = features.assemble(features.one_hot_drop_first(df, "c", levels), dense)
    want = {r["id"]: r["features"].toArray().tolist() for r in columns.collect()}
    wide = {"c": features.level_table(df, "c"), "same": features.level_table(df, "same")}
    got = features.sparse_features(df, ["x"], wide, "id", ["id"])
    assert {r["id"]: r["features"].toArray().tolist() for r in got.collect()} == want
    assert [r["name"] for r in features.feature_names(spark, ["x"], wide).orderBy("pos").collect()] == dense
    cells = got.select("id", F.inline(features.sparse_cells("features"))).collect()
    assert {(r["id"], r["pos"], r["value"]) for r in cells} == {(i, p, v) for i, vs in want.items() for p, v in enumerate(vs) if v}
    # another cohort's rows: levels unknown to the table are all zeros, and its width stays
    other = spark.createDataFrame([(1, "l4", 2.0), (2, "new", None), (3, None, float("nan"))], "id long, c string, x double")
    found = features.sparse_features(other, ["x"], {"c": wide["c"]}, "id", ["id"]).orderBy("id").collect()
    assert [r["features"].toArray().tolist() for r in found] == [[2.0, 0, 0, 0, 1.0], [0] * 5, [0] * 5]
    # no rows, no levels
    empty = {"c": features.level_table(df.limit(0), "c")}
    assert features.sparse_features(df.limit(0), ["x"], empty, "id", ["id"]).count() == 0
    assert features.sparse_features(other, ["x"], empty, "id", ["id"]).first()["features"].size == 1


def test_wide_levels_stay_out_of_the_plan(spark):
    """A column with a level for each row: fitted by the classifier, no level in the plan or the vectors' metadata."""
    n = 20_000
    df = spark.range(n).select("id", F.concat(F.lit("level"), "id").alias("c"), (F.col("id") % 2).cast("double").alias("label"))
    wide = {"c": features.level_table(df, "c")}
    rows = features.sparse_features(df.withColumn("x", F.col("label") * 2), ["x"], wide, "id", ["id", "label"])
    plan = rows._jdf.queryExecution().toString()
    assert "level123" not in plan and len(plan) < 50_000
    assert rows.schema["features"].metadata == {"ml_attr": {"num_attrs": n}}
    assert rows.select(F.inline(features.sparse_cells("features"))).filter("pos > 0").distinct().count() == n - 1
    assert VectorAssembler(inputCols=["features", "label"], outputCol="both").transform(rows).first()["both"].size == n + 1


def test_feature_table_with_a_wide_column(spark):
    """Races as a wide domain give the vectors that a column for each of them gives, inside and outside."""
    inside = stored_cohort(spark, "/root/testdata/sf0.001").withColumnRenamed("ie_label", "label")
    outside = stored_cohort(spark, "/root/testdata/sf0.001", "external").withColumnRenamed("ie_label", "label")
    plain, wide = matrix.feature_table(inside), matrix.feature_table(inside, wide=["race"])
    option = "Option4_No_CC"
    assert "race" in wide.rows.columns and not any(c.startswith("race_") for c in wide.options[option])
    names = [r["name"] for r in wide.names(option).orderBy("pos").collect()]
    assert names == plain.options[option]
    for a, b in ((plain, wide), (matrix.feature_table(outside, like=plain), matrix.feature_table(outside, like=wide))):
        want = {r["stay_id"]: r["features"].toArray().round(9).tolist() for r in features.assemble(a.rows, a.options[option]).collect()}
        assert {r["stay_id"]: r["features"].toArray().round(9).tolist() for r in b.vectors(option).collect()} == want


def test_queries_keep_every_component(spark):
    """100 scores of the complaints in the two sets that hold scores, and the embeddings table at its full width."""
    sf = "/root/testdata/sf0.001"
    names = ALL_QUERIES["f09_assemble"](spark, sf).filter("name like 'cc_pca_%'").select("option", "name").distinct()
    counts = {r["option"]: r["count"] for r in names.groupBy("option").count().collect()}
    assert counts == {"Option2_PCA_Embeddings": 100, "Option3_Hybrid": 100}
    scores = ALL_QUERIES["f05_pca_fit_transform"](spark, sf)
    assert sum(c.startswith("cc_pca_") for c in scores.columns) == 64


def test_queries_fit_the_studys_models():
    used = features_and_models.PROFILE
    assert (used.trees, used.tree_depth, used.rounds, used.round_depth) == (500, None, 500, 6)
    assert (used.iterations, used.bins, used.rate, used.inverse_penalty) == (5_000, 256, 0.05, 1.0)


def test_packed_trees_are_the_same_trees():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4))
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(float)
    binned = trees.cut_bins(x, 16)
    for nodes in (
        trees.grow_bagged(binned, y, np.ones(200), [4, 5, 6], 1),
        trees.grow_boosted(binned, y, np.ones(200), 5, 3, 0.1),
        trees.grow_bagged(binned, np.ones(200), np.ones(200), [0], 1),  # leaves alone
    ):
        again = trees.unpacked(trees.packed(nodes))
        assert len(trees.packed(nodes).cut) + len(trees.packed(nodes).left) == 8 * len(nodes.tree)
        assert np.array_equal(trees.leaf_values(again, x), trees.leaf_values(nodes, x))


def test_a_forest_s_nodes_stay_out_of_the_driver(spark, separable, monkeypatch):
    """Nodes are stored by the tasks that grow them; a model on the driver is a handful of names, whatever its size."""
    from pyspark.sql import DataFrame

    def refuse(self):
        raise AssertionError("nodes were gathered")

    cols = ["a", "b", "c", "d"]
    monkeypatch.setattr(DataFrame, "toPandas", refuse)
    profile = models.Profile(trees=60, rounds=5, round_depth=2)
    for name in models.MODELS[1:]:
        model = models.fit_trees(name, separable.drop("fold"), cols, profile)
        assert not any(isinstance(v, (np.ndarray, trees.Nodes)) for v in vars(model).values())
        monkeypatch.setattr(forests, "BLOCK_ROWS", 50_000)
        whole = models.score(model, features.assemble(separable, cols)).collect()
        monkeypatch.setattr(forests, "BLOCK_ROWS", 70)  # several blocks
        parts = models.score(model, features.assemble(separable, cols)).collect()
        assert len(whole) == 400 and sorted(whole) == sorted(parts)
        right = [(r["prob"] > 0.5) == (r["label"] == 1) for r in whole]
        assert np.mean(right) > 0.8 and sum(models.importance(model)) == pytest.approx(1.0)


def test_names_of_wide_places_spread_the_place_that_every_row_has(spark, tmp_path):
    """The join with names is salted: the dense place, which all vectors hold, is no task's alone; the cells are whole."""
    import re

    rows = [(i, i % 50, float(i % 7), f"{i % 5}-P") for i in range(400)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    found = ALL_QUERIES["f08_wide_levels"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join .*pos#\d+ = pos#\d+.*_salt#", plan)
    got = {(r["o_orderkey"], r["name"]): r["value"] for r in found.collect()}
    customers = sorted({str(c) for _, c, _, _ in rows})
    want = {(k, "o_totalprice"): v for k, _, v, _ in rows if v}
    want |= {(k, f"o_orderpriority_{p}"): 1.0 for k, _, _, p in rows if p != "0-P"}
    want |= {(k, f"customer_{c}"): 1.0 for k, c, _, _ in rows if str(c) != customers[0]}
    assert got == want


def test_logistic_scores_after_the_session_observed_metrics(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import Observation

    seen = Observation()
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    train = spark.range(60).select(F.col("id").alias("stay_id"), (F.col("id") % 2).cast("int").alias("label"), F.col("id").cast("double").alias("x"))
    train = train.withColumn("features", array_to_vector(F.array("x", F.col("x") % 3)))
    scored = models.score(models.fit_lr_l1(train), train)
    assert seen.get["n"] == 5 and scored.filter("prob between 0 and 1").count() == 60
