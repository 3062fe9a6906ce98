"""Classifier fits, cross-validation, external validation and importances."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strataframe.functions.casts import fill_features
from strataframe.operators import blocks, forests
from strataframe.operators.features import WITHOUT, assemble, check_schema, standardize_vectors
from strataframe.operators.splits import balanced_weights
from strataframe.plans.ledger import Ledger, digest, fingerprint
from strataframe.plans.ordering import next_values, running_totals
from strataframe.plans.storage import fresh_path, materialise

# Model names and seeds of the study.
MODELS = ("LogisticRegression_L1", "RandomForest", "GradientBoostedTrees")
SEED = 42
TOP_FEATURES = 20

_SLOWEST_FIRST = ("GradientBoostedTrees", "RandomForest", "LogisticRegression_L1")
_FITS = 2  # part of a ledger's key: raise it when the same data and profile give other fits

PREDICTIONS = "option string, model string, fold int, stay_id long, label int, prob double"
IMPORTANCES = "option string, model string, fold int, feature string, imp double"


@dataclass(frozen=True)
class Profile:
    """Model sizes; the defaults are the study's, smaller ones serve tests."""

    trees: int = 500
    tree_depth: int | None = None  # grown until pure
    bootstrap: bool = True
    split_columns: int | None = None  # drawn for each split; the root of the columns' number
    rounds: int = 500
    round_depth: int = 6
    rate: float = 0.05
    iterations: int = 5_000
    tolerance: float = 1e-10
    inverse_penalty: float = 1.0
    bins: int = 256


def fit_lr_l1(train: DataFrame, profile: Profile = Profile()) -> Model:
    """L1 logistic regression on all rows, with balanced weights, which add up to the row count."""
    rows = train.count()
    model = LogisticRegression(
        labelCol="label",
        featuresCol="features",
        weightCol="weight",
        elasticNetParam=1.0,
        regParam=1.0 / (profile.inverse_penalty * rows),
        standardization=False,
        maxIter=profile.iterations,
        tol=profile.tolerance,
    ).fit(balanced_weights(train, "label"))
    # read back without its training summary, which holds the session: once that has observed metrics, no task takes it
    path = fresh_path(train.sparkSession, "logistic")
    model.save(path)
    return LogisticRegressionModel.load(path)


def l1_violation(train: DataFrame, model: Model, columns: Sequence[str], profile: Profile = Profile()) -> DataFrame:
    """How far each coefficient is from optimal: ``(feature, violation)``, all 0 at a solution.

    The weighted objective is convex, so a point is its minimum where 0 is a subgradient: the loss's gradient must be
    minus the penalty in the direction of a coefficient that is not 0, and no larger than it where one is. The
    gradient is summed on the executors; ``(intercept)`` is not penalised. ``train`` is what the model was fitted on.
    """
    rows = balanced_weights(train, "label")
    prob = vector_to_array("probability")[1]
    scored = model.transform(rows).select("features", "label", "weight", prob.alias("prob"))
    # two sums with weights that are not negative
    sums = {
        "up": F.col("weight") * F.col("prob"),
        "down": F.col("weight") * (F.col("label") == 1).cast("double"),
    }
    picks = [F.count(F.lit(1)).alias("n")]
    for name, weight in sums.items():
        picks += [F.sum(weight).alias(f"{name}_n"), Summarizer.mean(F.col("features"), weight).alias(name)]
    s = scored.agg(*picks).first()
    if not s["n"]:
        return train.sparkSession.createDataFrame([], "feature string, violation double")
    weighted = lambda name: s[name].toArray() * s[f"{name}_n"] if s[f"{name}_n"] else np.zeros(len(columns))
    gradient = (weighted("up") - weighted("down")) / s["n"]
    penalty = 1.0 / (profile.inverse_penalty * s["n"])
    beta = model.coefficients.toArray()
    off = np.where(beta == 0, np.maximum(np.abs(gradient) - penalty, 0), np.abs(gradient + penalty * np.sign(beta)))
    found = [*zip(columns, map(float, off)), ("(intercept)", abs(s["up_n"] - s["down_n"]) / s["n"])]
    return train.sparkSession.createDataFrame(found, "feature string, violation double")


def split_gains(
    df: DataFrame, columns: Sequence[str], a: Column, b: Column, shrink: float = 0.0, least: float = 0.0
) -> DataFrame:
    """``(feature, threshold, gain)`` of the best cut of each column, by one aggregate and running sums.

    ``a`` and ``b`` are a row's shares of the sums by which a cut is judged: ``A**2 / (B + shrink)`` of both sides less
    that of all rows, see :mod:`strataframe.functions.trees`. Rows collapse to (column, value) sums, combined
    map-side; running sums over those give the sums left of every cut. Works on all rows, at any number of values.
    Columns with one value have no cut and are left out. Of equal gains the lowest threshold counts.
    """
    names = {f"x{i}": c for i, c in enumerate(columns)}
    shares = df.select(a.cast("double").alias("a"), b.cast("double").alias("b"), *[F.col(f"`{c}`").cast("double").alias(x) for x, c in names.items()])
    long = shares.unpivot(["a", "b"], list(names), "feature", "value").filter("value is not null")
    sums = materialise(long.groupBy("feature", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "sums")
    running = running_totals(sums, ["feature"], "value", {"a": "left_a", "b": "left_b"}, totals={"a": "all_a", "b": "all_b"})
    following = next_values(materialise(running, "running"), ["feature"], "value", {"value": "next"})
    part = lambda a, b: a * a / (b + F.lit(shrink))
    left_a, left_b = F.col("left_a"), F.col("left_b")
    right_a, right_b = F.col("all_a") - left_a, F.col("all_b") - left_b
    gain = part(left_a, left_b) + part(right_a, right_b) - part(F.col("all_a"), F.col("all_b"))
    cuts = following.filter(F.col("next").isNotNull() & (left_b >= least) & (right_b >= least) & (left_b > 0) & (right_b > 0))
    named = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])[F.col("feature")]
    found = cuts.select(named.alias("feature"), ((F.col("value") + F.col("next")) / 2).alias("threshold"), gain.alias("gain"))
    best = found.groupBy("feature").agg(F.max(F.struct("gain", (-F.col("threshold")).alias("t"))).alias("m"))
    return best.select("feature", (-F.col("m.t")).alias("threshold"), F.col("m.gain").alias("gain"))


def fit_trees(name: str, train: DataFrame, columns: Sequence[str], profile: Profile = Profile()) -> forests.TreeModel:
    """A forest or boosted trees on all labelled rows of ``train`` (stay_id, label, columns); see
    :mod:`strataframe.operators.forests`."""
    shared = blocks.training_rows(train.withColumn("fold", F.lit(0)), columns)
    return _fit_trees(name, train.sparkSession, shared, columns, profile)


def _fit_trees(name: str, spark, shared, columns: Sequence[str], profile: Profile, without: int | None = None):
    where = blocks if isinstance(shared, blocks.Stored) else forests
    if name == "RandomForest":
        return where.fit_bagged(spark, shared, columns, profile, SEED, without)
    if name == "GradientBoostedTrees":
        return where.fit_boosted(spark, shared, columns, profile, without)
    raise ValueError(f"unknown model {name}")


def score(model, rows: DataFrame, keep: Sequence[str] = ("stay_id", "label")) -> DataFrame:
    if isinstance(model, forests.TreeModel):
        return model.score(rows, keep)
    return model.transform(rows).select(*keep, vector_to_array("probability")[1].alias("prob"))


def importance(model) -> list[float]:
    """Absolute coefficients, or the importance of trees."""
    if isinstance(model, forests.TreeModel):
        return model.importance()
    return [abs(float(v)) for v in model.coefficients.toArray()]


def cross_validate(
    df: DataFrame,
    options: Mapping[str, Sequence[str]],
    models: Sequence[str] = MODELS,
    folds: int = 5,
    profile: Profile = Profile(),
    parallel: int | None = None,
    ledger: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions ``(option, model, fold, stay_id, label, prob)`` and importances
    ``(option, model, fold, feature, imp)`` of every option x model x fold.

    ``df`` carries ``stay_id, label, fold`` and the feature columns. With a column ``without`` (see
    :func:`strataframe.operators.matrix.feature_table`) it holds every row once for each fold, and a fold is fitted and
    scored on the rows whose imputers and components were fitted without it. Every fit commits what it found to a ledger,
    below ``ledger`` or in shared storage, under a key made of the rows, the profile, the option's columns, the model
    and the fold. Fits that are there already are not made again, so a run that was killed goes on where it stopped.
    As many fits run at once as there are cores (or ``parallel``), those that take longest first. Every fit takes
    all rows outside its fold, and every row is scored.
    """
    spark = df.sparkSession
    union = list(dict.fromkeys(c for columns in options.values() for c in columns))
    scoped = [WITHOUT] if WITHOUT in df.columns else []
    rows = materialise(fill_features(df, union).select("stay_id", "label", "fold", *scoped, *[f"`{c}`" for c in union]), "rows")
    book = Ledger(spark, digest([fingerprint(rows), asdict(profile), SEED, _FITS]), ledger)
    entries = {
        (option, model, fold): f"{option}-{digest(list(columns))}/{model}/fold-{fold}"
        for model in sorted(models, key=_SLOWEST_FIRST.index)
        for option, columns in options.items()
        for fold in range(folds)
    }
    missing = [key for key, entry in entries.items() if not book.has(entry, "importances")]
    vectors = {
        option: materialise(assemble(rows, columns).select("stay_id", "label", "fold", *scoped, "features"), "vectors")
        for option, columns in options.items()
        if any(o == option for o, _, _ in missing)
    }

    def within(table: DataFrame, fold: int) -> DataFrame:
        return table.filter(F.col(WITHOUT) == fold) if scoped else table

    shared = {}  # the rows that trees are fitted on, by fold where their columns differ by fold
    for fold in sorted({f if scoped else 0 for _, model, f in missing if model != "LogisticRegression_L1"}):
        shared[fold] = blocks.training_rows(within(rows, fold), union)

    def run(option: str, name: str, fold: int) -> None:
        held_out, columns = F.col("fold") == fold, options[option]
        vector_rows = within(vectors[option], fold)
        test = vector_rows.filter(held_out)
        if name == "LogisticRegression_L1":
            train, test = standardize_vectors(vector_rows.filter(~held_out), test)
            train = train.persist()
            model = fit_lr_l1(train, profile)
            train.unpersist()
        else:
            model = _fit_trees(name, spark, shared[fold if scoped else 0], columns, profile, fold)
        key = [F.lit(option).alias("option"), F.lit(name).alias("model"), F.lit(fold).alias("fold")]
        found = spark.createDataFrame(list(zip(columns, importance(model))), "feature string, imp double").coalesce(1)
        preds = score(model, test).select(*key, "stay_id", F.col("label").cast("int").alias("label"), "prob")
        book.commit(entries[option, name, fold], {"predictions": preds, "importances": found.select(*key, "feature", "imp")})

    with ThreadPoolExecutor(parallel or spark.sparkContext.defaultParallelism) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(run), *key) for key in missing]
        try:
            for job in jobs:
                job.result()
        except BaseException:
            for job in jobs:
                job.cancel()  # what has not begun stays for the next call
            raise
    return (
        book.read(list(entries.values()), "predictions", PREDICTIONS),
        book.read(list(entries.values()), "importances", IMPORTANCES),
    )


def external_validate(
    train: DataFrame,
    external: DataFrame,
    columns: Sequence[str],
    external_columns: Sequence[str] | None = None,
    model: str = "RandomForest",
    profile: Profile = Profile(),
):
    """Fit on the internal set, score the external one; names must agree in order. Predictions and the model."""
    check_schema(columns, external_columns if external_columns is not None else columns)
    outside = assemble(external, columns).select("stay_id", "label", "features")
    if model != "LogisticRegression_L1":
        trained = fit_trees(model, train, columns, profile)
        return score(trained, outside), trained
    rows = materialise(assemble(train, columns).select("stay_id", "label", "features"), "train")
    fitted, scored = standardize_vectors(rows, outside)
    trained = fit_lr_l1(fitted, profile)
    return score(trained, scored), trained


def cv_importance(imps: DataFrame) -> DataFrame:
    """Mean and population SD of each feature's importance over folds."""
    return imps.groupBy("option", "model", "feature").agg(
        F.avg("imp").alias("mean"), F.stddev_pop("imp").alias("sd")
    )


def top_features(df: DataFrame, n: int = TOP_FEATURES) -> DataFrame:
    """The n most important features per option and model, ties by name."""
    order = W.partitionBy("option", "model").orderBy(F.col("mean").desc(), "feature")  # one row per feature
    return df.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
