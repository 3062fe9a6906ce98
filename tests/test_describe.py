"""Report formatting, empty groups and distribution edge cases."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.operators import describe, distributions


def test_cells_round_half_to_even(spark):
    df = spark.createDataFrame([(12.5, 0.15), (13.5, 0.25), (None, None)], "a double, b double")
    got = [tuple(r) for r in df.select(describe.cell("a", 0), describe.cell("b", 1)).collect()]
    assert got == [("12", "0.1"), ("14", "0.2"), ("nan", "nan")]


@pytest.fixture(scope="module")
def cohort(spark):
    rows = [(0, "F", "Missing", 1.0), (0, "M", "White", 2.0), (0, None, "White", None), (1, "M", "Asian", 4.0)]
    return spark.createDataFrame(rows, "ie_label int, gender string, race string, age double")


def test_table_one_layout(cohort):
    rows = [tuple(r)[1:] for r in describe.table_one(cohort, "ie_label", ["gender", "race"], ["age"]).orderBy("pos").collect()]
    assert rows == [
        ("N", "4", "3", "1"),
        ("ie_label", "", "", ""),
        ("  0", "3 (75%)", "3 (100%)", "0 (0%)"),
        ("  1", "1 (25%)", "0 (0%)", "1 (100%)"),
        ("  Missing", "0 (0%)", "0 (0%)", "0 (0%)"),
        ("gender", "", "", ""),
        ("  F", "1 (25%)", "1 (33%)", "0 (0%)"),
        ("  M", "2 (50%)", "1 (33%)", "1 (100%)"),
        ("  Missing", "1 (25%)", "1 (33%)", "0 (0%)"),
        ("race", "", "", ""),  # "Missing" is a level here, so no extra row
        ("  Asian", "1 (25%)", "0 (0%)", "1 (100%)"),
        ("  Missing", "1 (25%)", "1 (33%)", "0 (0%)"),
        ("  White", "2 (50%)", "2 (67%)", "0 (0%)"),
        ("age", "", "", ""),
        ("  Mean (SD)", "2.3 (1.5)", "1.5 (0.7)", "4.0 (nan)"),
        ("  Median [Q1-Q3]", "2.0 [1.5-3.0]", "1.5 [1.2-1.8]", "4.0 [4.0-4.0]"),
        ("  Missing", "1 (25%)", "1 (33%)", "0 (0%)"),
    ]


def test_prevalence_of_nothing(cohort):
    assert tuple(describe.prevalence(cohort.filter("false"), "ie_label").first()) == (0, 0, 0, 0.0)


def test_correlation_with_a_constant_column(spark):
    df = spark.createDataFrame([("g", 1.0, 5.0), ("g", 2.0, 5.0), ("g", None, 5.0)], "g string, a double, b double")
    got = {(r["a"], r["b"]): r["r"] for r in describe.corr_matrix(df, ["a", "b"], "g").collect()}
    assert got[("a", "a")] == pytest.approx(1.0) and got[("a", "b")] is None and len(got) == 4


def test_histogram_and_density_integrate_to_one(spark):
    rng = np.random.default_rng(2)
    values = [("u", float(v)) for v in np.round(rng.normal(50, 9, 800))] + [("v", float(v)) for v in np.round(rng.normal(60, 5, 300))]
    df = spark.createDataFrame(values, "g string, x double")
    bars = distributions.histogram(df, "x", "g").collect()
    for g in "uv":
        mine = [r for r in bars if r["group"] == g]
        assert len(mine) == 30 and sum(r["density"] * (r["right"] - r["left"]) for r in mine) == pytest.approx(1.0)
    curve = distributions.kde(df, ["x"], "g").filter("group = 'u'").orderBy("point").collect()
    xs, ys = np.array([r["x"] for r in curve]), np.array([r["density"] for r in curve])
    data = np.array([v for g, v in values if g == "u"])
    bandwidth = data.std(ddof=1) * len(data) ** -0.2
    want = np.exp(-0.5 * ((xs[:, None] - data) / bandwidth) ** 2).sum(axis=1) / (len(data) * bandwidth * np.sqrt(2 * np.pi))
    np.testing.assert_allclose(ys, want, atol=1e-12)


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([("g", 3.0)] * 4, "g string, x double")
    bars = {r["bin"]: r["n"] for r in distributions.histogram(df, "x", "g", bins=4).collect()}
    assert bars == {0: 0, 1: 0, 2: 4, 3: 0}


def test_box_whiskers(spark):
    df = spark.createDataFrame([("g", float(v)) for v in [1, 2, 3, 4, 5, 100]], "g string, x double")
    box = distributions.box_stats(df, ["x"], "g").first()
    assert (box["q1"], box["median"], box["q3"]) == (2.25, 3.5, 4.75)
    assert (box["whisker_lo"], box["whisker_hi"], box["outliers"]) == (1.0, 5.0, 1)


def test_shares_and_order(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", None), ("b", "y")], "g string, l string")
    got = {(r["g"], r["l"]): r["pct"] for r in describe.group_share(df, "g", "l").collect()}
    assert got == {("a", "x"): 50.0, ("a", "y"): 50.0, ("b", "y"): 100.0}
    assert [r["l"] for r in describe.level_order(df, "l").orderBy("place").collect()] == ["y", "x"]


def test_rows_without_a_group_are_a_group_of_their_own(spark):
    """Histogram, densities, boxes, violins, shares, moments and correlations, each against the same rows under a name."""
    rng = np.random.default_rng(2)
    rows = [(None if i % 3 == 0 else "b", float(v), float(v * (i % 5)), "xy"[i % 2]) for i, v in enumerate(rng.normal(size=90).round(2))]
    schema = "g string, v double, w double, level string"
    gaps, named = spark.createDataFrame(rows, schema), spark.createDataFrame([(r[0] or "a", *r[1:]) for r in rows], schema)
    made = {
        "histogram": lambda d: distributions.histogram(d, "v", "g", 7),
        "kde": lambda d: distributions.kde(d, ["v", "w"], "g", 20),
        "box": lambda d: distributions.box_stats(d, ["v", "w"], "g"),
        "violin": lambda d: distributions.violin_stats(d, ["v"], "g", 20),
        "share": lambda d: describe.group_share(d, "g", "level").withColumnRenamed("g", "group"),
        "moments": lambda d: describe.cont_stats(d, ["v", "w"], "g"),
        "correlation": lambda d: describe.corr_matrix(d, ["v", "w"], "g"),
    }
    for name, make in made.items():
        keep = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.withColumn("group", F.coalesce("group", F.lit("a"))).collect())
        got = keep(make(gaps))
        assert got == keep(make(named)) and len(got) > 0, name


def test_levels_are_ranked_without_a_window_over_them_all(spark):
    words = [(w,) for i, w in enumerate(["é", "a", "B", "b", "aa", "", "z"] * 3 + ["a", "z", "z", None]) for _ in range(1 + i % 2)]
    counts = Counter(w for (w,) in words if w is not None)
    want = [(w, n, i + 1) for i, (w, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0].encode())))]
    got = describe.level_order(spark.createDataFrame(words, "w string"), "w")
    assert sorted(map(tuple, got.select("w", "n", "place").collect()), key=lambda r: r[2]) == want
    table = describe.table_one(spark.createDataFrame([(i % 2, "m" if i % 3 else None, "r%d" % (i % 40), float(i)) for i in range(200)], "ie_label int, gender string, race string, age double"), categorical=["gender", "race"], continuous=["age"])
    places = [r.pos for r in table.orderBy("pos").collect()]
    assert len(places) == len(set(places))
    for plan in (got, table):
        assert "Window" not in plan._jdf.queryExecution().executedPlan().toString().replace("WindowGroupLimit", "") or "partitionBy" not in str(plan)
