"""Skewed and NULL-heavy joins, sliced orders and samples against plain computations."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.operators import evaluate
from strataframe.operators.joins import first_per_key, flag_in_keys, left_dim, repeated_keys
from strataframe.operators.sampling import plan_quotas, sample_n
from strataframe.operators.splits import balanced_weights, pos_weight, stratified_folds
from strataframe.plans import ordering
from strataframe.plans.keyfilter import may_hold
from strataframe.plans.spread import attach_groups, left_join


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share key 7, a quarter have none."""
    rows = [(i, 7 if i % 3 == 0 else (None if i % 4 == 1 else i % 50)) for i in range(6_000)]
    return spark.createDataFrame(rows, "id long, k long")


def test_left_join_spreads_hot_and_null_keys(spark, skewed):
    dim = spark.createDataFrame([(k, f"v{k}") for k in range(0, 50, 2)] + [(7, "seven")], "k int, v string")
    plain = {r["id"]: r["v"] for r in skewed.join(dim, "k", "left").collect()}
    joined = left_join(skewed, dim, ["k"], "id", salt_rows=50)
    assert {r["id"]: r["v"] for r in joined.collect()} == plain
    assert joined.count() == 6_000 and set(joined.columns) == {"id", "k", "v"}
    # rows of the hot key leave in many tasks instead of one
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = left_join(skewed, dim, ["k"], "id", salt_rows=50).filter("k = 7").groupBy(F.spark_partition_id()).count()
        assert parts.count() > 4
        none = left_join(skewed, dim, ["k"], "id").filter("k is null").groupBy(F.spark_partition_id()).count()
        assert none.count() > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_semi_and_anti_with_hot_keys(spark, skewed):
    keys = spark.createDataFrame([(7,), (8,), (None,)], "k long")
    want = {r["id"] for r in skewed.filter("k in (7, 8)").collect()}
    assert {r["id"] for r in left_join(skewed, keys, ["k"], "id", salt_rows=50, how="left_semi").collect()} == want
    rest = left_join(skewed, keys, ["k"], "id", salt_rows=50, how="left_anti")
    assert rest.count() == 6_000 - len(want)
    flags = flag_in_keys(skewed, keys, "k", "hit", "id").groupBy("hit").count().collect()
    assert {r["hit"]: r["count"] for r in flags} == {1: len(want), 0: 6_000 - len(want)}


def test_dimension_joins(spark):
    df = spark.createDataFrame([(1, 10, "a"), (2, None, "b")], "id long, k long, g string")
    dim = spark.createDataFrame([(10, "x"), (10, "w"), (None, "n")], "k long, g string")
    assert left_dim(df, dim, "k", "_dim", "id").count() == 3
    one = first_per_key(dim, "k", ["g"])
    assert [tuple(r) for r in one.collect()] == [(10, "w")]
    assert [tuple(r) for r in repeated_keys(dim.filter("k is not null"), ["k"]).collect()] == [(10, 2)]


def md5(seed, i):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


def test_sample_is_the_head_of_the_hash_order(spark, monkeypatch):
    monkeypatch.setattr(ordering, "HASH_DIGITS", 2)
    rows = [(i, "ABC"[i % 3]) for i in range(3_000)]
    df = spark.createDataFrame(rows, "id long, s string")
    quotas = {"A": 137, "B": 5_000, "C": 0}
    for parts in (1, 7):
        got = {r["id"] for r in sample_n(df.repartition(parts), "s", quotas, 42, "id").collect()}
        a = sorted((i for i, s in rows if s == "A"), key=lambda i: md5(42, i))[:137]
        assert got == set(a) | {i for i, s in rows if s == "B"}
    other = {r["id"] for r in sample_n(df, "s", {"A": 137}, 43, "id").collect()}
    assert len(other) == 137 and other != set(a)


def test_quotas_round_half_to_even():
    assert plan_quotas({"A": 100, "B": 100, "C": 100}, 3) == {"A": 12, "B": 10, "C": 8}
    assert plan_quotas({"A": 10**6, "B": 10**6, "C": 10**6}, 15) == {"A": 60, "B": 52, "C": 38}
    assert plan_quotas({"A": 1, "B": 0, "C": 3}, 3) == {"A": 1, "B": 0, "C": 3}


def test_folds_are_balanced_and_stable(spark):
    df = spark.createDataFrame([(i, int(i % 11 == 0)) for i in range(1_003)], "id long, label int")
    folds = stratified_folds(df.repartition(5), "label", 5, 42, "id")
    again = stratified_folds(df.coalesce(1), "label", 5, 42, "id")
    assert sorted(map(tuple, folds.select("id", "fold").collect())) == sorted(map(tuple, again.select("id", "fold").collect()))
    sizes = folds.groupBy("label", "fold").count().collect()
    for label in (0, 1):
        counts = [r["count"] for r in sizes if r["label"] == label]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_class_weights(spark):
    df = spark.createDataFrame([(i, int(i < 10)) for i in range(50)], "id long, label int")
    weights = balanced_weights(df, "label")
    assert weights.agg(F.sum("weight")).first()[0] == pytest.approx(50.0)
    assert {r["weight"] for r in pos_weight(df, "label").filter("label = 1").collect()} == {4.0}
    with pytest.raises(Exception, match="no cases"):
        pos_weight(df.withColumn("label", F.lit(0) * F.col("label")), "label").collect()


def test_running_totals_next_values_and_quantiles(spark):
    rng = random.Random(5)
    # most values sit close together, so slice edges must follow the data
    rows = [(g, round(rng.random() * (1e-3 if rng.random() < 0.9 else 1e3), 6), rng.randrange(1, 5)) for g in "xy" for _ in range(2_000)]
    merged = {}
    for g, v, n in rows:
        merged[g, v] = merged.get((g, v), 0) + n
    df = spark.createDataFrame([(g, v, n) for (g, v), n in merged.items()], "g string, v double, n long")
    up = {(r["g"], r["v"]): r["s"] for r in ordering.running_totals(df, ["g"], "v", {"n": "s"}).collect()}
    down = {(r["g"], r["v"]): r["s"] for r in ordering.running_totals(df, ["g"], "v", {"n": "s"}, descending=True).collect()}
    after = {(r["g"], r["v"]): r["m"] for r in ordering.next_values(df, ["g"], "v", {"n": "m"}).collect()}
    probs = {"q10": 0.1, "q50": 0.5, "q99": 0.99}
    quantiles = {r["g"]: r for r in ordering.exact_quantiles(df, ["g"], "v", probs).collect()}
    for g in "xy":
        keys = sorted(v for h, v in merged if h == g)
        ns = [merged[g, v] for v in keys]
        total = np.cumsum(ns)
        assert [up[g, v] for v in keys] == list(total)
        assert [down[g, v] for v in keys] == list(total[-1] - total + ns)
        assert [after[g, v] for v in keys] == [*ns[1:], None]
        flat = np.repeat(keys, ns)
        for name, p in probs.items():
            assert quantiles[g][name] == pytest.approx(np.quantile(flat, p), abs=1e-12)


def test_slices_and_null_groups(spark):
    """Many slices, values far apart, and a NULL group next to others: sums, totals and followers stay exact."""
    rng = random.Random(8)
    merged = {}
    for g in ("x", None):
        for _ in range(1_500):
            v = round(rng.random() * (1e-3 if rng.random() < 0.9 else 1e3), 6)
            merged[g, v] = merged.get((g, v), 0) + rng.randrange(1, 5)
    df = spark.createDataFrame([(g, v, n) for (g, v), n in merged.items()], "g string, v double, n long")
    edges = ordering.slice_edges(df, "v", 100)
    assert len(edges) > 10 and ordering.slice_edges(df, "v") == []
    rows = ordering.running_totals(df, ["g"], "v", {"n": "s"}, totals={"n": "all"}, edges=edges).collect()
    assert all(r["all"] == sum(n for (g, _), n in merged.items() if g == r["g"]) for r in rows)
    up = {(r["g"], r["v"]): r["s"] for r in rows}
    after = {(r["g"], r["v"]): r["m"] for r in ordering.next_values(df, ["g"], "v", {"n": "m"}, edges=edges).collect()}
    for g in ("x", None):
        keys = sorted(v for h, v in merged if h == g)
        ns = [merged[g, v] for v in keys]
        assert [up[g, v] for v in keys] == list(np.cumsum(ns))
        assert [after[g, v] for v in keys] == [*ns[1:], None]


def test_no_exchange_is_on_the_group_alone_but_for_slice_totals(spark):
    df = spark.createDataFrame([("x", float(i), 1) for i in range(500)], "g string, v double, n long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ordering.running_totals(df, ["g"], "v", {"n": "s"}, totals={"n": "all"}, edges=[100.0, 200.0])
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by = [line for line in text.splitlines() if "hashpartitioning(" in line]
    assert sum("_slice" not in line for line in by) == 1, text


def test_null_labels_and_groups_are_kept(spark):
    rows = [(i, None if i % 5 == 0 else i % 2) for i in range(50)]
    folds = stratified_folds(spark.createDataFrame(rows, "stay_id long, label int"), "label", 5, 42, "stay_id")
    assert folds.count() == 50 and folds.filter("label is null").select("fold").distinct().count() == 5
    scored = spark.createDataFrame([(g, i % 2, i / 10) for g in ("a", None) for i in range(10)], "m string, label int, prob double")
    assert evaluate.metrics(scored, ["m"]).count() == evaluate.confusion(scored, 0.5, ["m"]).count() == 2
    assert evaluate.decision_curve(scored, ["m"]).filter("m is null and model is not null").count() == 200


def test_group_rows_are_attached_over_salts(spark):
    rows = spark.createDataFrame([(g, i) for g in ("a", None, "b") for i in range(100)], "g string, v long")
    groups = spark.createDataFrame([("a", 1), (None, 2)], "g string, k int")
    got = attach_groups(rows, groups, ["g"], "v", salts=7)
    assert sorted((r["g"] or "", r["v"], r["k"]) for r in got.collect()) == sorted(
        [("a", i, 1) for i in range(100)] + [("", i, 2) for i in range(100)]
    )


@pytest.mark.parametrize("parts", [1, 6])
def test_range_ranks_equal_sorting(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [(None if g == 3 else int(g), f"{w:03d}é", i) for i, (g, w) in enumerate(zip(rng.integers(0, 4, 400), rng.integers(0, 300, 400)))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "g int, w string, i long").repartition(parts)
        got = {r["i"]: r["at"] for r in ordering.range_rank(df, ["g"], [F.col("w").desc(), F.col("i")], "at").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for group in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == group), key=lambda r: r[2])
        mine.sort(key=lambda r: r[1], reverse=True)
        want |= {r[2]: k for k, r in enumerate(mine, 1)}
    assert got == want
    assert ordering.range_rank(df.limit(0), ["g"], [F.col("w")], "at").count() == 0


@pytest.mark.parametrize("bits", [1 << 10, 1 << 26])
def test_key_filter_loses_no_row(spark, bits):
    """Every row with a chosen key stays, few others do where the filter is large enough, and NULL keys go."""
    wide = spark.range(40_000).select("id", (F.col("id") % 20_000).cast("int").alias("k"), F.when(F.col("id") % 9 > 0, F.col("id") % 7).alias("g"))
    keys = spark.range(0, 20_000, 20).select(F.col("id").alias("k"), (F.col("id") % 7).alias("g")).unionByName(
        spark.createDataFrame([(None, 1), (5, None)], "k long, g long")
    )
    exact = {r["id"] for r in wide.join(keys, ["k", "g"], "left_semi").collect()}
    kept = {r["id"] for r in may_hold(wide, keys, ["k", "g"], bits).collect()}
    assert exact <= kept and wide.filter("g is null and id in (%s)" % ",".join(map(str, sorted(kept)[:5000]))).count() == 0
    if bits > 1 << 20:
        assert len(kept - exact) < 0.05 * 40_000
    assert may_hold(wide, keys.limit(0), ["k"]).count() == 0
    assert may_hold(wide.limit(0), keys, ["k"]).count() == 0


def test_key_filter_comes_before_the_only_exchange(spark):
    """Keys too many to broadcast: the wide table is exchanged once, by the join, after the filter."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = spark.range(5_000).select(F.col("id").alias("k"), F.repeat(F.lit("text"), 10).alias("wide"))
        keys = spark.range(0, 5_000, 50).select(F.col("id").alias("k"))
        thin = may_hold(wide, keys, ["k"])
        main = lambda df: df._jdf.queryExecution().executedPlan().treeString().split("Subquery")[0]
        assert "Exchange" not in main(thin) and 100 <= thin.count() < 300
        joined = thin.join(keys, "k")
        assert joined.count() == 100
        plan = joined._jdf.queryExecution().executedPlan().toString()
        wide_side = plan[: plan.index("Subquery")] if "Subquery" in plan else plan
        assert wide_side.count("Exchange") == 1 and wide_side.index("Exchange") < wide_side.index("Filter")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_external_strata_join_a_flag_and_not_the_text(spark, tmp_path):
    """The keyword is looked up before visits meet their times; strata are those of the whole texts, also of repeated ids."""
    from dataclasses import replace

    from strataframe.functions.text import has_keyword
    from suite.views import VISIT_SPEC, visits

    texts = ["the License of it", "nothing", None, "a PASSWORD " * 50, "e-mail", ""]
    documents = [(i, texts[i % 6], f"src{i % 9}", ("en", "de", "fr", None)[i % 4], 40 + i % 50) for i in range(120)]
    documents += documents[:10]
    spark.createDataFrame(documents, "doc_id long, text string, source string, lang string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(150).selectExpr("id as event_id", "timestamp_seconds(id) as ts").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(120).selectExpr("id as doc_id", "int(id % 2) as quality", "int(id % 3) as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    spark.range(60).selectExpr("id as conv_id", "'assistant' as role", "int(id % 9) as turn").write.parquet(f"{tmp_path}/conversations.parquet")
    tables = visits(spark, str(tmp_path))
    assert dict(tables.marked(lambda c: has_keyword(c, VISIT_SPEC.keywords)).dtypes)["CC"] == "boolean"
    found = sorted(map(tuple, tables.strata(VISIT_SPEC).collect()))
    assert found == sorted(map(tuple, replace(tables, marked=None).strata(VISIT_SPEC).collect()))
    assert len(found) >= 130 and len({stratum for _, stratum in found}) > 2


def test_external_rows_move_texts_once(spark, tmp_path):
    """Visits meet their times without their texts, which pass one exchange; the rows are those of joins with texts, also
    of repeated ids, of ids whose rows differ in the text alone, and of absent texts and languages."""
    import json
    from dataclasses import replace

    from suite.views import VISIT_SPEC, visits

    texts = ["some text", None, "another", ""]
    documents = [(i, texts[i % 4], f"src{i % 9}", ("en", None)[i % 2], 40 + i % 50) for i in range(80)]
    documents += documents[:10] + [(3, "in another text alone", "src3", None, 43), (5, texts[1], "src0", "en", 47)]
    spark.createDataFrame(documents, "doc_id long, text string, source string, lang string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(70).selectExpr("id % 60 as event_id", "timestamp_seconds(id) as ts").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(9).selectExpr("id as doc_id", "1 as quality", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    spark.range(9).selectExpr("id as conv_id", "'user' as role", "1 as turn").write.parquet(f"{tmp_path}/conversations.parquet")
    tables = visits(spark, str(tmp_path))
    chosen = spark.createDataFrame([(i, i % 2) for i in [*range(75), 7, 8]], "stay_id long, ie_label int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide, plain = (t.rows(VISIT_SPEC, chosen) for t in (tables, replace(tables, apart=None)))
        assert wide.dtypes == plain.dtypes
        found = sorted(map(repr, wide.collect()))
        assert found == sorted(map(repr, plain.collect())) and len(found) > 90

        def exchanged(node):
            own = [json.loads(node.schema().json())] if node.nodeName() == "Exchange" else []
            children = node.children()
            return own + [m for i in range(children.size()) for m in exchanged(children.apply(i))]

        moved = [{f["name"]: f["type"] for f in m["fields"]} for m in exchanged(wide._jdf.queryExecution().executedPlan())]
        assert len(moved) > 4 and sum("string" in (m.get("text"), m.get("chiefcomplaint")) for m in moved) == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_measurements_lose_other_stays_before_they_are_grouped(spark):
    """The key filter reaches the rows that measurements are grouped from; pairs that differ in the subject still go."""
    from strataframe.operators.cohort import HospitalTables, StudySpec

    stays = spark.createDataFrame([(i % 40, i, i, "F", "WHITE") for i in range(200)], "subject_id long, stay_id long, hadm_id long, gender string, race string")
    raw = spark.createDataFrame([(i % 40 + (i == 10), i, float(v)) for i in range(200) for v in (1, 2)], "subject_id long, stay_id long, x double")
    measured = raw.groupBy("stay_id").agg(F.max("subject_id").alias("subject_id"), F.max("x").alias("heartrate"))
    people = spark.range(40).selectExpr("id as subject_id", "'M' as gender", "30.0 as anchor_age")
    admissions = spark.range(200).selectExpr("id as hadm_id", "'ASIAN' as race")
    tables = HospitalTables(stays, measured, people, admissions, stays)
    chosen = spark.range(0, 200, 10).selectExpr("id as stay_id", "1 as ie_label")
    rows = tables.rows(StudySpec(), chosen)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    grouped = plan[plan.index("max(x#") :]
    assert "getbit" in grouped[: grouped.index("LogicalRDD")]
    assert {r["stay_id"]: r["heartrate"] for r in rows.collect()} == {i: None if i == 10 else 2.0 for i in range(0, 200, 10)}


def test_key_filter_words_keep_their_order_over_parts(spark):
    """Words that are ordered in several parts: no key is lost, and few others stay."""
    keys = spark.range(0, 400_000, 20).select(F.col("id").alias("k"))
    kept = may_hold(spark.range(400_000).select(F.col("id").alias("k")), keys, ["k"])
    assert kept.join(keys, "k", "left_semi").count() == 20_000 and kept.count() < 20_000 * 1.4
