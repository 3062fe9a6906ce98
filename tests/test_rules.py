"""NULL, NaN, tie and rounding cases of the column rules."""

import datetime

import pytest
from pyspark.sql import functions as F

from strataframe.functions.casts import c_to_f, fill_features, leading_int, reverse_ordinal, to_num, to_ts
from strataframe.functions.codes import code_in, code_in_any, code_prefix_any, normalize_code
from strataframe.functions.labels import RACE_EXTERNAL, RACE_INTERNAL, RACE_REPORT, map_values, normalize_label
from strataframe.functions.text import COMPLAINT_CATEGORIES, clean_text, has_keyword, keyword_categories
from strataframe.operators.cohort import CASE_CODES, LOOKALIKE_PREFIXES, RISK_PREFIXES
from strataframe.operators.filters import rule_report, store_validated, study_rules, validate
from strataframe.sources import tables
from strataframe.sources.tables import nan_to_null, null_tokens


def values(spark, inputs, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, c {kind}")
    return [r["x"] for r in rows.select("i", expr.alias("x")).orderBy("i").collect()]


def test_code_rules(spark):
    codes = [" I330 ", "i330", "I38", "I381", None, ""]
    assert values(spark, codes, code_in("c", CASE_CODES)) == [True, False, True, False, False, False]
    assert values(spark, codes, code_in("c", CASE_CODES, upper=True)) == [True, True, True, False, False, False]
    assert values(spark, codes, normalize_code("c")) == ["I330", "I330", "I38", "I381", "", ""]
    assert values(spark, ["\ta41.9 \n", "0389", "389", None, ""], code_prefix_any("c", LOOKALIKE_PREFIXES)) == [
        True, True, False, False, False,
    ]
    assert values(spark, ["Z87.891"], code_prefix_any("c", RISK_PREFIXES)) == [False]
    assert values(spark, ["Z87.891"], code_prefix_any("c", RISK_PREFIXES, strip_dots=True)) == [True]
    both = code_in_any([F.col("c"), F.lit("421.1 ")], CASE_CODES)
    assert values(spark, [None, "x"], both) == [True, True]


def test_text_rules(spark):
    assert values(spark, ["Back Pain x", None, "feverish"], has_keyword("c", "fever|back pain")) == [True, False, True]
    texts = ["High FEVER, n/v", "feverish", "", None, "sob and cp", "éfever fever"]
    assert values(spark, texts, keyword_categories("c", COMPLAINT_CATEGORIES)) == [
        ["fever", "nausea_vomiting"], [], [], [], ["chest_pain", "dyspnea"], ["fever"],
    ]
    assert values(spark, ["éfever"], keyword_categories("c", COMPLAINT_CATEGORIES)) == [[]]
    assert values(spark, ["  a b\n", None], clean_text("c")) == ["a b", ""]


def test_label_rules(spark):
    races = [None, " ", "unknown", "white - x", "Black/African", "asian", "LATINO", "DECLINES TO STATE", "PACIFIC"]
    assert values(spark, races, normalize_label("c", RACE_INTERNAL)) == [
        "Missing", "Missing", "Unknown", "White", "Black / African American", "Asian", "Hispanic / Latino", "Other", "Other",
    ]
    assert values(spark, races, normalize_label("c", RACE_EXTERNAL))[7] == "Unknown"
    assert values(spark, [None, "", "Missing", "Unknown", "South Asian", "declined"], normalize_label("c", RACE_REPORT)) == [
        "Other", "Missing", "Missing", "Unknown", "Asian", "Other",
    ]
    assert values(spark, [1, 0, 2, None], map_values("c", {1: "case", 0: "control"}), "int") == ["case", "control", None, None]


def test_coercions(spark):
    assert values(spark, ["3-Urgent", " 2", "x3", "", None, "99999999999"], leading_int("c")) == [3, 2, None, None, None, None]
    assert values(spark, ["1.5", " 2 ", "nan", "1d", "inf", "", None, "-3e2"], to_num("c")) == [
        1.5, 2.0, None, None, None, None, None, -300.0,
    ]
    assert values(spark, ["37.0", "bad"], c_to_f("c")) == [pytest.approx(98.6), None]
    assert values(spark, ["2024-02-30", "2024-02-03 04:05:06"], to_ts("c")) == [None, datetime.datetime(2024, 2, 3, 4, 5, 6)]
    # an imputed half truncates, values beyond the range are held
    assert values(spark, [1.0, 2.5, 5.0, None, 9.0, -3.0], reverse_ordinal("c"), "double") == [4, 2, 0, 2, 0, 4]


def test_missing_values(spark):
    rows = spark.createDataFrame([(float("nan"), "N/A"), (1.0, ""), (float("inf"), "ok")], "x double, t string")
    assert [r["x"] for r in nan_to_null(rows).collect()] == [None, 1.0, float("inf")]
    assert [r["t"] for r in null_tokens(rows, ["t"]).collect()] == [None, None, "ok"]
    assert [r["x"] for r in fill_features(rows, ["x"]).collect()] == [0.0, 1.0, 1.7976931348623157e308]


def test_validation_rules(spark):
    start = datetime.datetime(2024, 1, 1)
    later = datetime.datetime(2024, 1, 2)
    base = dict(ie_label=1, gender="M", anchor_age=50.0, temperature=98.0, heartrate=None, resprate=8.0, o2sat=100.0,
                sbp=250.0, dbp=40.0, acuity=5.0, intime=start, outtime=later)
    changes = [{}, {"gender": None}, {"anchor_age": None}, {"temperature": 94.9}, {"acuity": 6.0}, {"outtime": start},
               {"outtime": None}, {"gender": "X", "acuity": 0.0}]
    schema = ("ie_label int, gender string, anchor_age double, temperature double, heartrate double, resprate double,"
              " o2sat double, sbp double, dbp double, acuity double, intime timestamp_ntz, outtime timestamp_ntz")
    rows = spark.createDataFrame([tuple({**base, **c}.values()) for c in changes], schema)
    assert validate(rows, study_rules()).count() == 1
    report = {r["rule"]: (r["failed"], r["dropped"]) for r in rule_report(rows, study_rules()).collect()}
    assert report["gender"] == (2, 2) and report["acuity"] == (2, 1) and report["stay_order"] == (2, 2)
    assert sum(d for _, d in report.values()) == 7
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    keyed = rows.withColumn("stay_id", F.lit(7)).mapInArrow(seen, f"{schema}, stay_id int")
    stored, stored_report = store_validated(keyed.unionByName(keyed.limit(1)), study_rules(), "stay_id")
    assert stored.count() == 2 and runs.value <= 2 * len(changes)  # each side of the union once
    found = {r["rule"]: (r["failed"], r["dropped"]) for r in stored_report.collect()}
    assert found.pop("repeated_keys") == (1, 0) and found == report
    nothing, none_failed = store_validated(rows.limit(0).withColumn("stay_id", F.lit(7)), study_rules(), "stay_id")
    assert nothing.count() == 0 and all(r["failed"] == r["dropped"] == 0 for r in none_failed.collect())


def test_texts_survive_csv(spark, tmp_path):
    """Quotes, backslashes, line breaks, carriage returns, leading blanks and microseconds come back as written."""
    texts = ['say "hi"', "back\\slash", "two\nlines", "cr\r\nlf", "  blanks  ", 'a,"b\n', "\\", '"', "x\ty", "plain"]
    rows = [(i, t) for i, t in enumerate(texts)]
    cohort = spark.createDataFrame(rows, "stay_id long, chiefcomplaint string").selectExpr(
        "stay_id as subject_id", "stay_id", "stay_id as hadm_id", "timestamp_ntz'2024-01-06 14:07:59.474219' as intime",
        "cast(null as timestamp_ntz) as outtime", "1 as ie_label", "'M' as gender", "50.5D as anchor_age", "'W' as race",
        *[f"98.6D as {c}" for c in ("temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp", "acuity")], "chiefcomplaint",
    )
    tables.write_cohort(cohort, f"{tmp_path}/c", fmt="csv")
    got = tables.read_cohort(spark, f"{tmp_path}/c", fmt="csv")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == sorted(map(tuple, cohort.collect()), key=lambda r: r[1])
