"""Counts, descriptive tables and their formatted layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from strataframe.operators.cohort import Cohort, HospitalTables, StudySpec
from strataframe.functions.codes import code_in
from strataframe.operators.joins import flag_in_keys, left
from strataframe.plans.ordering import exact_quantiles, range_rank, value_counts
from strataframe.plans.spread import join_groups
from strataframe.plans.storage import materialise
from strataframe.sources.tables import metric_table

VITALS = ["temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp"]
CATEGORICAL = ["gender", "race"]
CONTINUOUS = ["anchor_age", *VITALS, "acuity"]
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
TOTAL = "Total"


def cell(c: Column | str, digits: int) -> Column:
    """Fixed-point text. A format pattern rounds half to even on the binary value, unlike ``format_string``."""
    value = (F.col(c) if isinstance(c, str) else c).cast("double")
    pattern = "0." + "0" * digits if digits else "0"
    text = F.call_function("format_number", value, F.lit(pattern))
    return F.when(value.isNull() | F.isnan(value), F.lit("nan")).otherwise(text)


# --- counts ---------------------------------------------------------------------------------------


def case_counts(diagnoses: DataFrame, codes: Sequence[str], key: str = "hadm_id") -> DataFrame:
    """Events with a case code, and distinct keys among them."""
    return diagnoses.filter(code_in("icd_code", codes)).agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct(key).alias("keys")
    )


def prevalence(df: DataFrame, label: str) -> DataFrame:
    positive = F.count_if(F.col(label) == 1)
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("total"),
        positive.alias("positive"),
        (total - positive).alias("negative"),
        F.coalesce(F.try_divide(positive * 100.0, total), F.lit(0.0)).alias("rate_pct"),
    )


def availability(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Missing fraction and present percent per column, over all rows and over the positives."""
    absent = {c: F.col(c).isNull().cast("double") for c in columns}
    wide = df.agg(
        *[F.avg(m).alias(f"{c}|all") for c, m in absent.items()],
        *[F.avg(F.when(F.col(label) == 1, m)).alias(f"{c}|positive") for c, m in absent.items()],
    )
    long = wide.unpivot([], [f"{c}|{s}" for c in columns for s in ("all", "positive")], "cell", "missing_frac")
    parts = F.split("cell", r"\|")
    return long.select(
        parts[0].alias("variable"),
        parts[1].alias("scope"),
        "missing_frac",
        (F.lit(100.0) - F.col("missing_frac") * 100.0).alias("present_pct"),
    )


def feasibility(tables: HospitalTables, spec: StudySpec) -> DataFrame:
    """Seven summary metrics on all stays, as text."""
    codes = code_in("icd_code", spec.case_codes, spec.upper_case_codes)
    cases = tables.diagnoses.filter(codes).select("hadm_id")
    stays = tables.stays.select("subject_id", "stay_id", "hadm_id")
    wide = left(stays, tables.measurements, ["subject_id", "stay_id"], "stay_id")
    wide = flag_in_keys(wide, cases, "hadm_id", "label", "stay_id", hot_from=stays)
    total = F.count(F.lit(1))
    positive = F.sum("label")

    def present(c: str) -> Column:
        return F.lit(100.0) - F.avg(F.col(c).isNull().cast("double")) * 100.0

    numbers = wide.agg(
        total.alias("total_ed_stays"),
        positive.alias("ie_ed_stays"),
        (total - positive).alias("non_ie_ed_stays"),
        F.coalesce(F.try_divide(positive * 100.0, total), F.lit(0.0)).alias("ie_rate_pct"),
        present("acuity").alias("esi_collected_pct"),
        present("chiefcomplaint").alias("chief_complaint_present_pct"),
        present("temperature").alias("temp_present_pct"),
    )
    counts = ["total_ed_stays", "ie_ed_stays", "non_ie_ed_stays"]
    shares = [c for c in numbers.columns if c not in counts]
    text = numbers.select(*[F.col(c).cast("string") for c in counts], *[cell(c, 2).alias(c) for c in shares])
    return text.unpivot([], [*counts, *shares], "metric", "value")


def cohort_summary(cohort: Cohort) -> DataFrame:
    """How the controls were drawn, as ``(metric, value)`` text, with the fill count."""
    c = cohort.counts
    pools = cohort.strata.agg(
        F.count_if(F.col("stratum") == "P").alias("cases"),
        *[F.count_if(F.col("stratum") == s).alias(f"pool_{s.lower()}") for s in "ABC"],
    ).withColumn("ratio", F.lit(float(c["controls"])) / F.col("cases"))
    named = pools.withColumn("ratio", F.concat(cell("ratio", 2), F.lit(":1")))
    metrics = {
        "ie_positive_count": F.max("cases"),
        "target_negative_controls": F.lit(c["target"]),
        "selected_negative_controls": F.lit(c["controls"]),
        "final_negative_positive_ratio": F.max("ratio"),
        **{f"stratum_{s}_pool": F.max(f"pool_{s}") for s in "abc"},
        **{f"stratum_{s}_sampled": F.lit(c[f"sampled_{s.upper()}"]) for s in "abc"},
        "fill_sampled": F.lit(c["fill"]),
    }
    return metric_table(named, metrics)


def missing_audit(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing cells per column before and after imputation."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        return wide.unpivot([], list(columns), "variable", name)

    return counted(before, "missing_before").join(counted(after, "missing_after"), "variable")


def category_coverage(df: DataFrame, categories: str, names: Sequence[str]) -> DataFrame:
    """Rows with any category, all rows, and rows per category."""
    wide = df.agg(
        F.count_if(F.size(categories) > 0).alias("any"),
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.array_contains(categories, n)).alias(n) for n in names],
    )
    return wide.unpivot([], ["any", "rows", *names], "category", "n")


# --- table one ------------------------------------------------------------------------------------


def cat_stats(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Level counts for all rows and per label value 0/1; levels come from all rows, so a level absent
    in a group counts 0. The NULL level is the missing count."""
    long = df.select(F.col(label).alias("_label"), *[F.col(c).cast("string").alias(f"_{c}") for c in columns])
    long = long.unpivot(["_label"], [f"_{c}" for c in columns], "variable", "level")
    counts = long.groupBy(F.substring("variable", 2, 1_000).alias("variable"), "level").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("_label") == 0).alias("label_0"),
        F.count_if(F.col("_label") == 1).alias("label_1"),
    )
    # every variable's levels add up to the rows, so the sizes need no window over the levels
    sizes = df.agg(
        F.struct(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col(label) == 0).alias("label_0"),
            F.count_if(F.col(label) == 1).alias("label_1"),
        ).alias("s")
    ).scalar()
    shares = {f"{c}_pct": F.try_divide(F.col(c) * 100.0, F.col("_s")[c]) for c in ("total", "label_0", "label_1")}
    return counts.withColumn("_s", sizes).withColumns(shares).drop("_s")


def grouped_counts(df: DataFrame, columns: Sequence[str], group: str, total: bool) -> DataFrame:
    """(group, variable, value, n), stored; the Total group is added after the rows have collapsed."""
    long = df.select(F.col(group).cast("string").alias("group"), *[F.col(c).cast("double").alias(c) for c in columns])
    counts = value_counts(long.unpivot(["group"], list(columns), "variable", "value"), ["group", "variable"], "value")
    if not total:
        return materialise(counts, "values")
    both = counts.withColumn("group", F.explode(F.array(F.lit(TOTAL), F.col("group"))))
    return materialise(value_counts(both, ["group", "variable"], "value", weight="n"), "values")


def cont_stats(df: DataFrame, columns: Sequence[str], group: str, total: bool = True) -> DataFrame:
    """Mean, sample SD, exact quartiles and missing count per (group, variable); NULL is a group of its own."""
    aggs = []
    for c in columns:
        aggs += [
            F.avg(c).alias(f"{c}|mean"),
            F.stddev_samp(c).alias(f"{c}|sd"),
            F.count_if(F.col(c).isNull()).cast("double").alias(f"{c}|missing"),
        ]
    rows = df.withColumn("_group", F.col(group).cast("string"))
    size = F.count(F.lit(1)).cast("double").alias("n")
    if total:
        pooled = F.grouping("_group") == 1
        moments = rows.groupingSets([[], ["_group"]], "_group").agg(
            F.when(pooled, F.lit(TOTAL)).otherwise(F.col("_group")).alias("group"), size, *aggs
        )
    else:
        moments = rows.groupBy(F.col("_group").alias("group")).agg(size, *aggs)
    cells = [f"{c}|{s}" for c in columns for s in ("mean", "sd", "missing")]
    long = moments.select("group", "n", *cells).unpivot(["group", "n"], cells, "cell", "x")
    parts = F.split("cell", r"\|")
    per = long.groupBy("group", "n", parts[0].alias("variable")).agg(
        *[F.max(F.when(parts[1] == s, F.col("x"))).alias(s) for s in ("mean", "sd", "missing")]
    )
    counts = grouped_counts(df, columns, group, total)
    quartiles = exact_quantiles(counts, ["group", "variable"], "value", QUARTILES)
    return join_groups(per, quartiles, ["group", "variable"], "left").select(
        "group",
        "variable",
        F.col("n").cast("long").alias("n"),
        F.col("missing").cast("long").alias("missing_n"),
        (F.lit(100.0) * F.col("missing") / F.col("n")).alias("missing_pct"),
        "mean",
        "sd",
        "median",
        "q1",
        "q3",
    )


def table_one(
    df: DataFrame,
    exposure: str = "ie_label",
    categorical: Sequence[str] = CATEGORICAL,
    continuous: Sequence[str] = CONTINUOUS,
) -> DataFrame:
    """The descriptive table: ``pos, Variable, Total, label_0, label_1`` with text cells."""
    variables = [exposure, *categorical, *continuous]
    at = {v: 10**12 * (i + 1) for i, v in enumerate(variables)}  # a variable never has that many levels
    start = F.create_map(*[x for v in variables for x in (F.lit(v), F.lit(at[v]))])
    groups = ["total", "label_0", "label_1"]

    levels = cat_stats(df, [exposure, *categorical], exposure)
    # a "Missing" row is added unless "Missing" is itself a level; the NULL level holds its counts
    known = levels.filter(F.col("level").isNotNull())
    absent = levels.groupBy("variable").agg(
        F.bool_or(F.coalesce(F.col("level") == "Missing", F.lit(False))).alias("has_missing"),
        *[F.coalesce(F.max(F.when(F.col("level").isNull(), F.col(g))), F.lit(0)).alias(g) for g in groups],
        *[
            F.coalesce(F.max(F.when(F.col("level").isNull(), F.col(f"{g}_pct"))), F.lit(0.0)).alias(f"{g}_pct")
            for g in groups
        ],
    )
    columns = ["variable", "level", *groups, *[f"{g}_pct" for g in groups]]
    rows = known.select(*columns, F.lit(0).alias("late")).unionByName(
        absent.filter(~F.col("has_missing")).withColumn("level", F.lit("Missing")).select(
            *columns, F.lit(1).alias("late")
        )
    )
    cats = range_rank(rows, ["variable"], [F.col("late"), F.col("level")], "place").select(
        (start[F.col("variable")] + F.col("place")).alias("pos"),
        F.concat(F.lit("  "), "level").alias("Variable"),
        *[
            F.concat(F.col(g).cast("string"), F.lit(" ("), cell(f"{g}_pct", 0), F.lit("%)")).alias(g)
            for g in groups
        ],
    )

    stats = cont_stats(df, continuous, exposure)
    group_of = {TOTAL: "total", "0": "label_0", "1": "label_1"}
    texts = stats.select(
        "variable",
        "group",
        F.concat(cell("mean", 1), F.lit(" ("), cell("sd", 1), F.lit(")")).alias("Mean (SD)"),
        F.concat(
            cell("median", 1), F.lit(" ["), cell("q1", 1), F.lit("-"), cell("q3", 1), F.lit("]")
        ).alias("Median [Q1-Q3]"),
        F.concat(F.col("missing_n").cast("string"), F.lit(" ("), cell("missing_pct", 0), F.lit("%)")).alias("Missing"),
    )
    lines = ["Mean (SD)", "Median [Q1-Q3]", "Missing"]
    order = F.create_map(*[x for i, n in enumerate(lines) for x in (F.lit(n), F.lit(i + 1))])
    conts = (
        texts.unpivot(["variable", "group"], lines, "line", "text")
        .groupBy("variable", "line")
        .agg(*[F.max(F.when(F.col("group") == k, F.col("text"))).alias(g) for k, g in group_of.items()])
        .select(
            (start[F.col("variable")] + order[F.col("line")]).alias("pos"),
            F.concat(F.lit("  "), "line").alias("Variable"),
            *groups,
        )
    )

    sizes = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(exposure) == 0).alias("label_0"),
        F.count_if(F.col(exposure) == 1).alias("label_1"),
    ).select(F.lit(0).cast("long").alias("pos"), F.lit("N").alias("Variable"), *[F.col(g).cast("string") for g in groups])
    heads = sizes.select(
        F.explode(F.array(*[F.struct(F.lit(at[v]).alias("pos"), F.lit(v).alias("Variable")) for v in variables])).alias("h")
    ).select("h.*", *[F.lit("").alias(g) for g in groups])
    table = sizes.unionByName(heads).unionByName(cats).unionByName(conts)
    return table.withColumnRenamed("total", TOTAL)


# --- shares and summaries -------------------------------------------------------------------------


def group_share(df: DataFrame, group: str, level: str) -> DataFrame:
    """Percent of each level within its group, NULL being one; rows without a level are left out."""
    counts = df.filter(F.col(level).isNotNull()).groupBy(group, level).agg(F.count(F.lit(1)).alias("count"))
    sizes = counts.groupBy(group).agg(F.sum("count").alias("_size"))
    return join_groups(counts, sizes, [group]).withColumn("pct", F.col("count") / F.col("_size") * 100.0).drop("_size")


def level_order(df: DataFrame, level: str) -> DataFrame:
    """Levels by frequency, the most frequent first, ties by name; ``place`` starts at 1."""
    counts = df.filter(F.col(level).isNotNull()).groupBy(level).agg(F.count(F.lit(1)).alias("n"))
    return range_rank(counts, [], [F.col("n").desc(), F.col(level)], "place").withColumn("place", F.col("place").cast("int"))


def demographic_numbers(df: DataFrame, group: str, vitals: Sequence[str] = VITALS) -> DataFrame:
    """Per group: size, male percent, age moments and quartiles, vital moments and missing percent."""
    stats = cont_stats(df, ["anchor_age", *vitals], group, total=False)
    male = df.groupBy(F.col(group).cast("string").alias("group")).agg(
        (F.avg(F.coalesce(F.col("gender") == "M", F.lit(False)).cast("double")) * 100.0).alias("male_pct")
    )

    def of(variable: str, stat: str) -> Column:
        return F.max(F.when(F.col("variable") == variable, F.col(stat)))

    picks = [of("anchor_age", s).alias(f"age_{s}") for s in ("mean", "sd", "median", "q1", "q3")]
    for v in vitals:
        picks += [of(v, s).alias(f"{v}_{s}") for s in ("mean", "sd", "missing_pct")]
    return join_groups(stats.groupBy("group").agg(F.max("n").alias("n"), *picks), male, ["group"])


def demographic_summary(df: DataFrame, group: str, vitals: Sequence[str] = VITALS) -> DataFrame:
    """The same as report text, one row per group."""
    numbers = demographic_numbers(df, group, vitals)
    columns = [
        F.col("group").alias("Group"),
        F.col("n").alias("N"),
        cell("male_pct", 1).alias("Male (%)"),
        F.concat(cell("age_mean", 1), F.lit(" ("), cell("age_sd", 1), F.lit(")")).alias("Age mean (SD)"),
        F.concat(
            cell("age_median", 0), F.lit(" ["), cell("age_q1", 0), F.lit("-"), cell("age_q3", 0), F.lit("]")
        ).alias("Age median [IQR]"),
    ]
    for v in vitals:
        spread = F.concat(cell(f"{v}_mean", 1), F.lit(" ("), cell(f"{v}_sd", 1), F.lit(")"))
        columns += [spread.alias(f"{v} mean (SD)"), cell(f"{v}_missing_pct", 1).alias(f"{v} missing (%)")]
    return numbers.select(*columns)


def corr_matrix(df: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    """Pearson correlations per group over complete rows, in one pass; a constant column gives NULL."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    aggs = [F.stddev_pop(c).alias(f"sd|{c}") for c in columns]
    aggs += [F.covar_pop(a, b).alias(f"{a}|{b}") for a, b in pairs]
    wide = df.select(F.col(group).cast("string").alias("group"), *columns).dropna(subset=list(columns)).groupBy("group").agg(*aggs)
    ratios = [
        F.try_divide(F.col(f"{a}|{b}"), F.col(f"sd|{a}") * F.col(f"sd|{b}")).alias(f"{a}|{b}") for a, b in pairs
    ]
    parts = F.split("pair", r"\|")
    long = wide.select("group", *ratios).unpivot(["group"], [f"{a}|{b}" for a, b in pairs], "pair", "r")
    halves = long.select("group", parts[0].alias("a"), parts[1].alias("b"), "r")
    mirrored = halves.filter("a <> b").select("group", F.col("b").alias("a"), F.col("a").alias("b"), "r")
    return halves.unionByName(mirrored)
