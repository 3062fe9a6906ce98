"""Queries for scans, sinks, projections, predicates and text rules (A and B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.functions.casts import c_to_f, fill_features, leading_int, reverse_ordinal, to_num, to_ts
from strataframe.functions.codes import code_in, code_in_any, code_prefix_any, normalize_code
from strataframe.functions.labels import RACE_EXTERNAL, RACE_INTERNAL, RACE_REPORT, map_values, normalize_label
from strataframe.functions.text import COMPLAINT_CATEGORIES, clean_text, has_keyword, keyword_categories
from strataframe.operators import filters
from strataframe.operators.cohort import map_visits
from strataframe.operators.features import CONTINUOUS, assemble, option_columns
from strataframe.operators.joins import flag_in_keys, left, override, prefer
from strataframe.plans.storage import fresh_path
from strataframe.sources import tables
from suite.registry import query, r6, rounded
from suite.sql import (
    external_sql,
    internal_sql,
    mapped_sql,
    norm,
    prefixes,
    project,
    quoted,
    r6 as R,
    race_case,
    strip,
)
from suite.views import BASE_SPEC, NAME_RULES, VISIT_SPEC, ctes, stored_cohort, view

# --- A: sources, sinks, projections ---------------------------------------------------------------


@query(
    "a01_scan",
    "select o_orderkey as stay_id, o_custkey as subject_id, o_orderdate as intime, o_orderpriority as acuity_raw from orders",
)
def a01(spark, sf):
    """The stays as a typed CSV round trip: types are declared, codes stay text."""
    path = fresh_path(spark, "stays_csv")
    view(spark, sf, "fx_stays").select("stay_id", "subject_id", "intime", "acuity_raw").write.option(
        "header", True
    ).csv(path)
    schema = "stay_id long, subject_id long, intime timestamp_ntz, acuity_raw string"
    return tables.scan(spark, path, schema, ["stay_id", "subject_id", "intime", "acuity_raw"], fmt="csv")


@query(
    "a02_null_tokens",
    ctes("fx_visits")
    + f" select CSN as stay_id, case when Race in ({quoted(tables.MISSING_TOKENS)}) then null else Race end as race,"
    + f" case when Triage_Temp in ({quoted(tables.MISSING_TOKENS)}) then null else Triage_Temp end as temp from fx_visits",
)
def a02(spark, sf):
    raw = view(spark, sf, "fx_visits").select(
        F.col("CSN").alias("stay_id"), F.col("Race").alias("race"), F.col("Triage_Temp").alias("temp")
    )
    return tables.null_tokens(raw, ["race", "temp"])


@query("a03_write_cohort", internal_sql(BASE_SPEC) + " select * replace (nullif(chiefcomplaint, '') as chiefcomplaint) from cohort")
def a03(spark, sf):
    """Sink and source of the cohort through CSV, where '' becomes missing."""
    path = fresh_path(spark, "cohort_csv")
    tables.write_cohort(stored_cohort(spark, sf), path, fmt="csv")
    return tables.read_cohort(spark, path, fmt="csv")


@query(
    "a03_write_external_cohort",
    external_sql(VISIT_SPEC)
    + f" select * replace (nullif(chiefcomplaint, '') as chiefcomplaint, {R('temperature')} as temperature, {R('o2sat')} as o2sat) from cohort",
)
def a03_external(spark, sf):
    """The same for complaints that are whole documents, with line breaks, quotes and blanks."""
    path = fresh_path(spark, "cohort_csv")
    tables.write_cohort(stored_cohort(spark, sf, "external"), path, fmt="csv")
    return tables.read_cohort(spark, path, fmt="csv").withColumns({c: r6(c) for c in ("temperature", "o2sat")})


_MATRIX = ", ".join(f"coalesce({c}, 0.0)" for c in CONTINUOUS)


@query(
    "a04_write_features",
    internal_sql(BASE_SPEC)
    + f", cells as (select stay_id, ie_label as label, [{_MATRIX}] as x, {quoted(CONTINUOUS).join(['[', ']'])} as names from cohort)"
    + f" select stay_id, label, names[i] as name, cast(i - 1 as integer) as pos, {R('cast(cast(x[i] as float) as double)')} as value"
    + " from cells, generate_series(1, 7) g(i)",
)
def a04(spark, sf):
    path = fresh_path(spark, "features")
    rows = stored_cohort(spark, sf).withColumnRenamed("ie_label", "label")
    tables.write_features(assemble(rows, CONTINUOUS), CONTINUOUS, path)
    read, names = tables.read_features(spark, path)
    from pyspark.ml.functions import vector_to_array

    named = F.array(*[F.lit(n) for n in names])
    long = read.select("stay_id", "label", F.posexplode(vector_to_array("features")).alias("pos", "value"))
    return long.select("stay_id", "label", named[F.col("pos")].alias("name"), "pos", r6("value").alias("value"))


@query(
    "a05_metric_table",
    ctes("fx_stays")
    + " select unnest(['stays', 'patients', 'no_admission']) as metric, unnest([count(*), count(distinct subject_id),"
    + " count(*) filter (hadm_id is null)])::varchar as value from fx_stays",
)
def a05(spark, sf):
    return tables.metric_table(
        view(spark, sf, "fx_stays"),
        {
            "stays": F.count(F.lit(1)),
            "patients": F.count_distinct("subject_id"),
            "no_admission": F.count_if(F.col("hadm_id").isNull()),
        },
    )


@query(
    "a06_available_options",
    internal_sql(BASE_SPEC)
    + " select unnest(['Option1_Categorical', 'Option4_No_CC']) as option, unnest([12, 7])::integer as width,"
    + " unnest([count(*), count(*)]) as rows from cohort",
)
def a06(spark, sf):
    """Feature sets whose inputs are all there; the embedding scores are absent from this table."""
    options = option_columns(CONTINUOUS, ("gender", "race", "acuity", "chiefcomplaint", "stay_id"), pca=5)
    rows = stored_cohort(spark, sf)
    found = tables.available_options(rows, options)
    sizes = F.array(*[F.struct(F.lit(n).alias("option"), F.lit(len(c)).alias("width")) for n, c in found.items()])
    return rows.agg(F.count(F.lit(1)).alias("rows")).select(F.explode(sizes).alias("o"), "rows").select("o.*", "rows")


_MAPPED = ["subject_id", "stay_id", "hadm_id", "intime", "outtime", "gender", "anchor_age", "race", "temperature", "acuity"]


@query(
    "a07_map_schema",
    ctes("fx_visits")
    + mapped_sql()
    + f" select {', '.join(_MAPPED)}, dx9 as dx_icd9_norm, dx10 as dx_icd10_norm from mapped".replace(
        " temperature,", f" {R('temperature')} as temperature,"
    ),
)
def a07(spark, sf):
    mapped = map_visits(view(spark, sf, "fx_visits"))
    return mapped.select(*_MAPPED, "dx_icd9_norm", "dx_icd10_norm").withColumn("temperature", r6("temperature"))


@query(
    "a08_project_cohort",
    ctes("fx_visits") + mapped_sql() + f", l as (select *, 0 as ie_label from mapped) select {project()} from l".replace(
        "cast(temperature as double)", R("cast(temperature as double)")
    ),
)
def a08(spark, sf):
    mapped = map_visits(view(spark, sf, "fx_visits")).withColumn("ie_label", F.lit(0))
    return tables.project_cohort(mapped).withColumn("temperature", r6("temperature"))


@query(
    "a09_write_predictions",
    ctes("fx_scores") + f" select stay_id, cast(label as integer) as y_true, {R('prob')} as y_prob from fx_scores",
)
def a09(spark, sf):
    path = fresh_path(spark, "predictions")
    tables.write_predictions(view(spark, sf, "fx_scores"), path)
    return tables.scan(spark, path, "stay_id long, y_true int, y_prob double").withColumn("y_prob", r6("y_prob"))


# --- B: rules on columns --------------------------------------------------------------------------

_DX = "cast(hadm_id as bigint) as hadm_id, icd_code"


@query("b01_code_in", ctes("fx_diagnoses") + f" select hadm_id, icd_code, {strip('icd_code')} in ({quoted(BASE_SPEC.case_codes)}) as hit from fx_diagnoses")
def b01(spark, sf):
    return view(spark, sf, "fx_diagnoses").withColumn("hit", code_in("icd_code", BASE_SPEC.case_codes))


@query("b02_normalize_code", ctes("fx_visits") + f" select CSN, {norm('Dx_ICD9')} as dx9, {norm('Dx_ICD10')} as dx10 from fx_visits")
def b02(spark, sf):
    return view(spark, sf, "fx_visits").select(
        "CSN", normalize_code("Dx_ICD9").alias("dx9"), normalize_code("Dx_ICD10").alias("dx10")
    )


@query(
    "b03_code_prefix_any",
    ctes("fx_diagnoses")
    + f" select hadm_id, icd_code, {prefixes(norm('icd_code'), BASE_SPEC.lookalike_prefixes)} as lookalike,"
    + f" {prefixes(norm('icd_code'), BASE_SPEC.risk_prefixes)} as risk from fx_diagnoses",
)
def b03(spark, sf):
    return view(spark, sf, "fx_diagnoses").select(
        "hadm_id",
        "icd_code",
        code_prefix_any("icd_code", BASE_SPEC.lookalike_prefixes).alias("lookalike"),
        code_prefix_any("icd_code", BASE_SPEC.risk_prefixes).alias("risk"),
    )


@query(
    "b04_has_keyword",
    f"select doc_id, regexp_matches(lower(coalesce(text, '')), '{VISIT_SPEC.keywords}') as hit from documents",
)
def b04(spark, sf):
    return view(spark, sf, "documents").select("doc_id", has_keyword("text", VISIT_SPEC.keywords).alias("hit"))


def _category_list(c: str, rules: dict[str, str]) -> str:
    hits = ", ".join(f"case when regexp_matches(lower(coalesce({c}, '')), '{p}') then '{n}' end" for n, p in rules.items())
    return f"array_to_string(list_filter([{hits}], lambda x: x is not null), ',')"


@query(
    "b05_keyword_categories",
    ctes("fx_triage") + f" select stay_id, {_category_list('chiefcomplaint', {**COMPLAINT_CATEGORIES, **NAME_RULES})} as categories from fx_triage",
)
def b05(spark, sf):
    found = keyword_categories("chiefcomplaint", {**COMPLAINT_CATEGORIES, **NAME_RULES})
    return view(spark, sf, "fx_triage").select("stay_id", F.array_join(found, ",").alias("categories"))


@query("b06_normalize_label", ctes("fx_admissions") + f" select hadm_id, {race_case('race')} as race from fx_admissions")
def b06(spark, sf):
    return view(spark, sf, "fx_admissions").select("hadm_id", normalize_label("race", RACE_INTERNAL).alias("race"))


@query("b07_normalize_label_external", ctes("fx_visits") + f" select CSN, {race_case('Race', True)} as race from fx_visits")
def b07(spark, sf):
    return view(spark, sf, "fx_visits").select("CSN", normalize_label("Race", RACE_EXTERNAL).alias("race"))


REPORT_RACE = """case when upper({c}) like 'WHITE%' then 'White' when upper({c}) like '%BLACK%' or upper({c}) like '%AFRICAN%' then 'Black'
  when upper({c}) like '%HISPANIC%' or upper({c}) like '%LATINO%' then 'Hispanic' when upper({c}) like '%ASIAN%' then 'Asian'
  when upper({c}) in ('MISSING', '') then 'Missing' when upper({c}) like '%UNKNOWN%' or upper({c}) like '%UNABLE%' then 'Unknown'
  else 'Other' end"""


@query("b08_normalize_label_report", ctes("fx_admissions") + f" select hadm_id, {REPORT_RACE.format(c='race')} as race_group from fx_admissions")
def b08(spark, sf):
    return view(spark, sf, "fx_admissions").select("hadm_id", normalize_label("race", RACE_REPORT).alias("race_group"))


_INT = "try_cast(nullif(regexp_extract(coalesce({c}, ''), '^\\s*(\\d+)', 1), '') as integer)"


@query(
    "b09_leading_int",
    ctes("fx_visits") + f" select CSN, Triage_acuity, {_INT.format(c='Triage_acuity')} as acuity from fx_visits",
)
def b09(spark, sf):
    return view(spark, sf, "fx_visits").select("CSN", "Triage_acuity", leading_int("Triage_acuity").alias("acuity"))


@query("b10_c_to_f", ctes("fx_visits") + mapped_sql() + f" select stay_id, {R('temperature')} as fahrenheit from mapped")
def b10(spark, sf):
    return view(spark, sf, "fx_visits").select(
        F.col("CSN").alias("stay_id"), r6(c_to_f("Triage_Temp")).alias("fahrenheit")
    )


@query(
    "b11_to_num",
    "with raw as (select doc_id, case doc_id % 6 when 0 then concat(' ', n_chars, ' ') when 1 then concat(n_chars, '.5')"
    " when 2 then concat(n_chars, 'd') when 3 then 'nan' when 4 then concat('-', n_chars, 'e1') else source end as t from documents)"
    " select doc_id, t, try_cast(case when regexp_full_match(t, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*') then trim(t) end as double)"
    " as value from raw",
)
def b11(spark, sf):
    n, kind = F.col("n_chars").cast("string"), F.col("doc_id") % 6
    text = (
        F.when(kind == 0, F.concat(F.lit(" "), n, F.lit(" ")))
        .when(kind == 1, F.concat(n, F.lit(".5")))
        .when(kind == 2, F.concat(n, F.lit("d")))
        .when(kind == 3, F.lit("nan"))
        .when(kind == 4, F.concat(F.lit("-"), n, F.lit("e1")))
        .otherwise(F.col("source"))
    )
    return view(spark, sf, "documents").select("doc_id", text.alias("t")).withColumn("value", to_num("t"))


@query(
    "b12_to_ts",
    "with raw as (select event_id, case event_id % 4 when 0 then 'never' when 1 then '2024-13-45 00:00:00'"
    " else strftime(ts, '%Y-%m-%d %H:%M:%S') end as t from events) select event_id, t, try_cast(t as timestamp) as parsed from raw",
)
def b12(spark, sf):
    kind = F.col("event_id") % 4
    text = (
        F.when(kind == 0, F.lit("never"))
        .when(kind == 1, F.lit("2024-13-45 00:00:00"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    )
    return view(spark, sf, "events").select("event_id", text.alias("t")).withColumn("parsed", to_ts("t"))


@query("b13_keep_in", ctes("fx_patients") + " select * from fx_patients where gender in ('M', 'F')")
def b13(spark, sf):
    return filters.keep_in(view(spark, sf, "fx_patients"), "gender", ["M", "F"])


@query("b14_keep_range", ctes("fx_patients") + " select * from fx_patients where anchor_age between 0 and 120")
def b14(spark, sf):
    return filters.keep_range(view(spark, sf, "fx_patients"), "anchor_age", *filters.AGE_RANGE)


_RANGES = {**filters.VITAL_RANGES, **filters.ACUITY_RANGE}


@query(
    "b15_keep_range_or_null",
    ctes("fx_triage")
    + " select stay_id, acuity from fx_triage where "
    + " and ".join(f"({c} is null or {c} between {lo} and {hi})" for c, (lo, hi) in _RANGES.items()),
)
def b15(spark, sf):
    return filters.keep_range_or_null(view(spark, sf, "fx_triage"), _RANGES).select("stay_id", "acuity")


@query("b16_keep_ordered", ctes("fx_stays") + " select stay_id, intime, outtime from fx_stays where intime < outtime")
def b16(spark, sf):
    return filters.keep_ordered(view(spark, sf, "fx_stays"), "intime", "outtime").select("stay_id", "intime", "outtime")


@query("b17_clean_text", ctes("fx_visits") + f" select CSN, md5({strip(chr(99) + 'oalesce(CC, ' + chr(39) * 2 + ')')}) as digest, {strip('Race')} is null as bare from fx_visits")
def b17(spark, sf):
    return view(spark, sf, "fx_visits").select(
        "CSN", F.md5(clean_text("CC")).alias("digest"), F.col("Race").isNull().alias("bare")
    )


@query(
    "b18_prefer",
    ctes("fx_stays", "fx_patients")
    + " select stay_id, coalesce(p.gender, s.gender) as gender from fx_stays s left join fx_patients p on p.subject_id = s.subject_id",
)
def b18(spark, sf):
    people = view(spark, sf, "fx_patients").select("subject_id", F.col("gender").alias("g"))
    joined = left(view(spark, sf, "fx_stays"), people, ["subject_id"], "stay_id")
    return joined.select("stay_id", prefer("g", "gender").alias("gender"))


@query(
    "b19_override",
    ctes("fx_stays", "fx_admissions")
    + " select stay_id, a.race as race from fx_stays s left join fx_admissions a on a.hadm_id = s.hadm_id",
)
def b19(spark, sf):
    stays = view(spark, sf, "fx_stays").select("stay_id", "hadm_id", F.lit("own").alias("race"))
    races = view(spark, sf, "fx_admissions").withColumnRenamed("race", "race_admission")
    joined = left(stays, races, ["hadm_id"], "stay_id")
    return override(joined, {"race": "race_admission"}).select("stay_id", "race")


_CASE_KEYS = f"select distinct hadm_id from fx_diagnoses where {strip('icd_code')} in ({quoted(BASE_SPEC.case_codes)})"


@query(
    "b20_label_from_keys",
    ctes("fx_stays", "fx_diagnoses")
    + f" select stay_id, s.hadm_id, cast(case when k.hadm_id is null then 0 else 1 end as integer) as label"
    + f" from fx_stays s left join ({_CASE_KEYS}) k on k.hadm_id = s.hadm_id",
)
def b20(spark, sf):
    keys = view(spark, sf, "fx_diagnoses").filter(code_in("icd_code", BASE_SPEC.case_codes))
    stays = view(spark, sf, "fx_stays").select("stay_id", "hadm_id")
    return flag_in_keys(stays, keys, "hadm_id", "label", "stay_id")


_VISIT_CASES = quoted([c.upper() for c in VISIT_SPEC.case_codes])


@query(
    "b21_code_in_any",
    ctes("fx_visits") + f" select CSN, {norm('Dx_ICD10')} in ({_VISIT_CASES}) or {norm('Dx_ICD9')} in ({_VISIT_CASES}) as hit from fx_visits",
)
def b21(spark, sf):
    return view(spark, sf, "fx_visits").select(
        "CSN", code_in_any(["Dx_ICD9", "Dx_ICD10"], VISIT_SPEC.case_codes).alias("hit")
    )


@query(
    "b22_reverse_ordinal",
    ctes("fx_triage")
    + " select stay_id, least(greatest(cast(trunc(5 - coalesce(acuity + (stay_id % 3) * 0.5::double, 3)) as integer), 0), 4) as esi from fx_triage",
)
def b22(spark, sf):
    halves = F.col("acuity") + (F.col("stay_id") % 3) * F.lit(0.5)
    return view(spark, sf, "fx_triage").select("stay_id", reverse_ordinal(halves).alias("esi"))


@query(
    "b23_map_values",
    ctes("fx_scores") + " select stay_id, case label when 1 then 'Case' when 0 then 'Control' end as grp from fx_scores",
)
def b23(spark, sf):
    return view(spark, sf, "fx_scores").select("stay_id", map_values("label", {1: "Case", 0: "Control"}).alias("grp"))


@query(
    "b24_fill_features",
    ctes("fx_triage")
    + ", raw as (select stay_id, case stay_id % 5 when 0 then 'nan'::double when 1 then 'inf'::double when 2 then '-inf'::double else temperature end as x from fx_triage)"
    + " select stay_id, case when x is null or isnan(x) then 0.0::double else least(greatest(x, -1.7976931348623157e308::double), 1.7976931348623157e308::double) end as x from raw",
)
def b24(spark, sf):
    kind = F.col("stay_id") % 5
    x = (
        F.when(kind == 0, F.lit(float("nan")))
        .when(kind == 1, F.lit(float("inf")))
        .when(kind == 2, F.lit(float("-inf")))
        .otherwise(F.col("temperature"))
    )
    return fill_features(view(spark, sf, "fx_triage").select("stay_id", x.alias("x")), ["x"])


__all__ = ["rounded"]
