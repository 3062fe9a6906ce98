"""Queries for joins, set operations, strata, sampling and cohorts (C and E)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from strataframe.functions.codes import code_in, code_prefix_any
from strataframe.functions.text import has_keyword
from strataframe.operators import joins
from strataframe.operators.cohort import build_cohort, draw_controls, map_visits
from strataframe.operators.filters import rule_report, store_validated, study_rules
from strataframe.operators.sampling import (
    assign_stratum,
    fill_shortfall,
    flags_any,
    or_flags,
    plan_quotas,
    sample_n,
    shuffle,
)
from strataframe.plans.storage import materialise
from suite.registry import query, r6
from suite.sql import external_sql, internal_sql, mapped_sql, norm, prefixes, quoted, r6 as R, rule_sql, slim_sql, strip
from suite.views import (
    BASE_SPEC,
    VISIT_SPEC,
    WIDE_SPEC,
    ctes,
    external,
    hospital,
    internal,
    stored_cohort,
    view,
)

# --- C: joins and set operations ------------------------------------------------------------------

_VITALS = "temperature, heartrate, resprate, o2sat, sbp, dbp, acuity, chiefcomplaint"


@query(
    "c01_left",
    ctes("fx_stays", "fx_triage")
    + f" select s.stay_id, s.subject_id, s.hadm_id, {_VITALS} from fx_stays s left join fx_triage t"
    + " on t.stay_id = s.stay_id and t.subject_id = s.subject_id",
)
def c01(spark, sf):
    stays = view(spark, sf, "fx_stays").select("stay_id", "subject_id", "hadm_id")
    return joins.left(stays, view(spark, sf, "fx_triage"), ["subject_id", "stay_id"], "stay_id")


@query(
    "c02_left_dim",
    ctes("fx_stays", "fx_patients")
    + " select stay_id, s.gender, p.gender as gender_patients, anchor_age from fx_stays s"
    + " left join fx_patients p on p.subject_id = s.subject_id",
)
def c02(spark, sf):
    stays = view(spark, sf, "fx_stays").select("stay_id", "subject_id", "gender")
    joined = joins.left_dim(stays, view(spark, sf, "fx_patients"), "subject_id", "_patients", "stay_id")
    return joined.drop("subject_id")


# admissions with repeated keys: every third one occurs twice
_REPEATED = "select hadm_id, race from fx_admissions union all select hadm_id - hadm_id % 3, race from fx_admissions where hadm_id % 3 = 1"


@query(
    "c03_left_first",
    ctes("fx_stays", "fx_admissions")
    + f", ranked as (select *, row_number() over (partition by hadm_id order by race nulls first) as r from ({_REPEATED}))"
    + " select stay_id, s.hadm_id, a.race from fx_stays s left join (select * from ranked where r = 1) a on a.hadm_id = s.hadm_id",
)
def c03(spark, sf):
    races = view(spark, sf, "fx_admissions")
    again = races.filter(F.col("hadm_id") % 3 == 1).withColumn("hadm_id", F.col("hadm_id") - F.col("hadm_id") % 3)
    stays = view(spark, sf, "fx_stays").select("stay_id", "hadm_id")
    return joins.left_first(stays, races.unionByName(again), "hadm_id", ["race"], "_admissions", "stay_id")


_CASES = f"(select distinct hadm_id from fx_diagnoses where {strip('icd_code')} in ({quoted(BASE_SPEC.case_codes)}))"


def _case_rows(spark, sf):
    return view(spark, sf, "fx_diagnoses").filter(code_in("icd_code", BASE_SPEC.case_codes))


@query(
    "c04_flag_in_keys",
    ctes("fx_stays", "fx_diagnoses")
    + f" select stay_id, subject_id, cast(case when k.hadm_id is null then 0 else 1 end as integer) as ie_label"
    + f" from fx_stays s left join {_CASES} k on k.hadm_id = s.hadm_id",
)
def c04(spark, sf):
    stays = view(spark, sf, "fx_stays").select("stay_id", "subject_id", "hadm_id")
    return joins.flag_in_keys(stays, _case_rows(spark, sf), "hadm_id", "ie_label", "stay_id").drop("hadm_id")


@query(
    "c05_semi",
    ctes("fx_stays", "fx_diagnoses") + f" select stay_id, subject_id, hadm_id from fx_stays where hadm_id in {_CASES}",
)
def c05(spark, sf):
    stays = view(spark, sf, "fx_stays").select("stay_id", "subject_id", "hadm_id")
    return joins.semi(stays, _case_rows(spark, sf), "hadm_id", "stay_id")


_FLAGS = (
    f"select hadm_id, bool_or({prefixes(norm('icd_code'), BASE_SPEC.lookalike_prefixes)}) as lookalike,"
    f" bool_or({prefixes(norm('icd_code'), BASE_SPEC.risk_prefixes)}) as risk from fx_diagnoses group by hadm_id"
)


def _flags(spark, sf):
    return flags_any(
        view(spark, sf, "fx_diagnoses"),
        "hadm_id",
        {
            "lookalike": code_prefix_any("icd_code", BASE_SPEC.lookalike_prefixes),
            "risk": code_prefix_any("icd_code", BASE_SPEC.risk_prefixes),
        },
    )


@query(
    "c06_left_flags",
    ctes("fx_stays", "fx_diagnoses")
    + f" select stay_id, coalesce(lookalike, false) as lookalike, coalesce(risk, false) as risk"
    + f" from fx_stays s left join ({_FLAGS}) f on f.hadm_id = s.hadm_id",
)
def c06(spark, sf):
    stays = view(spark, sf, "fx_stays").select("stay_id", "hadm_id")
    return joins.left_flags(stays, _flags(spark, sf), "hadm_id", "stay_id").drop("hadm_id")


@query("c07_anti", slim_sql(BASE_SPEC) + " select stay_id, stratum from slim where stay_id not in (select stay_id from selected)")
def c07(spark, sf):
    strata = materialise(hospital(spark, sf).strata(BASE_SPEC), "strata")
    picked, _ = draw_controls(strata, BASE_SPEC)
    return joins.anti(strata, picked, "stay_id")


@query(
    "c08_append",
    ctes("fx_stays", "fx_visits")
    + " select stay_id, gender, acuity_raw, null as text_size from fx_stays union all select CSN, Gender, null, length(CC) from fx_visits",
)
def c08(spark, sf):
    """Two sources one below the other; each side has a column the other lacks, and a helper is dropped."""
    stays = view(spark, sf, "fx_stays").select("stay_id", "gender", "acuity_raw", F.lit(1).alias("helper"))
    visits = view(spark, sf, "fx_visits").select(
        F.col("CSN").alias("stay_id"), F.col("Gender").alias("gender"), F.length("CC").cast("long").alias("text_size")
    )
    return joins.append([stays, visits], drop=["helper"])


@query(
    "c09_split_label",
    ctes("fx_scores") + " select label, count(*) as n, min(stay_id) as first_id, max(prob) as top from fx_scores group by label",
)
def c09(spark, sf):
    sides = joins.split_label(view(spark, sf, "fx_scores"), "label")
    counted = [
        s.agg(
            F.max("label").alias("label"),
            F.count(F.lit(1)).alias("n"),
            F.min("stay_id").alias("first_id"),
            F.max("prob").alias("top"),
        )
        for s in sides
    ]
    return joins.append(counted)


# --- E: strata, quotas, sampling, cohorts ---------------------------------------------------------


@query("e01_flags_any", ctes("fx_diagnoses") + " " + _FLAGS)
def e01(spark, sf):
    return _flags(spark, sf)


_PAST = (
    f"select MRN, bool_or({prefixes(norm('Code'), VISIT_SPEC.lookalike_prefixes)}) as lookalike,"
    f" bool_or({prefixes(norm('Code'), VISIT_SPEC.risk_prefixes)}) as risk from fx_history group by MRN"
)


@query(
    "e02_or_flags",
    ctes("fx_visits", "fx_history")
    + mapped_sql()
    + f" select stay_id, coalesce(h.lookalike, false) or {prefixes('dx9', VISIT_SPEC.lookalike_prefixes)} or {prefixes('dx10', VISIT_SPEC.lookalike_prefixes)} as lookalike,"
    + f" coalesce(h.risk, false) or {prefixes('dx9', VISIT_SPEC.risk_prefixes)} or {prefixes('dx10', VISIT_SPEC.risk_prefixes)} as risk"
    + f" from mapped m left join ({_PAST}) h on h.MRN = m.subject_id",
)
def e02(spark, sf):
    past = flags_any(
        view(spark, sf, "fx_history"),
        "MRN",
        {
            "past_lookalike": code_prefix_any("Code", VISIT_SPEC.lookalike_prefixes),
            "past_risk": code_prefix_any("Code", VISIT_SPEC.risk_prefixes),
        },
    ).withColumnRenamed("MRN", "subject_id")
    visits = map_visits(view(spark, sf, "fx_visits"))
    joined = joins.left_flags(visits, past, "subject_id", "stay_id")

    def seen(prefix_list):
        return [code_prefix_any(c, prefix_list) for c in ("dx_icd9_norm", "dx_icd10_norm")]

    return joined.select(
        "stay_id",
        or_flags(F.col("past_lookalike"), *seen(VISIT_SPEC.lookalike_prefixes)).alias("lookalike"),
        or_flags(F.col("past_risk"), *seen(VISIT_SPEC.risk_prefixes)).alias("risk"),
    )


@query(
    "e03_assign_stratum",
    ctes("fx_stays", "fx_triage", "fx_diagnoses")
    + f" select s.stay_id, case when coalesce(lookalike, false) then 'A' when coalesce(risk, false)"
    + f" or regexp_matches(lower(coalesce(chiefcomplaint, '')), '{BASE_SPEC.keywords}') then 'B' else 'C' end as stratum"
    + f" from fx_stays s left join ({_FLAGS}) f on f.hadm_id = s.hadm_id left join fx_triage t on t.stay_id = s.stay_id and t.subject_id = s.subject_id",
)
def e03(spark, sf):
    stays = view(spark, sf, "fx_stays").select("stay_id", "subject_id", "hadm_id")
    flagged = joins.left_flags(stays, _flags(spark, sf), "hadm_id", "stay_id")
    texts = view(spark, sf, "fx_triage").select("subject_id", "stay_id", "chiefcomplaint")
    wide = joins.left(flagged, texts, ["subject_id", "stay_id"], "stay_id")
    moderate = or_flags(F.col("risk"), has_keyword("chiefcomplaint", BASE_SPEC.keywords))
    return wide.select("stay_id", assign_stratum(F.col("lookalike"), moderate).alias("stratum"))


@query(
    "e04_plan_quotas",
    slim_sql(WIDE_SPEC) + " select unnest(['A', 'B', 'C']) as stratum, unnest([na, nb, nc]) as pool, unnest([qa, qb, qc]) as quota from quotas",
)
def e04(spark, sf):
    strata = hospital(spark, sf).strata(WIDE_SPEC)
    counts = materialise(strata.groupBy("stratum").agg(F.count(F.lit(1)).alias("pool")), "pools")
    pools = {r["stratum"]: r["pool"] for r in counts.collect()}
    quotas = plan_quotas(pools, pools["P"], WIDE_SPEC.ratio, WIDE_SPEC.share_a, WIDE_SPEC.share_b)
    quota = F.create_map(*[x for s, q in quotas.items() for x in (F.lit(s), F.lit(q).cast("long"))])
    return counts.filter("stratum <> 'P'").withColumn("quota", quota[F.col("stratum")])


@query(
    "e05_sample_n",
    ctes("fx_stays")
    + ", sizes as (select acuity_raw, count(*) as n from fx_stays group by 1),"
    + " ranked as (select stay_id, acuity_raw, row_number() over (partition by acuity_raw order by md5(concat('42:', cast(stay_id as varchar))), stay_id) as r from fx_stays)"
    + " select stay_id, acuity_raw from ranked join sizes using (acuity_raw) where r <= case acuity_raw when '1-URGENT' then n // 3 when '5-LOW' then n + 10 when '2-HIGH' then 7 else 0 end",
)
def e05(spark, sf):
    stays = view(spark, sf, "fx_stays").select("stay_id", "acuity_raw")
    sizes = {r["acuity_raw"]: r["n"] for r in stays.groupBy("acuity_raw").agg(F.count(F.lit(1)).alias("n")).collect()}
    quotas = {"1-URGENT": sizes["1-URGENT"] // 3, "5-LOW": sizes["5-LOW"] + 10, "2-HIGH": 7}
    return sample_n(stays, "acuity_raw", quotas, 42, "stay_id")


@query(
    "e06_fill_shortfall",
    slim_sql(WIDE_SPEC) + " select stay_id, stratum from fill",
)
def e06(spark, sf):
    strata = materialise(hospital(spark, sf).strata(WIDE_SPEC), "strata")
    pools = {r["stratum"]: r["n"] for r in strata.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).collect()}
    cases = pools.pop("P")
    quotas = plan_quotas(pools, cases)
    picked = materialise(sample_n(strata, "stratum", quotas, 42, "stay_id"), "picked")
    controls = strata.filter("stratum <> 'P'")
    return fill_shortfall(controls, picked, cases * 10, sum(quotas.values()), 42, "stay_id")


@query(
    "e07_shuffle",
    ctes("fx_stays") + " select stay_id, md5(concat('42:', cast(stay_id as varchar))) as shuffle_key from fx_stays",
)
def e07(spark, sf):
    return shuffle(view(spark, sf, "fx_stays").select("stay_id"), 42, "stay_id").orderBy("shuffle_key", "stay_id")


_COHORT = "* replace (round(temperature, 6) + 0.0 as temperature, round(o2sat, 6) + 0.0 as o2sat)"


@query("e08_internal_cohort", internal_sql(WIDE_SPEC) + f" select {_COHORT} from cohort")
def e08(spark, sf):
    rows = internal(spark, sf, WIDE_SPEC).rows
    return rows.withColumns({c: r6(c) for c in ("temperature", "o2sat")})


@query("e08_text_times", internal_sql(BASE_SPEC) + f" select {_COHORT} from cohort where stay_id % 50 <> 7")
def e08_text_times(spark, sf):
    """Arrival times and admissions that come as text: a time that is none becomes NULL and its row drops."""
    tables = hospital(spark, sf)
    text = F.when(F.col("stay_id") % 100 == 7, "0000-not-a-date").when(F.col("stay_id") % 50 == 7, "garbage")
    stays = tables.stays.withColumn("intime", F.coalesce(text, F.col("intime").cast("string")))
    rows = build_cohort(replace(tables, stays=stays), BASE_SPEC).rows
    return rows.withColumns({c: r6(c) for c in ("temperature", "o2sat")})


@query("e09_external_cohort", external_sql(VISIT_SPEC) + f" select {_COHORT} from cohort")
def e09(spark, sf):
    rows = external(spark, sf).rows
    return rows.withColumns({c: r6(c) for c in ("temperature", "o2sat")})


def _rule_report_sql() -> str:
    rules = {n: f"coalesce({r}, false)" for n, r in rule_sql().items()}
    names, parts, before = list(rules), [], "true"
    for n in names:
        parts.append(f"select '{n}' as rule, count(*) filter (not {rules[n]}) as failed, count(*) filter ({before} and not {rules[n]}) as dropped from drawn_rows")
        before += f" and {rules[n]}"
    return internal_sql(BASE_SPEC) + " " + " union all ".join(parts)


@query("e10_validate", _rule_report_sql())
def e10(spark, sf):
    return rule_report(internal(spark, sf).drawn, study_rules())


@query(
    "e10_stored_report",
    _rule_report_sql() + " union all select 'repeated_keys', count(*) - count(distinct stay_id), 0 from cohort",
)
def e10_stored(spark, sf):
    """The same counts, observed while the validated rows are written, and whether a stay occurs more than once."""
    return store_validated(internal(spark, sf).drawn, study_rules(), "stay_id")[1]


__all__ = ["R", "stored_cohort"]
