"""Oracle SQL shared by several queries."""

from __future__ import annotations

from strataframe.functions.codes import WHITESPACE
from strataframe.operators.cohort import StudySpec
from strataframe.operators.filters import ACUITY_RANGE, VITAL_RANGES
from strataframe.sources.tables import COHORT_TYPES
from suite.views import VIEWS, ctes

INTERNAL_VIEWS = ("fx_stays", "fx_triage", "fx_diagnoses", "fx_patients", "fx_admissions")


def r6(x: str) -> str:
    """Six places, without a negative zero."""
    return f"round({x}, 6) + 0.0"


def strip(c: str) -> str:
    return f"trim({c}, '{WHITESPACE}')"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def prefixes(code: str, values) -> str:
    return "(" + " or ".join(f"starts_with({code}, '{v}')" for v in values) + ")"


def norm(c: str) -> str:
    return f"upper({strip(f'coalesce({c}, {chr(39)}{chr(39)})')})"


def race_case(c: str, external: bool = False) -> str:
    t = f"upper({strip(c)})"
    unknown = ["UNKNOWN", "UNABLE TO OBTAIN", "PATIENT DECLINED TO ANSWER"] + (["DECLINES TO STATE"] if external else [])
    return f"""case when {c} is null or {t} = '' then 'Missing' when {t} in ({quoted(unknown)}) then 'Unknown'
  when {t} like 'WHITE%' then 'White' when {t} like '%BLACK%' or {t} like '%AFRICAN%' then 'Black / African American'
  when {t} like 'ASIAN%' then 'Asian' when {t} like '%HISPANIC%' or {t} like '%LATINO%' then 'Hispanic / Latino'
  else 'Other' end"""


def rule_sql() -> dict[str, str]:
    rules = {
        "label": "ie_label in (0, 1)",
        "gender": "gender in ('M', 'F')",
        "age": "anchor_age between 0 and 120",
    }
    for c, (lo, hi) in {**VITAL_RANGES, **ACUITY_RANGE}.items():
        rules[c] = f"({c} is null or {c} between {lo} and {hi})"
    rules["stay_order"] = "intime < outtime"
    return rules


def draw_sql(spec: StudySpec) -> str:
    """CTEs from ``slim(stay_id, stratum)`` to ``selected(stay_id, stratum, drawn)``."""
    order = f"md5(concat('{spec.seed}:', cast(stay_id as varchar))), stay_id"
    return f""",
pools as (select count(*) filter (stratum = 'P') as np, count(*) filter (stratum = 'A') as na,
  count(*) filter (stratum = 'B') as nb, count(*) filter (stratum = 'C') as nc from slim),
shares as (select *, np * {spec.ratio} as target,
  least(cast(round_even(np * {spec.ratio} * cast({spec.share_a} as double), 0) as bigint), na) as qa,
  least(cast(round_even(np * {spec.ratio} * cast({spec.share_b} as double), 0) as bigint), nb) as qb from pools),
quotas as (select *, least(target - qa - qb, nc) as qc from shares),
ranked as (select *, row_number() over (partition by stratum order by {order}) as r from slim),
picked as (select stay_id, stratum, case when stratum = 'P' then 'case' else 'quota' end as drawn from ranked, quotas
  where stratum = 'P' or (stratum = 'A' and r <= qa) or (stratum = 'B' and r <= qb) or (stratum = 'C' and r <= qc)),
rest as (select stay_id, stratum, row_number() over (order by {order}) as r from slim
  where stratum <> 'P' and stay_id not in (select stay_id from picked)),
fill as (select stay_id, stratum, 'fill' as drawn from rest, quotas where r <= target - qa - qb - qc),
selected as (select * from picked union all select * from fill)"""


def slim_sql(spec: StudySpec) -> str:
    """CTEs of the internal study up to ``selected``."""
    code = norm("icd_code")
    return (
        ctes(*INTERNAL_VIEWS)
        + f""",
cases as (select distinct hadm_id from fx_diagnoses where {strip('icd_code')} in ({quoted(spec.case_codes)})),
flags as (select hadm_id, bool_or({prefixes(code, spec.lookalike_prefixes)}) as lookalike,
  bool_or({prefixes(code, spec.risk_prefixes)}) as risk from fx_diagnoses group by hadm_id),
slim as (select s.stay_id, case when c.hadm_id is not null then 'P' when coalesce(f.lookalike, false) then 'A'
  when coalesce(f.risk, false) or regexp_matches(lower(coalesce(t.chiefcomplaint, '')), '{spec.keywords}') then 'B'
  else 'C' end as stratum
  from fx_stays s left join cases c on c.hadm_id = s.hadm_id left join flags f on f.hadm_id = s.hadm_id
  left join fx_triage t on t.stay_id = s.stay_id and t.subject_id = s.subject_id)"""
        + draw_sql(spec)
    )


def project(alias: str = "") -> str:
    kinds = {"timestamp_ntz": "timestamp", "string": "varchar"}
    return ", ".join(f"cast({alias}{c} as {kinds.get(t, t)}) as {c}" for c, t in COHORT_TYPES.items())


def internal_sql(spec: StudySpec) -> str:
    """CTEs of the internal study up to ``drawn_rows`` and the validated ``cohort``."""
    keep = " and ".join(f"coalesce({r}, false)" for r in rule_sql().values())
    return (
        slim_sql(spec)
        + f""",
drawn_rows as (select s.subject_id, s.stay_id, s.hadm_id, s.intime, s.outtime,
  cast(case when x.stratum = 'P' then 1 else 0 end as integer) as ie_label, coalesce(p.gender, s.gender) as gender,
  p.anchor_age, {race_case('a.race')} as race, t.temperature, t.heartrate, t.resprate, t.o2sat, t.sbp, t.dbp, t.acuity,
  {strip("coalesce(t.chiefcomplaint, '')")} as chiefcomplaint
  from selected x join fx_stays s on s.stay_id = x.stay_id
  left join fx_triage t on t.stay_id = s.stay_id and t.subject_id = s.subject_id
  left join fx_patients p on p.subject_id = s.subject_id left join fx_admissions a on a.hadm_id = s.hadm_id),
cohort as (select {project()} from drawn_rows where {keep})"""
    )


def mapped_sql() -> str:
    """``mapped``: visits in the cohort column space."""
    return f""",
mapped as (select MRN as subject_id, CSN as stay_id, CSN as hadm_id, Arrival_time as intime, Departure_time as outtime,
  Gender as gender, Age as anchor_age, Race as race, try_cast(Triage_Temp as double) * 9.0::double / 5.0::double + 32.0::double as temperature,
  Triage_HR as heartrate, Triage_RR as resprate, Triage_SpO2 as o2sat, Triage_SBP as sbp, Triage_DBP as dbp,
  try_cast(try_cast(nullif(regexp_extract(coalesce(Triage_acuity, ''), '^\\s*(\\d+)', 1), '') as integer) as double) as acuity,
  CC as chiefcomplaint, {norm('Dx_ICD9')} as dx9, {norm('Dx_ICD10')} as dx10 from fx_visits)"""


def external_sql(spec: StudySpec) -> str:
    """CTEs of the external study up to ``cohort``."""
    keep = " and ".join(f"coalesce({r}, false)" for r in rule_sql().values())
    cases = quoted([c.upper() for c in spec.case_codes])
    code = norm("Code")
    return (
        ctes("fx_visits", "fx_history")
        + mapped_sql()
        + f""",
past as (select MRN, bool_or({prefixes(code, spec.lookalike_prefixes)}) as lookalike,
  bool_or({prefixes(code, spec.risk_prefixes)}) as risk from fx_history group by MRN),
slim as (select m.stay_id, case when dx9 in ({cases}) or dx10 in ({cases}) then 'P'
  when coalesce(h.lookalike, false) or {prefixes('dx9', spec.lookalike_prefixes)} or {prefixes('dx10', spec.lookalike_prefixes)} then 'A'
  when coalesce(h.risk, false) or {prefixes('dx9', spec.risk_prefixes)} or {prefixes('dx10', spec.risk_prefixes)}
    or regexp_matches(lower(coalesce(chiefcomplaint, '')), '{spec.keywords}') then 'B' else 'C' end as stratum
  from mapped m left join past h on h.MRN = m.subject_id)"""
        + draw_sql(spec)
        + f""",
drawn_rows as (select m.* replace ({race_case('m.race', True)} as race, {strip("coalesce(m.chiefcomplaint, '')")} as chiefcomplaint),
  cast(case when x.stratum = 'P' then 1 else 0 end as integer) as ie_label
  from selected x join mapped m on m.stay_id = x.stay_id),
cohort as (select {project()} from drawn_rows where {keep})"""
    )


def views_sql(*names: str) -> str:
    return ctes(*names)


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "VIEWS")]
