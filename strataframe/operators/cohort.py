"""Case-control cohorts, end to end.

Selection runs on a slim table (stay id and stratum). Only the chosen stays are then joined to the wide
tables, whose rows are first reduced to the chosen keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from strataframe.functions.casts import c_to_f, leading_int, to_num, to_ts
from strataframe.functions.codes import code_in, code_in_any, code_prefix_any, normalize_code
from strataframe.functions.labels import RACE_EXTERNAL, RACE_INTERNAL, LabelRules, normalize_label
from strataframe.functions.text import RISK_KEYWORDS, clean_text, has_keyword
from strataframe.operators.filters import study_rules, validate
from strataframe.operators.joins import first_per_key, prefer
from strataframe.operators.sampling import (
    assign_stratum,
    fill_shortfall,
    flags_where_any,
    or_flags,
    plan_quotas,
    sample_n,
)
from strataframe.plans.keyfilter import may_hold
from strataframe.plans.spread import left_join
from strataframe.plans.storage import materialise
from strataframe.sources.tables import map_schema, project_cohort

# Case codes, hard-to-tell diagnoses and risk histories (code prefixes).
CASE_CODES = ("I33.0", "I330", "4210", "421.0", "I33.9", "I339", "4211", "421.1", "I38", "I39")
LOOKALIKE_PREFIXES = (
    "A40", "A41", "038",
    "J18", "J15", "4801", "481", "482", "484", "486", "487", "5168",
    "G00", "G03", "3209", "322",
    "R50",
    "M00", "M86", "0389", "730",
    "I63", "434",
    "I50", "428",
    "I30", "I40", "420", "42292",
)
RISK_PREFIXES = ("Z87891", "V1582", "3051", "Z95", "Z8739", "Z992", "V4511")

# External visit columns and their cohort names.
EXTERNAL_NAMES = {
    "MRN": "subject_id",
    "CSN": "stay_id",
    "Arrival_time": "intime",
    "Departure_time": "outtime",
    "Gender": "gender",
    "Age": "anchor_age",
    "Race": "race",
    "Triage_HR": "heartrate",
    "Triage_RR": "resprate",
    "Triage_SpO2": "o2sat",
    "Triage_SBP": "sbp",
    "Triage_DBP": "dbp",
    "CC": "chiefcomplaint",
}

CASE = "P"  # stratum mark of the cases


@dataclass(frozen=True)
class StudySpec:
    """What makes a case, what makes a control hard, and how many controls are wanted."""

    case_codes: Sequence[str] = CASE_CODES
    lookalike_prefixes: Sequence[str] = LOOKALIKE_PREFIXES
    risk_prefixes: Sequence[str] = RISK_PREFIXES
    keywords: str = RISK_KEYWORDS
    ratio: int = 10
    share_a: float = 0.40
    share_b: float = 0.35
    seed: int = 42
    upper_case_codes: bool = False
    strip_dots: bool = False
    race_rules: LabelRules = RACE_INTERNAL
    race_from: str = "admission"  # or "coalesce": keep the stay's own race where the admission has none


EXTERNAL_SPEC = StudySpec(upper_case_codes=True, race_rules=RACE_EXTERNAL)


@dataclass(frozen=True)
class HospitalTables:
    """Stays with hospital-wide diagnoses: the case label comes from any diagnosis of the admission."""

    stays: DataFrame
    measurements: DataFrame
    patients: DataFrame
    admissions: DataFrame
    diagnoses: DataFrame

    def strata(self, spec: StudySpec) -> DataFrame:
        code = F.col("icd_code")
        flags = flags_where_any(
            self.diagnoses,
            "hadm_id",
            {
                "is_case": code_in(code, spec.case_codes, spec.upper_case_codes),
                "lookalike": code_prefix_any(code, spec.lookalike_prefixes, spec.strip_dots),
                "risk": code_prefix_any(code, spec.risk_prefixes, spec.strip_dots),
            },
        )
        complaints = (
            self.measurements.filter(has_keyword("chiefcomplaint", spec.keywords))
            .select("subject_id", "stay_id")
            .distinct()
            .withColumn("keyword", F.lit(True))
        )
        stays = self.stays.select("subject_id", "stay_id", "hadm_id")
        flagged = left_join(stays, flags, ["hadm_id"], "stay_id")
        flagged = left_join(flagged, complaints, ["subject_id", "stay_id"], "stay_id", hot_from=stays)
        return flagged.select("stay_id", _stratum("is_case", "lookalike", or_flags(F.col("risk"), F.col("keyword"))))

    def rows(self, spec: StudySpec, chosen: DataFrame) -> DataFrame:
        # wide tables lose the rows of other stays before their only exchange, that of the joins below
        base = materialise(may_hold(self.stays, chosen, ["stay_id"]).join(chosen, "stay_id"), "chosen")
        # by the stay alone, which also reaches below a grouping by stay that measurements may come from
        vitals = may_hold(self.measurements, base, ["stay_id"])
        people = may_hold(self.patients, base, ["subject_id"]).select(
            "subject_id", F.col("gender").alias("_gender"), "anchor_age"
        )
        races = may_hold(self.admissions, base, ["hadm_id"]).select("hadm_id", F.col("race").alias("_race"))
        wide = left_join(base, vitals, ["subject_id", "stay_id"], "stay_id", hot_from=base)
        wide = left_join(wide, people, ["subject_id"], "stay_id", hot_from=base)
        races = first_per_key(races, "hadm_id", ["_race"])
        wide = left_join(wide, races, ["hadm_id"], "stay_id", hot_from=base)
        own = {c: F.col(c) if c in self.stays.columns else F.lit(None).cast("string") for c in ("gender", "race")}
        race = F.col("_race") if spec.race_from == "admission" else prefer(F.col("_race"), own["race"])
        return wide.withColumns({"gender": prefer(F.col("_gender"), own["gender"]), "race": race})


@dataclass(frozen=True)
class VisitTables:
    """Visits with one primary diagnosis each, and a per-patient history of codes.

    Where visits are themselves joined, ``marked`` gives them with a flag of the raw complaint in the complaint's place,
    found before those joins, so that strata are told without moving texts. ``apart`` gives visits with an address in the
    complaint's place, once for each address, and the complaints as (stay, ``address``, complaint), one for each raw
    visit: texts then pass the one join that ends the rows.
    """

    visits: DataFrame
    history: DataFrame
    names: dict[str, str] = field(default_factory=lambda: dict(EXTERNAL_NAMES))
    marked: Callable[[Callable[[Column], Column]], DataFrame] | None = None
    apart: tuple[DataFrame, DataFrame] | None = None

    def mapped(self) -> DataFrame:
        return map_visits(self.visits, self.names)

    def _with_keyword(self, spec: StudySpec) -> DataFrame:
        """Mapped visits with the flag ``keyword``."""
        if self.marked is None:
            return self.mapped().withColumn("keyword", has_keyword("chiefcomplaint", spec.keywords))
        visits = self.marked(lambda complaint: has_keyword(complaint, spec.keywords))
        return map_visits(visits, self.names).withColumnRenamed("chiefcomplaint", "keyword")

    def strata(self, spec: StudySpec) -> DataFrame:
        visits = self._with_keyword(spec)
        code = F.col("Code")
        flags = flags_where_any(
            self.history,
            "MRN",
            {
                "past_lookalike": code_prefix_any(code, spec.lookalike_prefixes, spec.strip_dots),
                "past_risk": code_prefix_any(code, spec.risk_prefixes, spec.strip_dots),
            },
        ).withColumnRenamed("MRN", "subject_id")
        own = ["dx_icd9_norm", "dx_icd10_norm"]
        slim = visits.select(
            "subject_id",
            "stay_id",
            code_in_any(own, spec.case_codes).alias("is_case"),
            or_flags(*[code_prefix_any(c, spec.lookalike_prefixes, spec.strip_dots) for c in own]).alias("lookalike"),
            or_flags(*[code_prefix_any(c, spec.risk_prefixes, spec.strip_dots) for c in own]).alias("risk"),
            "keyword",
        )
        keys = visits.select("subject_id")
        flagged = left_join(slim, flags, ["subject_id"], "stay_id", hot_from=keys)
        lookalike = or_flags(F.col("lookalike"), F.col("past_lookalike"))
        moderate = or_flags(F.col("risk"), F.col("past_risk"), F.col("keyword"))
        return flagged.select("stay_id", _stratum("is_case", lookalike, moderate))

    def rows(self, spec: StudySpec, chosen: DataFrame) -> DataFrame:
        if self.apart is None:
            return may_hold(self.mapped(), chosen, ["stay_id"]).join(chosen, "stay_id")
        visits, complaints = self.apart
        slim = may_hold(map_visits(visits, self.names), chosen, ["stay_id"]).join(chosen, "stay_id")
        texts = may_hold(complaints.withColumnsRenamed(self.names), chosen, ["stay_id"]).select("address", "chiefcomplaint")
        wide = slim.withColumnRenamed("chiefcomplaint", "address").join(texts, "address")
        return wide.select(*slim.columns)


@dataclass(frozen=True)
class Cohort:
    """The validated cohort and the counts that describe how it was drawn."""

    rows: DataFrame
    drawn: DataFrame  # the same stays before validation
    strata: DataFrame  # every stay with its stratum
    counts: dict[str, int]


def map_visits(visits: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """External visits in the cohort column space; there is no admission, so the stay stands in."""
    return map_schema(
        visits,
        names or EXTERNAL_NAMES,
        {
            "hadm_id": F.col("stay_id"),
            "temperature": c_to_f(F.col("Triage_Temp").cast("string")),
            "acuity": leading_int("Triage_acuity").cast("double"),
            "dx_icd9_norm": normalize_code("Dx_ICD9"),
            "dx_icd10_norm": normalize_code("Dx_ICD10"),
        },
    )


def draw_controls(strata: DataFrame, spec: StudySpec) -> tuple[DataFrame, dict[str, int]]:
    """Cases and sampled controls as ``(stay_id, ie_label, stratum, drawn)``, with the draw's counts.

    ``strata`` is read several times and should be a stored table.
    """
    pools = {r["stratum"]: r["n"] for r in strata.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).collect()}
    cases = pools.pop(CASE, 0)
    if cases == 0:
        raise ValueError("the study has no case: no control can be drawn")
    quotas = plan_quotas(pools, cases, spec.ratio, spec.share_a, spec.share_b)
    target, have = cases * spec.ratio, sum(quotas.values())
    controls = strata.filter(F.col("stratum") != CASE)
    picked = sample_n(strata, "stratum", {CASE: cases, **quotas}, spec.seed, "stay_id").withColumn(
        "drawn", F.when(F.col("stratum") == CASE, "case").otherwise("quota")
    )
    fill = min(target, sum(pools.values())) - have
    if fill > 0:
        picked = materialise(picked, "picked")
        extra = fill_shortfall(controls, picked, target, have, spec.seed, "stay_id")
        picked = picked.unionByName(extra.withColumn("drawn", F.lit("fill")))
    counts = {"cases": cases, "target": target, "controls": have + fill, "fill": fill}
    counts |= {f"pool_{s}": pools.get(s, 0) for s in "ABC"} | {f"sampled_{s}": quotas[s] for s in "ABC"}
    return picked.withColumn("ie_label", (F.col("stratum") == CASE).cast("int")), counts


def clean_rows(wide: DataFrame, spec: StudySpec) -> DataFrame:
    """Race groups, trimmed complaints and coerced ids, times and numbers of the drawn stays; bad input is NULL."""
    numbers = ["anchor_age", "temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp", "acuity"]
    text = {f.name for f in wide.schema.fields if f.dataType.simpleString() == "string"}
    ids = [c for c in ("subject_id", "stay_id", "hadm_id") if c in text]
    times = [c for c in ("intime", "outtime") if c in text]
    return wide.withColumns(
        {
            # whole numbers as they are, since a double would round large ids; '12.0' by way of a double
            **{c: F.coalesce(F.trim(c).try_cast("bigint"), to_num(c, "bigint")) for c in ids},
            **{c: to_ts(c) for c in times},
            **{c: to_num(c, is_text=c in text) for c in numbers},
            "race": normalize_label("race", spec.race_rules),
            "chiefcomplaint": clean_text("chiefcomplaint"),
        }
    )


def build_cohort(tables: HospitalTables | VisitTables, spec: StudySpec) -> Cohort:
    strata = materialise(tables.strata(spec), "strata")
    picked, counts = draw_controls(strata, spec)
    chosen = materialise(picked.select("stay_id", "ie_label"), "picked")
    drawn = clean_rows(tables.rows(spec, chosen), spec)
    rows = project_cohort(validate(drawn, study_rules()))
    return Cohort(rows, drawn, strata, counts)


def _stratum(is_case: str, lookalike: Column | str, moderate: Column) -> Column:
    lookalike = F.col(lookalike) if isinstance(lookalike, str) else lookalike
    return (
        F.when(F.coalesce(F.col(is_case), F.lit(False)), CASE)
        .otherwise(assign_stratum(or_flags(lookalike), moderate))
        .alias("stratum")
    )
