"""Study tables derived from the driver tables. The same SQL text runs on Spark and as oracle CTEs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strataframe.functions.labels import RACE_EXTERNAL
from strataframe.operators.cohort import Cohort, HospitalTables, StudySpec, VisitTables, build_cohort
from strataframe.plans.storage import fresh_path
from strataframe.sources.tables import read_cohort, scan, write_cohort

VIEWS = {
    "fx_stays": """
select o.o_orderkey as stay_id, o.o_custkey as subject_id,
  case when o.o_orderkey % 4 = 0 then null else o.o_orderkey end as hadm_id,
  o.o_orderdate as intime, l.outtime,
  case when o.o_orderkey % 5 = 0 then null when o.o_orderkey % 3 = 0 then 'F' else 'M' end as gender,
  o.o_orderpriority as acuity_raw
from {orders} o left join (select l_orderkey, max(l_shipdate) as outtime from {lineitem} group by l_orderkey) l
  on l.l_orderkey = o.o_orderkey""",
    "fx_triage": """
select o.o_custkey as subject_id, v.*,
  case when v.stay_id % 37 = 9 then null else cast(substring(o.o_orderpriority, 1, 1) as double) end as acuity
from (
  select l_orderkey as stay_id,
    case when l_orderkey % 13 = 5 then null else 94 + max(l_discount) * 120 end as temperature,
    case when l_orderkey % 17 = 3 then null else max(l_quantity) * 4 end as heartrate,
    case when l_orderkey % 11 = 2 then null else min(l_quantity) end as resprate,
    case when l_orderkey % 19 = 7 then null else 100 - min(l_tax) * 500 end as o2sat,
    case when l_orderkey % 23 = 1 then null else 60 + max(l_quantity) * 4 end as sbp,
    case when l_orderkey % 29 = 4 then null else 30 + min(l_quantity) * 3 end as dbp,
    min(p_name) as chiefcomplaint
  from {lineitem} left join {part} on p_partkey = l_partkey where l_orderkey % 31 <> 0 group by l_orderkey
) v join {orders} o on o.o_orderkey = v.stay_id""",
    "fx_diagnoses": """
select l_orderkey as hadm_id, concat(' ', p_brand, '-', p_type, ' ') as icd_code
from {lineitem} join {part} on p_partkey = l_partkey""",
    "fx_patients": """
select c_custkey as subject_id,
  case when c_custkey % 37 = 0 then null when c_custkey % 2 = 0 then 'F' else 'M' end as gender,
  cast(floor((c_acctbal + 1000) / 90) as double) as anchor_age
from {customer}""",
    "fx_admissions": """
select o_orderkey as hadm_id,
  case c_mktsegment when 'MACHINERY' then 'WHITE - OTHER' when 'BUILDING' then ' black/african '
    when 'AUTOMOBILE' then 'ASIAN - X' when 'HOUSEHOLD' then 'UNABLE TO OBTAIN'
    else case when c_custkey % 3 = 0 then null when c_custkey % 3 = 1 then '' else 'HISPANIC/LATINO' end end as race
from {orders} join {customer} on c_custkey = o_custkey""",
    # scored rows: the label is the top priority, scores have ties
    "fx_scores": """
select o_orderkey as stay_id, o_orderstatus as option, concat('m', cast(o_custkey % 2 as string)) as model,
  cast(o_orderkey % 5 as int) as fold,
  case when o_orderpriority = '1-URGENT' then 1 else 0 end as label,
  cast((o_orderkey * 7919 + o_custkey * 104729) % 1000
    + case when o_orderpriority = '1-URGENT' then 150 else 0 end as double) / 1150 as prob
from {orders}""",
    "fx_visits": """
select d.n_chars % 997 as MRN, d.doc_id as CSN, a.ts as Arrival_time, b.ts as Departure_time,
  case when d.doc_id % 3 = 0 then null else concat(d.lang, cast(d.doc_id % 7 as string)) end as Dx_ICD9,
  concat(' ', d.source, '-', d.lang, ' ') as Dx_ICD10, d.text as CC,
  case when d.doc_id % 41 = 0 then null when d.n_chars % 2 = 0 then 'F' else 'M' end as Gender,
  cast(d.n_chars % 125 as double) as Age,
  case d.doc_id % 9 when 0 then 'white' when 1 then ' Black ' when 2 then 'Asian Indian'
    when 3 then 'Declines to State' when 4 then '' when 5 then 'Latino' when 6 then null
    when 7 then 'Unknown' else 'Pacific' end as Race,
  case when d.doc_id % 13 = 4 then null when d.doc_id % 29 = 3 then 'n/a'
    else concat(cast(36 + d.n_chars % 4 as string), '.', cast(d.n_chars % 10 as string)) end as Triage_Temp,
  case when d.doc_id % 17 = 2 then null else cast(45 + d.n_chars % 160 as double) end as Triage_HR,
  case when d.doc_id % 19 = 5 then null else cast(9 + d.n_chars % 30 as double) end as Triage_RR,
  case when d.doc_id % 23 = 8 then null else cast(72 + d.n_chars % 30 as double) end as Triage_SpO2,
  cast(75 + d.n_chars % 170 as double) as Triage_SBP, cast(45 + d.n_chars % 100 as double) as Triage_DBP,
  case d.doc_id % 11 when 0 then null when 1 then '' when 2 then 'bad'
    else concat(' ', cast(1 + d.doc_id % 6 as string), '-Level') end as Triage_acuity
from {documents} d left join {events} a on a.event_id = d.doc_id
  left join {events} b on b.event_id = case when d.doc_id % 31 = 6 then d.doc_id - 1 else d.doc_id + 1 + d.n_chars % 5 end""",
    "fx_history": """
select d.n_chars % 997 as MRN, concat(' q', cast(l.quality as string), 't', cast(l.toxic as string)) as Code
from {labels} l join {documents} d on d.doc_id = l.doc_id
union all
select conv_id % 997 as MRN, concat(role, '-', cast(turn as string)) as Code from {conversations}""",
}

# The synthetic study on these tables: codes and prefixes that occur in them.
BASE_SPEC = StudySpec(
    case_codes=("Brand#17-PROMO", "Brand#3-ECONOMY"),
    lookalike_prefixes=("BRAND#24", "BRAND#8"),
    risk_prefixes=("BRAND#11",),
    keywords="cold",
)
WIDE_SPEC = StudySpec(
    case_codes=BASE_SPEC.case_codes,
    lookalike_prefixes=BASE_SPEC.lookalike_prefixes,
    risk_prefixes=BASE_SPEC.risk_prefixes,
    keywords="blue|cold|hot|large|new",
)
VISIT_SPEC = StudySpec(
    case_codes=("src3-en", "SRC7-DE", "fr5"),
    lookalike_prefixes=("SRC1", "Q0T1", "ES2"),
    risk_prefixes=("SRC5", "Q0", "ASSISTANT-7"),
    keywords="license|password|e-mail",
    upper_case_codes=True,
    race_rules=RACE_EXTERNAL,
)
# Words of the product names, as complaint categories.
NAME_RULES = {
    "cold": r"\b(cold|blue)\b",
    "heat": r"\b(hot|red)\b",
    "size": r"\b(large|small)\b",
    "age": r"\b(new|old)\b",
    "metal": r"\b(anvil|bolt|plate)\b",
    "moving": r"\b(gear|ring|rod)\b",
    "device": r"\b(gizmo|widget)\b",
    "small rod": r"\b(small rod|small ring)\b",
}


def tables_of(name: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", VIEWS[name])))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A study table as a DataFrame, or a driver table as it is."""
    if name not in VIEWS:
        return scan(spark, f"{sf_dir}/{name}.parquet", nan_is_missing=False)
    return spark.sql(VIEWS[name], **{t: view(spark, sf_dir, t) for t in tables_of(name)})


def ctes(*names: str) -> str:
    """The named views as oracle CTEs: ``with a as (..), b as (..)``."""
    parts = [f"{n} as ({VIEWS[n].format(**{t: t for t in tables_of(n)})})" for n in names]
    return "with " + ",\n".join(parts)


def hospital(spark: SparkSession, sf_dir: str) -> HospitalTables:
    return HospitalTables(
        stays=view(spark, sf_dir, "fx_stays"),
        measurements=view(spark, sf_dir, "fx_triage"),
        patients=view(spark, sf_dir, "fx_patients"),
        admissions=view(spark, sf_dir, "fx_admissions"),
        diagnoses=view(spark, sf_dir, "fx_diagnoses"),
    )


def visits(spark: SparkSession, sf_dir: str) -> VisitTables:
    tables = {t: view(spark, sf_dir, t) for t in tables_of("fx_visits")}
    documents = tables["documents"]

    def of(rows: DataFrame) -> DataFrame:
        return spark.sql(VIEWS["fx_visits"], **{**tables, "documents": rows})

    def marked(flag: Callable[[Column], Column]) -> DataFrame:
        """The visits with the flag in the place of the text, which then passes no join."""
        return of(documents.withColumn("text", flag(F.col("text"))))

    # a text's address is the rest of its row: rows that differ in the text alone have the same visits
    rest = [c for c in documents.columns if c != "text"]
    address = F.struct(*rest)
    slim = of(documents.select(*rest).distinct().withColumn("text", address))
    texts = documents.select(F.col("doc_id").alias("CSN"), address.alias("address"), F.col("text").alias("CC"))
    return VisitTables(of(documents), view(spark, sf_dir, "fx_history"), marked=marked, apart=(slim, texts))


def internal(spark: SparkSession, sf_dir: str, spec: StudySpec = BASE_SPEC) -> Cohort:
    return build_cohort(hospital(spark, sf_dir), spec)


def external(spark: SparkSession, sf_dir: str) -> Cohort:
    return build_cohort(visits(spark, sf_dir), VISIT_SPEC)


_stored: dict[tuple, str] = {}


def stored_cohort(spark: SparkSession, sf_dir: str, which: str = "internal") -> DataFrame:
    """The cohort table later steps start from, written once per session and source folder."""
    key = (spark.sparkContext.applicationId, sf_dir, which)
    if key not in _stored:
        path = fresh_path(spark, f"{which}_cohort")
        write_cohort((internal if which == "internal" else external)(spark, sf_dir).rows, path)
        _stored[key] = path
    return read_cohort(spark, _stored[key])
