"""Queries for counts, descriptive tables and distributions (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.functions.labels import RACE_REPORT, map_values, normalize_label
from strataframe.functions.text import keyword_categories
from strataframe.operators import describe, distributions
from strataframe.operators.features import median_impute, mode_impute
from strataframe.operators.joins import flag_in_keys, left
from strataframe.functions.codes import code_in
from suite.registry import query, rounded
from suite.sql import external_sql, internal_sql, quoted, r6 as R, strip
from suite.tables_and_rules import REPORT_RACE
from suite.views import (
    BASE_SPEC,
    NAME_RULES,
    VISIT_SPEC,
    WIDE_SPEC,
    ctes,
    hospital,
    internal,
    stored_cohort,
    view,
)

COHORT = internal_sql(BASE_SPEC)
EXTERNAL = external_sql(VISIT_SPEC)
CONT = describe.CONTINUOUS
VITALS = describe.VITALS

_CODES = f"{strip('icd_code')} in ({quoted(BASE_SPEC.case_codes)})"
_LABELLED = (
    ctes("fx_stays", "fx_triage", "fx_diagnoses")
    + f", wide as (select s.stay_id, t.* exclude (stay_id, subject_id), cast(case when s.hadm_id in (select hadm_id from fx_diagnoses where {_CODES})"
    + " then 1 else 0 end as integer) as label from fx_stays s left join fx_triage t on t.stay_id = s.stay_id and t.subject_id = s.subject_id)"
)


def _labelled(spark, sf):
    stays = view(spark, sf, "fx_stays").select("subject_id", "stay_id", "hadm_id")
    cases = view(spark, sf, "fx_diagnoses").filter(code_in("icd_code", BASE_SPEC.case_codes))
    wide = left(stays, view(spark, sf, "fx_triage"), ["subject_id", "stay_id"], "stay_id")
    return flag_in_keys(wide, cases, "hadm_id", "label", "stay_id", hot_from=stays)


@query(
    "d01_case_counts",
    ctes("fx_diagnoses") + f" select count(*) as events, count(distinct hadm_id) as keys from fx_diagnoses where {_CODES}",
)
def d01(spark, sf):
    return describe.case_counts(view(spark, sf, "fx_diagnoses"), BASE_SPEC.case_codes)


@query(
    "d02_prevalence",
    _LABELLED
    + f" select count(*) as total, count(*) filter (label = 1) as positive, count(*) filter (label = 0) as negative,"
    + f" {R('100.0::double * count(*) filter (label = 1) / count(*)')} as rate_pct from wide",
)
def d02(spark, sf):
    return rounded(describe.prevalence(_labelled(spark, sf), "label"))


_AVAILABLE = [*VITALS, "acuity", "chiefcomplaint"]


def _availability_sql() -> str:
    parts = []
    for scope, keep in (("all", "true"), ("positive", "label = 1")):
        for c in _AVAILABLE:
            m = f"avg(case when {c} is null then 1.0::double else 0.0::double end)"
            parts.append(
                f"select '{c}' as variable, '{scope}' as scope, {R(m)} as missing_frac, {R(f'100 - 100 * {m}')} as present_pct from wide where {keep}"
            )
    return _LABELLED + " " + " union all ".join(parts)


@query("d03_availability", _availability_sql())
def d03(spark, sf):
    return rounded(describe.availability(_labelled(spark, sf), _AVAILABLE, "label"))


def _present(c: str) -> str:
    return f"printf('%.2f', 100 - 100 * avg(case when {c} is null then 1.0::double else 0.0::double end))"


@query(
    "d04_feasibility",
    _LABELLED
    + " select unnest(['total_ed_stays', 'ie_ed_stays', 'non_ie_ed_stays', 'ie_rate_pct', 'esi_collected_pct',"
    + " 'chief_complaint_present_pct', 'temp_present_pct']) as metric, unnest([count(*)::varchar, (count(*) filter (label = 1))::varchar,"
    + " (count(*) filter (label = 0))::varchar, printf('%.2f', 100.0::double * count(*) filter (label = 1) / count(*)),"
    + f" {_present('acuity')}, {_present('chiefcomplaint')}, {_present('temperature')}]) as value from wide",
)
def d04(spark, sf):
    return describe.feasibility(hospital(spark, sf), BASE_SPEC)


@query(
    "d05_cohort_summary",
    internal_sql(WIDE_SPEC)
    + ", got as (select count(*) filter (drawn <> 'case') as controls, count(*) filter (drawn = 'fill') as filled from selected)"
    + " select unnest(['ie_positive_count', 'target_negative_controls', 'selected_negative_controls', 'final_negative_positive_ratio',"
    + " 'stratum_a_pool', 'stratum_b_pool', 'stratum_c_pool', 'stratum_a_sampled', 'stratum_b_sampled', 'stratum_c_sampled', 'fill_sampled']) as metric,"
    + " unnest([np::varchar, target::varchar, controls::varchar, printf('%.2f', controls::double / np) || ':1', na::varchar, nb::varchar, nc::varchar,"
    + " qa::varchar, qb::varchar, qc::varchar, filled::varchar]) as value from quotas, got",
)
def d05(spark, sf):
    return describe.cohort_summary(internal(spark, sf, WIDE_SPEC))


_AUDITED = [*CONT, "gender", "race"]


@query(
    "d06_missing_audit",
    COHORT
    + " "
    + " union all ".join(
        f"select '{c}' as variable, count(*) filter ({c} is null) as missing_before,"
        + (" 0::bigint" if c in ("acuity", "gender", "race") else f" count(*) filter ({c} is null)")
        + " as missing_after from cohort"
        for c in _AUDITED
    ),
)
def d06(spark, sf):
    rows = stored_cohort(spark, sf)
    return describe.missing_audit(rows, mode_impute(median_impute(rows, ["acuity"]), ["gender", "race"]), _AUDITED)


def _levels_sql(cats, label="ie_label", table="cohort") -> str:
    parts = []
    for c in cats:
        counts = [("total", "count(*)")] + [(f"label_{v}", f"count(*) filter ({label} = {v})") for v in (0, 1)]
        cells = ", ".join(f"{e} as {n}, {e} * 100.0::double / nullif((select {e} from {table}), 0) as {n}_pct" for n, e in counts)
        parts.append(f"select '{c}' as variable, cast({c} as varchar) as level, {cells} from {table} group by {c}")
    return " union all ".join(parts)


_CATS = ["ie_label", "gender", "race", "chiefcomplaint"]


@query(
    "d07_cat_stats",
    COHORT
    + f", l as ({_levels_sql(_CATS)}) select variable, level, total, label_0, label_1, "
    + ", ".join(f"{R(f'{g}_pct')} as {g}_pct" for g in ("total", "label_0", "label_1"))
    + " from l",
)
def d07(spark, sf):
    return rounded(describe.cat_stats(stored_cohort(spark, sf), _CATS, "ie_label"))


def _stats_sql(cols, group="ie_label", table="cohort", total=True) -> str:
    parts = []
    groups = [(f"cast({group} as varchar)", f"group by {group}")] + ([("'Total'", "")] if total else [])
    for c in cols:
        for g, by in groups:
            parts.append(
                f'select {g} as "group", \'{c}\' as variable, count(*) as n, count(*) filter ({c} is null) as missing_n,'
                f" 100.0::double * count(*) filter ({c} is null) / count(*) as missing_pct, avg({c}) as mean, stddev_samp({c}) as sd,"
                f" quantile_cont({c}, 0.5) as median, quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from {table} {by}"
            )
    return " union all ".join(parts)


_STAT_NUMBERS = ["missing_pct", "mean", "sd", "median", "q1", "q3"]


@query(
    "d08_cont_stats",
    COHORT
    + f', s as ({_stats_sql(CONT)}) select "group", variable, n, missing_n, '
    + ", ".join(f"{R(c)} as {c}" for c in _STAT_NUMBERS)
    + " from s",
)
def d08(spark, sf):
    return rounded(describe.cont_stats(stored_cohort(spark, sf), CONT, "ie_label"))


def _table_one_sql(cohort: str) -> str:
    cats, groups = ["ie_label", "gender", "race"], ["total", "label_0", "label_1"]
    at = {v: 10**12 * (i + 1) for i, v in enumerate([*cats, *CONT])}
    starts = "case variable " + " ".join(f"when '{v}' then {p}" for v, p in at.items()) + " end"

    def counted(g: str) -> str:
        return f"concat({g}::varchar, ' (', printf('%.0f', {g}_pct), '%)') as {g}"

    present = ", ".join(f"coalesce(max({g}) filter (level is null), 0) as {g}, coalesce(max({g}_pct) filter (level is null), 0) as {g}_pct" for g in groups)
    heads = " union all ".join(f"select {p}, '{v}', '', '', ''" for v, p in at.items())

    def line(expr: str, text: str, k: int) -> str:
        cells = ", ".join(f"max({expr}) filter (\"group\" = '{key}')" for key in ("Total", "0", "1"))
        return f"select {starts} + {k}, '  {text}', {cells} from s group by variable"

    f1 = "printf('%.1f', {})".format
    return (
        cohort
        + f", l as ({_levels_sql(cats)}), s as ({_stats_sql(CONT)}),"
        + " rows_ as (select variable, level, total, label_0, label_1, total_pct, label_0_pct, label_1_pct, 0 as late from l where level is not null"
        + f" union all select variable, 'Missing', {', '.join(f'{g}' for g in groups)}, {', '.join(f'{g}_pct' for g in groups)}, 1 from"
        + f" (select variable, {present}, bool_or(coalesce(level = 'Missing', false)) as shown from l group by variable) where not shown),"
        + f" t as (select cast({starts} + row_number() over (partition by variable order by late, level) as bigint) as pos,"
        + f" concat('  ', level) as \"Variable\", {', '.join(counted(g) for g in groups)} from rows_"
        + " union all select 0, 'N', count(*)::varchar, (count(*) filter (ie_label = 0))::varchar, (count(*) filter (ie_label = 1))::varchar from cohort"
        + f" union all {heads} union all "
        + line(f"concat({f1('mean')}, ' (', {f1('sd')}, ')')", "Mean (SD)", 1)
        + " union all "
        + line(f"concat({f1('median')}, ' [', {f1('q1')}, '-', {f1('q3')}, ']')", "Median [Q1-Q3]", 2)
        + " union all "
        + line("concat(missing_n::varchar, ' (', printf('%.0f', missing_pct), '%)')", "Missing", 3)
        + ') select pos, "Variable", total as "Total", label_0, label_1 from t'
    )


@query("d09_table_one", _table_one_sql(COHORT))
def d09(spark, sf):
    return describe.table_one(stored_cohort(spark, sf))


@query("d10_table_two", _table_one_sql(EXTERNAL))
def d10(spark, sf):
    return describe.table_one(stored_cohort(spark, sf, "external"))


GROUP = "case ie_label when 1 then 'IE Case' when 0 then 'Control' end"
GROUPS = {1: "IE Case", 0: "Control"}


def _grouped(spark, sf):
    return stored_cohort(spark, sf).withColumns(
        {"grp": map_values("ie_label", GROUPS), "race_group": normalize_label("race", RACE_REPORT)}
    )


_GROUPED = COHORT + f", g as (select *, {GROUP} as grp, {REPORT_RACE.format(c='race')} as race_group from cohort)"


def _share_sql(c: str, level: str) -> str:
    return (
        f"select '{c}' as variable, grp, level, count, {R('count::double / sum(count) over (partition by grp) * 100.0')} as pct from"
        f" (select grp, {level} as level, count(*) as count from g where {c} is not null group by all)"
    )


@query(
    "d11_group_share",
    _GROUPED
    + " "
    + " union all ".join(
        [_share_sql("gender", "gender"), _share_sql("race_group", "race_group"), _share_sql("acuity", "cast(cast(acuity as integer) as varchar)")]
    ),
)
def d11(spark, sf):
    rows = _grouped(spark, sf).withColumn("acuity", F.col("acuity").cast("int").cast("string"))
    shares = [
        describe.group_share(rows, "grp", c).withColumnRenamed(c, "level").withColumn("variable", F.lit(c))
        for c in ("gender", "race_group", "acuity")
    ]
    return rounded(shares[0].unionByName(shares[1]).unionByName(shares[2]))


@query(
    "d12_level_order",
    _GROUPED + ", c as (select race_group, count(*) as n from g group by 1)"
    " select race_group, n, cast(row_number() over (order by n desc, race_group) as integer) as place from c",
)
def d12(spark, sf):
    return describe.level_order(_grouped(spark, sf), "race_group")


def _summary_sql() -> str:
    f = "printf('%.1f', {})".format
    cells = []
    for v in VITALS:
        cells.append(f"concat({f(f'avg({v})')}, ' (', {f(f'stddev_samp({v})')}, ')') as \"{v} mean (SD)\"")
        cells.append(
            f"{f(f'100.0::double * count(*) filter ({v} is null) / count(*)')} as \"{v} missing (%)\""
        )
    q = "printf('%.0f', quantile_cont(anchor_age, {}))".format
    return (
        _GROUPED
        + " select grp as \"Group\", count(*) as \"N\", printf('%.1f', avg(case when gender = 'M' then 1.0::double else 0.0::double end) * 100) as \"Male (%)\","
        + f" concat({f('avg(anchor_age)')}, ' (', {f('stddev_samp(anchor_age)')}, ')') as \"Age mean (SD)\","
        + f" concat({q(0.5)}, ' [', {q(0.25)}, '-', {q(0.75)}, ']') as \"Age median [IQR]\", "
        + ", ".join(cells)
        + " from g group by grp"
    )


@query("d13_demographic_summary", _summary_sql())
def d13(spark, sf):
    return describe.demographic_summary(_grouped(spark, sf), "grp")


def _corr_sql() -> str:
    whole = " and ".join(f"{c} is not null" for c in CONT)
    pairs = " union all ".join(
        f"select grp as \"group\", '{a}' as a, '{b}' as b, {R(f'corr({a}, {b})')} as r from d group by grp" for a in CONT for b in CONT
    )
    return _GROUPED + f", d as (select * from g where {whole}) {pairs}"


@query("d14_corr_matrix", _corr_sql())
def d14(spark, sf):
    return rounded(describe.corr_matrix(_grouped(spark, sf), CONT, "grp"))


@query(
    "d15_histogram",
    _GROUPED
    + ", span as (select min(anchor_age) as lo, max(anchor_age) as hi from g),"
    + " placed as (select grp, least(floor((anchor_age - lo) / (hi - lo) * 30), 29)::integer as bin from g, span where anchor_age is not null),"
    + " sizes as (select grp, count(*) as size from placed group by 1), bins as (select unnest(range(30))::integer as bin),"
    + " counts as (select grp, bin, count(*) as n from placed group by all)"
    + f" select s.grp as \"group\", b.bin, {R('lo + b.bin * ((hi - lo) / 30)')} as \"left\", {R('lo + (b.bin + 1) * ((hi - lo) / 30)')} as \"right\","
    + f" coalesce(n, 0) as n, {R('coalesce(n, 0) / (size * ((hi - lo) / 30))')} as density"
    + " from sizes s cross join bins b cross join span left join counts c on c.grp = s.grp and c.bin = b.bin",
)
def d15(spark, sf):
    return rounded(distributions.histogram(_grouped(spark, sf), "anchor_age", "grp"))


def _kde_sql(cols, grid: int, common: bool) -> str:
    long = " union all ".join(f"select grp, '{c}' as variable, {c} as v from g where {c} is not null" for c in cols)
    lo, hi = ("min(own_lo) over (partition by variable)", "max(own_hi) over (partition by variable)") if common else ("own_lo", "own_hi")
    return (
        f"long as ({long}), counts as (select grp, variable, v, count(*) as n from long group by all),"
        " plan0 as (select grp, variable, count(*) as size, stddev_samp(v) * pow(count(*)::double, -0.2) as bw, min(v) as own_lo, max(v) as own_hi from long group by all),"
        f" plan as (select *, {lo} as lo, {hi} as hi from plan0),"
        f" grid as (select grp, variable, size, bw, cast(k as integer) as point, lo + k * ((hi - lo) / {grid - 1}) as x from plan, range({grid}) t(k)),"
        " kd as (select p.grp as \"group\", p.variable, p.point, max(p.x) as x,"
        " sum(c.n * exp(-0.5 * pow((p.x - c.v) / p.bw, 2))) / (max(p.size) * max(p.bw) * sqrt(2 * pi())) as density"
        " from grid p join counts c on c.grp = p.grp and c.variable = p.variable group by p.grp, p.variable, p.point)"
    )


@query(
    "d16_kde",
    _GROUPED + ", " + _kde_sql(["anchor_age"], 200, True) + f' select "group", variable, point, {R("x")} as x, {R("density")} as density from kd',
)
def d16(spark, sf):
    return rounded(distributions.kde(_grouped(spark, sf), ["anchor_age"], "grp"))


def _box_sql() -> str:
    long = " union all ".join(f"select grp, '{c}' as variable, {c} as v from g where {c} is not null" for c in VITALS)
    return (
        _GROUPED
        + f", long as ({long}), q as (select grp, variable, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as median, quantile_cont(v, 0.75) as q3 from long group by all)"
        + ' select l.grp as "group", l.variable, '
        + ", ".join(f"{R(c)} as {c}" for c in ("q1", "median", "q3"))
        + f", {R('least(min(v) filter (v >= q1 - 1.5 * (q3 - q1)), q1)')} as whisker_lo, {R('greatest(max(v) filter (v <= q3 + 1.5 * (q3 - q1)), q3)')} as whisker_hi,"
        + " count(*) filter (v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) as outliers"
        + " from long l join q on q.grp = l.grp and q.variable = l.variable group by l.grp, l.variable, q1, median, q3"
    )


@query("d17_box_stats", _box_sql())
def d17(spark, sf):
    return rounded(distributions.box_stats(_grouped(spark, sf), VITALS, "grp"))


@query(
    "d18_violin_stats",
    _GROUPED
    + ", "
    + _kde_sql(VITALS, 100, False)
    + ", q as (select grp, variable, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as median, quantile_cont(v, 0.75) as q3 from long group by all)"
    + ' select k."group", k.variable, k.point, '
    + ", ".join(f"{R(c)} as {c}" for c in ("x", "density", "q1", "median", "q3"))
    + ' from kd k join q on q.grp = k."group" and q.variable = k.variable',
)
def d18(spark, sf):
    return rounded(distributions.violin_stats(_grouped(spark, sf), VITALS, "grp"))


_HITS = {n: f"regexp_matches(lower(coalesce(chiefcomplaint, '')), '{p}')" for n, p in NAME_RULES.items()}


@query(
    "d19_category_coverage",
    ctes("fx_triage")
    + f" select 'any' as category, count(*) filter ({' or '.join(_HITS.values())}) as n from fx_triage"
    + " union all select 'rows', count(*) from fx_triage union all "
    + " union all ".join(f"select '{n}', count(*) filter ({h}) from fx_triage" for n, h in _HITS.items()),
)
def d19(spark, sf):
    rows = view(spark, sf, "fx_triage").withColumn("categories", keyword_categories("chiefcomplaint", NAME_RULES))
    return describe.category_coverage(rows, "categories", list(NAME_RULES))
