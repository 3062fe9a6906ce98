"""Queries for features, splits and models (F and G)."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from strataframe.functions.text import COMPLAINT_CATEGORIES
from strataframe.operators import embed, features, matrix, models, splits
from strataframe.operators.evaluate import metrics
from strataframe.operators.joins import left
from strataframe.operators.knn import knn_impute
from strataframe.plans.storage import materialise
from suite.registry import query, r6, rounded
from suite.sql import external_sql, internal_sql, quoted, r6 as R
from suite.views import BASE_SPEC, NAME_RULES, VISIT_SPEC, ctes, stored_cohort, view

COHORT = internal_sql(BASE_SPEC)
RULES = {n.replace(" ", "_"): p for n, p in NAME_RULES.items()}
SEVEN = features.CONTINUOUS
PROFILE = models.Profile()  # the study's sizes

# --- F: features ----------------------------------------------------------------------------------

_MEASURED = (
    ctes("fx_triage", "fx_patients")
    + f", m as (select stay_id, {', '.join(SEVEN)} from fx_triage t left join fx_patients p on p.subject_id = t.subject_id)"
)


def _measured(spark, sf):
    triage = view(spark, sf, "fx_triage")
    people = view(spark, sf, "fx_patients").select("subject_id", "anchor_age")
    keys = view(spark, sf, "orders").select(F.col("o_custkey").alias("subject_id"))  # where triage has its subjects from
    return left(triage, people, ["subject_id"], "stay_id", hot_from=keys).select("stay_id", *SEVEN)


def _knn_ctes(k: int = 5) -> str:
    """Every receiver tuple against every donor tuple of ``m``: CTEs that end with ``filled``."""
    terms = [f"case when a.{c} is not null and b.{c} is not null then (a.{c} - b.{c}) * (a.{c} - b.{c}) else 0 end" for c in SEVEN]
    shared = " + ".join(f"case when a.{c} is not null and b.{c} is not null then 1 else 0 end" for c in SEVEN)
    total = terms[0]
    for t in terms[1:]:
        total = f"({total} + {t})"
    cells = " union all ".join(
        f"select a.tid, '{c}' as variable, min({{'d': sqrt({total} / nullif({shared}, 0) * {len(SEVEN)}), 'v': b.{c}, 'n': b.n, 't': b.tid}}, {k}) as best"
        f" from tuples a join tuples b on b.{c} is not null where a.{c} is null and ({shared}) > 0 group by a.tid"
        for c in SEVEN
    )
    same = " and ".join(f"m.{c} is not distinct from t.{c}" for c in SEVEN)
    values = ", ".join(
        f"{R(f'''coalesce(m.{c}, max(value) filter (variable = '{c}'), (select avg({c}) from m))''')} as {c}" for c in SEVEN
    )
    return (
        f", tuples as (select *, row_number() over (order by {', '.join(SEVEN)}) as tid from (select {', '.join(SEVEN)}, count(*) as n from m group by all)),"
        + f" found as ({cells}), flat as (select tid, variable, unnest(best) as b from found),"
        + " placed as (select tid, variable, b.d as d, b.v as v, b.n as n, coalesce(sum(b.n) over (partition by tid, variable order by b.d, b.v, b.t"
        + " rows between unbounded preceding and 1 preceding), 0) as before, min(b.d) over (partition by tid, variable) as near from flat),"
        + f" weighed as (select tid, variable, v, least(n, {k} - before) * case when near = 0 then (case when d = 0 then 1 else 0 end)::double else 1 / d end as w"
        + f" from placed where before < {k}),"
        + " imputed as (select tid, variable, sum(w * v) / sum(w) as value from weighed group by all)"
        + f", filled as (select m.stay_id, {values} from m join tuples t on {same} left join imputed i on i.tid = t.tid group by m.stay_id, {', '.join(f'm.{c}' for c in SEVEN)})"
    )


@query("f01_knn_impute", _MEASURED + _knn_ctes() + " select * from filled")
def f01(spark, sf):
    return rounded(knn_impute(_measured(spark, sf), SEVEN, "stay_id"))


@query(
    "f02_median_impute",
    _MEASURED
    + " select stay_id, "
    + ", ".join(f"{R(f'coalesce({c}, (select quantile_cont({c}, 0.5) from m))')} as {c}" for c in SEVEN)
    + " from m",
)
def f02(spark, sf):
    return rounded(features.median_impute(_measured(spark, sf), SEVEN))


@query(
    "f03_mode_impute",
    ctes("fx_stays", "fx_admissions")
    + ", m as (select s.stay_id, s.gender, nullif(a.race, '') as race from fx_stays s left join fx_admissions a on a.hadm_id = s.hadm_id),"
    + " g as (select gender from m where gender is not null group by 1 order by count(*) desc, 1 limit 1),"
    + " r as (select race from m where race is not null group by 1 order by count(*) desc, 1 limit 1)"
    + " select stay_id, coalesce(gender, (select gender from g)) as gender, coalesce(race, (select race from r)) as race from m",
)
def f03(spark, sf):
    stays = view(spark, sf, "fx_stays").select("stay_id", "hadm_id", "gender")
    keys = view(spark, sf, "orders").select(F.col("o_orderkey").alias("hadm_id"))
    joined = left(stays, view(spark, sf, "fx_admissions"), ["hadm_id"], "stay_id", hot_from=keys)
    rows = joined.withColumn("race", F.when(F.col("race") != "", F.col("race"))).drop("hadm_id")
    return features.mode_impute(rows, ["gender", "race"])


@query(
    "f04_embed_text",
    "with tokens as (select doc_id, unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+')) as token from documents),"
    " places as (select doc_id, cast(('0x' || substr(md5(token), 1, 8))::bigint % 768 as integer) as place from tokens where token <> '')"
    " select doc_id, place, count(*)::double as value from places group by all",
)
def f04(spark, sf):
    """Whole documents through the batch encoder; the non-zero places of every vector."""
    texts = view(spark, sf, "documents").select("doc_id", "text")
    vectors = embed.embed_text(texts, "text", embed.hashing_encoder(), tasks=spark.sparkContext.defaultParallelism)
    places = vectors.select("doc_id", F.posexplode("embedding").alias("place", "value")).filter("value <> 0")
    return places.withColumn("value", F.col("value").cast("double"))


@query("f05_pca_fit_transform")
def f05(spark, sf):
    return rounded(embed.pca_fit_transform(view(spark, sf, "embeddings"), "embedding", WIDTH).drop("embedding"))


@query("f06_explained_variance")
def f06(spark, sf):
    vectors = view(spark, sf, "embeddings")
    return rounded(embed.explained_variance(vectors, embed.pca_fit(vectors, "embedding", WIDTH)))


WIDTH = 64  # of the embeddings table
_PLACES = f"places as (select vec_id, unnest(range({WIDTH})) as j, unnest(embedding)::double as x from embeddings)"


@query(
    "f05_pca_norms",
    f"with {_PLACES}, means as (select j, avg(x) as m from places group by j)"
    + f" select vec_id, {R('sum((x - m) * (x - m))')} as norm from places join means using (j) group by vec_id",
)
def f05_norms(spark, sf):
    """With every component kept, scores are a rotation: squared lengths equal those of the centred rows."""
    scores = embed.pca_fit_transform(view(spark, sf, "embeddings"), "embedding", WIDTH)
    squares = sum((F.col(f"cc_pca_{i}") * F.col(f"cc_pca_{i}") for i in range(WIDTH)), F.lit(0.0))
    return scores.select("vec_id", r6(squares).alias("norm"))


@query(
    "f05_pca_moments",
    f"select i::integer as component, 0.0::double as mean, 0.0::double as covariance, true as falling from range({WIDTH}) t(i)",
)
def f05_moments(spark, sf):
    """Scores are centred and uncorrelated, and each component varies no more than the one before it."""
    scores = embed.pca_fit_transform(view(spark, sf, "embeddings"), "embedding", WIDTH)
    listed = F.array(*[f"cc_pca_{i}" for i in range(WIDTH)])
    one = scores.select("vec_id", listed.alias("s")).select("s", F.posexplode("s").alias("component", "x"))
    two = one.select("component", "x", F.posexplode("s").alias("other", "y"))
    pairs = two.groupBy("component", "other").agg(F.covar_samp("x", "y").alias("c"), F.avg("x").alias("m"))
    same, before = F.col("other") == F.col("component"), F.col("other") == F.col("component") - 1
    per = pairs.groupBy("component").agg(
        F.abs(F.round(F.max("m"), 6)).alias("mean"),
        F.round(F.max(F.when(~same, F.abs("c"))), 6).alias("covariance"),
        F.max(F.when(same, F.col("c"))).alias("v"),
    )
    earlier = per.select((F.col("component") + 1).alias("component"), F.col("v").alias("before"))
    falling = F.coalesce(F.col("v") <= F.col("before") + 1e-9, F.lit(True))
    return per.join(earlier, "component", "left").select("component", "mean", "covariance", falling.alias("falling"))


@query(
    "f05_eigen_check",
    f"select i::integer as component, 0.0::double as residual, true as positive from range({WIDTH}) t(i)",
)
def f05_eigen(spark, sf):
    """Every loading is an eigenvector of the covariance to its explained variance, its largest cell being positive."""
    vectors = view(spark, sf, "embeddings")
    found = embed.eigen_check(vectors, "embedding", embed.pca_fit(vectors, "embedding", WIDTH))
    return found.select("component", r6("residual").alias("residual"), (F.col("peak") > 0).alias("positive"))


@query(
    "f06_total_variance",
    f"with {_PLACES}, spread as (select j, var_samp(x) as v from places group by j) select {R('sum(v)')} as total, 1.0::double as ratios from spread",
)
def f06_total(spark, sf):
    """All score variances add up to the table's total variance, and all ratios to 1."""
    vectors = view(spark, sf, "embeddings")
    model = embed.pca_fit(vectors, "embedding", WIDTH)
    total = sum((F.var_samp(f"cc_pca_{i}") for i in range(WIDTH)), F.lit(0.0))
    variances = model.transform(vectors, "embedding").agg(total.alias("total"))
    ratios = embed.explained_variance(vectors, model).agg(F.sum("ratio").alias("ratios")).scalar()
    return rounded(variances.withColumn("ratios", ratios))


# --- F2, F3, F5 without the held-out fold ---

_FOLDED = _MEASURED + ", f as (select *, cast(stay_id % 5 as integer) as fold from m), w as (select unnest(range(5))::integer as without)"


@query(
    "f02_fold_medians",
    _FOLDED + " union all ".join(f" select without, '{c}' as variable, {R(f'quantile_cont({c}, 0.5)')} as median from w join f on fold <> without group by without" for c in SEVEN),
)
def f02_folds(spark, sf):
    """Medians of every training set of five folds, from one count of the values."""
    rows = _measured(spark, sf).withColumn("fold", F.col("stay_id") % 5)
    return rounded(features.fold_medians(rows, SEVEN, "fold", 5))


@query(
    "f03_fold_modes",
    ctes("fx_stays")
    + ", f as (select gender, cast(stay_id % 5 as integer) as fold from fx_stays), w as (select unnest(range(5))::integer as without),"
    + " c as (select without, gender as mode, count(*) as n from w join f on fold <> without where gender is not null group by all)"
    + " select without, 'gender' as variable, mode from c qualify row_number() over (partition by without order by n desc, mode) = 1",
)
def f03_folds(spark, sf):
    """The most frequent gender of every training set of five folds."""
    rows = view(spark, sf, "fx_stays").select("gender", (F.col("stay_id") % 5).alias("fold"))
    return features.fold_modes(rows, ["gender"], "fold", 5)


@query(
    "f02_fold_impute",
    _FOLDED
    + f", s as (select without, {', '.join(f'quantile_cont({c}, 0.5) as {c}' for c in SEVEN)} from w join f on fold <> without group by without)"
    + f" select stay_id, fold, s.without, {', '.join(f'{R(f'coalesce(f.{c}, s.{c})')} as {c}' for c in SEVEN)} from f, s",
)
def f02_fold_impute(spark, sf):
    """Every row once for each training set, its gaps filled with that set's medians."""
    rows = materialise(_measured(spark, sf).withColumn("fold", (F.col("stay_id") % 5).cast("int")), "measured")
    medians = features.fold_medians(rows, SEVEN, "fold", 5)
    return rounded(features.fill_by_fold(features.by_fold(rows, 5), medians, "median", SEVEN))


@query(
    "f05_fold_pca",
    f"with {_PLACES}, w as (select unnest(range(5))::integer as without),"
    + " means as (select without, j, avg(x) as m from w join places on vec_id % 5 <> without group by all)"
    + f" select vec_id, without, {R('sum((x - m) * (x - m))')} as norm from places join means using (j) group by all",
)
def f05_folds(spark, sf):
    """Scores of all rows by the components of every training set: a rotation about that set's mean."""
    rows = view(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("vec_id") % 5).cast("int").alias("fold"))
    model = embed.fold_pca(rows, "embedding", "fold", 5, WIDTH)
    scores = model.transform(features.by_fold(rows, 5), "embedding", features.WITHOUT)
    squares = sum((F.col(f"cc_pca_{i}") * F.col(f"cc_pca_{i}") for i in range(WIDTH)), F.lit(0.0))
    return scores.select("vec_id", features.WITHOUT, r6(squares).alias("norm"))


@query(
    "f05_fold_moments",
    f"select w::integer as without, i::integer as component, 0.0::double as mean, 0.0::double as beyond, true as falling from range(5) t(w), range({WIDTH}) u(i)",
)
def f05_fold_moments(spark, sf):
    """On the training rows alone scores are centred, their variances are the components' shares and they fall."""
    rows = view(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("vec_id") % 5).cast("int").alias("fold"))
    model = embed.fold_pca(rows, "embedding", "fold", 5, WIDTH)
    scores = model.transform(features.by_fold(rows, 5).filter(F.col("fold") != F.col(features.WITHOUT)), "embedding", features.WITHOUT)
    long = scores.select(features.WITHOUT, F.posexplode(F.array(*[f"cc_pca_{i}" for i in range(WIDTH)])).alias("component", "x"))
    per = long.groupBy(features.WITHOUT, "component").agg(F.avg("x").alias("m"), F.var_samp("x").alias("v"))
    total = per.groupBy(features.WITHOUT).agg(F.sum("v").alias("all"))
    shares = [(w, i, float(r)) for w in range(5) for i, r in enumerate(model.ratios[w])]
    known = spark.createDataFrame(shares, "without int, component int, share double")
    before = per.select(features.WITHOUT, (F.col("component") + 1).alias("component"), F.col("v").alias("before"))
    met = per.join(total, features.WITHOUT).join(known, [features.WITHOUT, "component"]).join(before, [features.WITHOUT, "component"], "left")
    return met.select(
        features.WITHOUT, "component", F.abs(F.round("m", 6)).alias("mean"), F.abs(F.round(F.col("v") / F.col("all") - F.col("share"), 6)).alias("beyond"),
        F.coalesce(F.col("v") <= F.col("before") + 1e-9, F.lit(True)).alias("falling"),
    )


_ALL_RULES = {**COMPLAINT_CATEGORIES, **RULES}


@query(
    "f07_multi_hot",
    ctes("fx_triage")
    + " select stay_id, "
    + ", ".join(f"regexp_matches(lower(coalesce(chiefcomplaint, '')), '{p}')::integer::double as {n}" for n, p in _ALL_RULES.items())
    + " from fx_triage",
)
def f07(spark, sf):
    rows = view(spark, sf, "fx_triage").select("stay_id", "chiefcomplaint")
    return features.complaint_features(rows, rules=_ALL_RULES).drop("chiefcomplaint")


# levels of the internal cohort at every scale
_RACES = ["Asian", "Black / African American", "Hispanic / Latino", "Missing", "Unknown", "White"]


@query(
    "f08_one_hot_drop_first",
    COHORT
    + " select stay_id, coalesce(gender = 'M', false)::integer::double as \"gender_M\", "
    + ", ".join(f"coalesce(race = '{r}', false)::integer::double as \"race_{r}\"" for r in _RACES[1:])
    + " from cohort",
)
def f08(spark, sf):
    rows = stored_cohort(spark, sf).select("stay_id", "gender", "race")
    for c in ("gender", "race"):
        rows = features.one_hot_drop_first(rows, c, features.sorted_levels(rows, c))
    return rows.drop("gender", "race")


_LEVELS = ", ".join(
    f"{t} as (select level, row_number() over (order by level) - 2 as pos from (select distinct {c} as level from orders where {c} is not null))"
    for t, c in (("p", "o_orderpriority"), ("c", "o_custkey::varchar"))
)


@query(
    "f08_wide_levels",
    f"with {_LEVELS} select o_orderkey, 0::integer as pos, 'o_totalprice' as name, {R('o_totalprice')} as value from orders where o_totalprice <> 0"
    " union all select o_orderkey, (1 + pos)::integer, concat('o_orderpriority_', level), 1.0::double from orders join p on level = o_orderpriority where pos >= 0"
    " union all select o_orderkey, ((select count(*) from p) + pos)::integer, concat('customer_', level), 1.0::double from orders join c on level = o_custkey::varchar where pos >= 0",
)
def f08_wide(spark, sf):
    """Every order's sparse vector with a place for each customer, whose number grows with the tables: its non-zero places."""
    rows = view(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", F.col("o_custkey").cast("string").alias("customer"))
    wide = {c: features.level_table(rows, c) for c in ("o_orderpriority", "customer")}
    vectors = features.sparse_features(rows, ["o_totalprice"], wide, "o_orderkey", ["o_orderkey"])
    cells = materialise(vectors.select("o_orderkey", F.inline(features.sparse_cells("features"))), "cells")
    # a dense place is in every row's vector, so it is a frequent key
    return rounded(left(cells, features.feature_names(spark, ["o_totalprice"], wide), ["pos"], "o_orderkey"))


SCORES = 100  # components of the complaints' embeddings
_tables: dict[tuple, matrix.FeatureTable] = {}


def _features(spark, sf, which="internal") -> matrix.FeatureTable:
    """The feature table of a stored cohort, built once per session and folder."""
    key = (spark.sparkContext.applicationId, sf, which)
    if key not in _tables:
        like = _features(spark, sf) if which == "external" else None
        rows = stored_cohort(spark, sf, which).withColumnRenamed("ie_label", "label")
        _tables[key] = matrix.feature_table(rows, RULES, embed.hashing_encoder(), SCORES, like)
    return _tables[key]


def _mode_sql(c: str) -> str:
    return f"coalesce({c}, (select {c} from cohort where {c} is not null group by 1 order by count(*) desc, 1 limit 1))"


# the cohort with its imputed cells: donors, median and mode
_WHOLE = (
    f", m as (select stay_id, {', '.join(SEVEN)} from cohort){_knn_ctes()},"
    + f" whole as (select c.stay_id, chiefcomplaint, {', '.join(f'f.{c}' for c in SEVEN)},"
    + f" coalesce(acuity, (select quantile_cont(acuity, 0.5) from cohort)) as acuity, {_mode_sql('gender')} as gender, {_mode_sql('race')} as race"
    + " from cohort c join filled f on f.stay_id = c.stay_id)"
)


def _common_cells(races) -> list[tuple[str, str]]:
    cells = [(c, c) for c in SEVEN]
    cells.append(("esi_ordinal", "least(greatest(trunc(5 - acuity), 0), 4)::double"))
    cells.append(("gender_M", "coalesce(gender = 'M', false)::integer::double"))
    cells += [(f"race_{r}", f"coalesce(race = '{r}', false)::integer::double") for r in races[1:]]
    return cells


def _rule_cells() -> list[tuple[str, str]]:
    return [(n, f"regexp_matches(lower(coalesce(chiefcomplaint, '')), '{p}')::integer::double") for n, p in RULES.items()]


def _score_cells() -> list[tuple[str, str]]:
    return [(f"cc_pca_{i}", "null::double") for i in range(SCORES)]


def _cells_sql(cells) -> str:
    names = quoted([n for n, _ in cells])
    return f"unnest([{names}]) as name, unnest(range({len(cells)}))::integer as pos, unnest([{', '.join(R(e) for _, e in cells)}]) as value"


_OPTION_CELLS = {
    "Option1_Categorical": _common_cells(_RACES) + _rule_cells(),
    "Option2_PCA_Embeddings": _common_cells(_RACES) + _score_cells(),
    "Option3_Hybrid": _common_cells(_RACES) + _rule_cells() + _score_cells(),
    "Option4_No_CC": _common_cells(_RACES),
}


@query(
    "f09_assemble",
    COHORT + _WHOLE + " union all ".join(f" select '{o}' as option, stay_id, {_cells_sql(c)} from whole" for o, c in _OPTION_CELLS.items()),
)
def f09(spark, sf):
    """All four feature sets, one row per cell, in matrix order; scores, which f05 checks, are shown as NULL."""
    from pyspark.ml.functions import vector_to_array

    table, parts = _features(spark, sf), []
    for option, columns in table.options.items():
        cells = features.assemble(table.rows, columns).select(
            F.lit(option).alias("option"), "stay_id", F.posexplode(vector_to_array("features")).alias("pos", "value")
        )
        named = F.array(*[F.lit(c) for c in columns])
        value = F.when(~named[F.col("pos")].startswith("cc_pca_"), r6("value"))
        parts.append(cells.select("option", "stay_id", named[F.col("pos")].alias("name"), "pos", value.alias("value")))
    return reduce(lambda a, b: a.unionByName(b), parts)


_EXTERNAL = external_sql(VISIT_SPEC)


@query(
    "f10_align_features",
    _EXTERNAL
    + " select stay_id, coalesce(gender = 'M', false)::integer::double as \"gender_M\", "
    + ", ".join(f"coalesce(race = '{r}', false)::integer::double as \"race_{r}\"" for r in _RACES[1:])
    + ", 0.0::double as race_Elsewhere from cohort",
)
def f10(spark, sf):
    """External dummies in the internal order: a level only the internal side has is 0, extra ones go."""
    rows = stored_cohort(spark, sf, "external").select("stay_id", "gender", "race")
    canonical = []
    for c in ("gender", "race"):
        inside = features.sorted_levels(stored_cohort(spark, sf), c)
        outside = features.sorted_levels(rows, c)
        # encoded against the internal levels, so the internal base level stays the base
        rows = features.one_hot_drop_first(rows, c, inside[:1] + sorted(set(inside[1:]) | set(outside) - {inside[0]}))
        canonical += features.one_hot_names(c, inside)
    return features.align_features(rows, [*canonical, "race_Elsewhere"], keep=["stay_id"])


@query(
    "f11_check_schema",
    _EXTERNAL + " select 'same' as verdict, count(*) as rows from cohort union all select 'drift', count(*) from cohort",
)
def f11(spark, sf):
    """The guard passes the external table, encoded like the internal one, and stops where a column was lost."""
    inside, outside = _features(spark, sf), _features(spark, sf, "external")
    names = inside.options["Option3_Hybrid"]
    found = [c for c in outside.rows.columns if c in set(names)]
    features.check_schema(names, sorted(found, key=names.index))
    verdict = "missed"
    lost = outside.rows.drop(names[-1])
    try:
        features.check_schema(names, [c for c in names if c in lost.columns])
    except ValueError:
        verdict = "drift"
    counted = outside.rows.agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(F.explode(F.array(F.lit("same"), F.lit(verdict))).alias("verdict"), "rows")


@query(
    "f12_standardize",
    ctes("fx_triage")
    + ", m as (select stay_id, stay_id % 5 as fold, heartrate, sbp, 7.0::double as constant from fx_triage),"
    + " s as (select avg(heartrate) as mh, stddev_pop(heartrate) as sh, avg(sbp) as ms, stddev_pop(sbp) as ss from m where fold <> 0)"
    + f" select stay_id, {R('(heartrate - mh) / sh')} as heartrate, {R('(sbp - ms) / ss')} as sbp, 0.0::double as constant from m, s",
)
def f12(spark, sf):
    """Fitted on four fifths of the stays, applied to all of them."""
    rows = view(spark, sf, "fx_triage").select("stay_id", "heartrate", "sbp", F.lit(7.0).alias("constant"))
    in_test = F.col("stay_id") % 5 == 0
    train, test = features.standardize(rows.filter(~in_test), rows.filter(in_test), ["heartrate", "sbp", "constant"])
    return rounded(train.unionByName(test))


# --- G: splits and models -------------------------------------------------------------------------


@query(
    "g01_balanced_weights",
    ctes("fx_scores")
    + f" select stay_id, label, {R('(select count(*) from fx_scores) / (2.0::double * count(*) over (partition by label))')} as weight from fx_scores",
)
def g01(spark, sf):
    return rounded(splits.balanced_weights(view(spark, sf, "fx_scores").select("stay_id", "label"), "label"))


@query(
    "g02_pos_weight",
    ctes("fx_scores")
    + ", s as (select count(*) filter (label = 0)::double / count(*) filter (label = 1) as w from fx_scores)"
    + f" select stay_id, label, case when label = 1 then {R('w')} else 1.0::double end as weight from fx_scores, s",
)
def g02(spark, sf):
    return rounded(splits.pos_weight(view(spark, sf, "fx_scores").select("stay_id", "label"), "label"))


_FOLDS = "cast((row_number() over (partition by label order by md5(concat('42:', cast(stay_id as varchar))), stay_id) - 1) % 5 as integer)"


@query("g03_stratified_folds", ctes("fx_scores") + f" select stay_id, label, {_FOLDS} as fold from fx_scores")
def g03(spark, sf):
    return splits.stratified_folds(view(spark, sf, "fx_scores").select("stay_id", "label"), "label", 5, 42, "stay_id")


def _vectors(spark, sf):
    """The embeddings as a two-class problem: class 0 against the rest, 64 columns and 5 folds."""
    rows = view(spark, sf, "embeddings").select(
        F.col("vec_id").alias("stay_id"),
        (F.col("label") == 0).cast("int").alias("label"),
        *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)],
    )
    return materialise(splits.stratified_folds(rows, "label", 5, 42, "stay_id"), "vectors")


COLUMNS = [f"x{i}" for i in range(64)]


_fitted: dict[tuple, tuple] = {}


def _fit_and_score(spark, sf, name):
    """Fitted on four folds, scored on the fifth: stored scores, the model and what it was fitted on, once per session and folder."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _fitted:
        rows = _vectors(spark, sf)
        train, test = rows.filter("fold <> 0"), features.assemble(rows.filter("fold = 0"), COLUMNS)
        if name == "LogisticRegression_L1":
            train, test = features.standardize_vectors(features.assemble(train, COLUMNS), test)
            model = models.fit_lr_l1(train, PROFILE)
        else:
            model = models.fit_trees(name, train.drop("fold"), COLUMNS, PROFILE)
        _fitted[key] = materialise(models.score(model, test), "scored"), model, train
    return _fitted[key]


@query("g04_fit_lr_l1")
def g04(spark, sf):
    return rounded(_fit_and_score(spark, sf, "LogisticRegression_L1")[0])


@query("g05_fit_rf")
def g05(spark, sf):
    return rounded(_fit_and_score(spark, sf, "RandomForest")[0])


@query("g06_fit_gbt")
def g06(spark, sf):
    return rounded(_fit_and_score(spark, sf, "GradientBoostedTrees")[0])


_EMBEDDED_FOLDS = _FOLDS.replace("stay_id", "vec_id").replace("partition by label", "partition by label = 0")


@query(
    "g04_fit_checks",
    f"with f as (select vec_id, label, {_EMBEDDED_FOLDS} as fold from embeddings)"
    + " select model, count(*) as n, count(*) filter (label = 0) as cases, sum(vec_id)::bigint as ids, true as valid"
    + f" from f, (select unnest([{quoted(models.MODELS)}]) as model) where fold = 0 group by model",
)
def g04_checks(spark, sf):
    """Each of the three fits scores the whole held-out fold, with probabilities."""
    scored = [_fit_and_score(spark, sf, m)[0].withColumn("model", F.lit(m)) for m in models.MODELS]
    rows = reduce(lambda a, b: a.unionByName(b), scored)
    return rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("cases"), F.sum("stay_id").alias("ids"),
        F.bool_and(F.col("prob").between(0.0, 1.0)).alias("valid"),
    )


@query(
    "g04_optimality",
    f"select unnest([{quoted([*COLUMNS, '(intercept)'])}]) as feature, 0.0::double as violation",
)
def g04_optimality(spark, sf):
    """No coefficient of the L1 fit can be bettered: 0 is a subgradient of the objective, to four places."""
    _, model, train = _fit_and_score(spark, sf, "LogisticRegression_L1")
    found = models.l1_violation(train, model, COLUMNS, PROFILE)
    return found.select("feature", F.round("violation", 4).alias("violation"))


# cuts of the embeddings in steps of 1/64: few values a column, exact in binary
_STEPS = (
    "with v as (select label = 0 as y, unnest(range(64)) as j, floor(unnest(embedding)::double * 64) / 64 as x from embeddings),"
    " n as (select count(*)::double as n, (count(*) filter (label = 0))::double as pos from embeddings),"
)


def _split_sql(a: str, b: str, shrink: str, least: str, scale: str) -> str:
    """The best cut of each column, from sums per value and running sums."""
    part = lambda a, b: f"(({a}) * ({a}) / (({b}) + {shrink}))"
    return (
        f"{_STEPS} s as (select j, x, sum({a}) as a, sum({b}) as b from v, n group by j, x),"
        " r as (select j, x, lead(x) over (partition by j order by x) as next, sum(a) over (partition by j order by x) as la,"
        " sum(b) over (partition by j order by x) as lb, sum(a) over (partition by j) as ta, sum(b) over (partition by j) as tb from s),"
        f" g as (select concat('x', j) as feature, j, (x + next) / 2 as threshold, {scale} * ({part('la', 'lb')} + {part('ta - la', 'tb - lb')} - {part('ta', 'tb')}) as gain"
        f" from r where next is not null and lb >= {least} and tb - lb >= {least}),"
        " best as (select feature, j, threshold, gain from g qualify row_number() over (partition by j order by gain desc, threshold) = 1)"
    )


_GINI = _split_sql("case when y then n / (2 * pos) else 0 end", "n / (2 * case when y then pos else n - pos end)", "0", "0", "2")
_SECOND = _split_sql(
    "case when y then (n - pos) / pos else 1 end * (0.5 - y::integer)", "case when y then (n - pos) / pos else 1 end * 0.25", "1", "1", "1"
)
_ROOT = f" select feature, {R('threshold')} as threshold, {R('gain')} as gain, 1.0::double as imp from best order by gain desc, j limit 1"


def _steps(spark, sf):
    return _vectors(spark, sf).select("stay_id", "label", *[(F.floor(F.col(c) * 64) / 64).alias(c) for c in COLUMNS])


@query("g09_split_gains", _GINI + f" select feature, {R('threshold')} as threshold, {R('gain')} as gain from best")
def g09_gains(spark, sf):
    """The best cut of every column by the decrease of the weighted Gini impurity, from one aggregate."""
    rows = splits.balanced_weights(_steps(spark, sf), "label")
    found = models.split_gains(rows, COLUMNS, F.col("weight") * F.col("label"), F.col("weight"))
    return rounded(found.withColumn("gain", 2.0 * F.col("gain")))


def _root(spark, model):
    """The first split of a model's first tree, with the split column's importance."""
    at, threshold, gain = model.root()
    row = (COLUMNS[at], threshold, gain, models.importance(model)[at])
    return rounded(spark.createDataFrame([row], "feature string, threshold double, gain double, imp double"))


@query("g05_root_split", _GINI + _ROOT)
def g05_root(spark, sf):
    """A forest of one stump on all rows and columns splits where the Gini impurity falls most."""
    stump = replace(PROFILE, trees=1, tree_depth=1, bootstrap=False, split_columns=len(COLUMNS))
    return _root(spark, models.fit_trees("RandomForest", _steps(spark, sf), COLUMNS, stump))


@query("g06_root_split", _SECOND + _ROOT)
def g06_root(spark, sf):
    """The first boosted stump splits where the second-order gain of the weighted loss is largest."""
    return _root(spark, models.fit_trees("GradientBoostedTrees", _steps(spark, sf), COLUMNS, replace(PROFILE, rounds=1, round_depth=1)))


_validated: dict[tuple, tuple] = {}


def _cross_validated(spark, sf):
    """Out-of-fold predictions and importances of four options and three models, stored once per session and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _validated:
        table = _features(spark, sf)
        rows = materialise(splits.stratified_folds(table.rows, "label", 5, 42, "stay_id"), "folds")
        preds, imps = models.cross_validate(rows, table.options, folds=5, profile=PROFILE)
        _validated[key] = preds, materialise(imps, "importances")
    return _validated[key]


@query("g07_cross_validate")
def g07(spark, sf):
    """Fold metrics of every option x model from the out-of-fold predictions."""
    return rounded(metrics(_cross_validated(spark, sf)[0], ["option", "model", "fold"]))


_COHORT_FOLDS = _FOLDS.replace("label", "ie_label")


@query(
    "g07_fold_coverage",
    COHORT
    + f", f as (select stay_id, ie_label, {_COHORT_FOLDS} as fold from cohort)"
    + " select option, model, fold, count(*) as n, sum(ie_label)::bigint as cases, sum(stay_id)::bigint as ids from f,"
    + f" (select unnest([{quoted(features.OPTIONS)}]) as option),"
    + f" (select unnest([{quoted(models.MODELS)}]) as model) group by all",
)
def g07_coverage(spark, sf):
    """Every row is predicted once per option and model, in its own fold."""
    return _cross_validated(spark, sf)[0].groupBy("option", "model", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("cases"), F.sum("stay_id").alias("ids")
    )


_externals: dict[tuple, tuple] = {}


def _external(spark, sf, name="RandomForest"):
    """A model fitted on the internal cohort and its scores of the external one, stored once."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _externals:
        inside, outside = _features(spark, sf), _features(spark, sf, "external")
        option = "Option1_Categorical"
        preds, model = models.external_validate(
            inside.rows, outside.rows, inside.options[option], outside.options[option], name, PROFILE
        )
        _externals[key] = materialise(preds, "external"), model, inside.options[option]
    return _externals[key]


@query("g08_external_validate")
def g08(spark, sf):
    return rounded(_external(spark, sf)[0])


@query(
    "g08_external_coverage",
    _EXTERNAL + " select count(*) as n, sum(ie_label)::bigint as cases, sum(stay_id)::bigint as ids, true as valid from cohort",
)
def g08_coverage(spark, sf):
    """Every external stay is scored once, with a probability."""
    return _external(spark, sf)[0].agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("cases"), F.sum("stay_id").alias("ids"),
        F.coalesce(F.bool_and(F.col("prob").between(0.0, 1.0)), F.lit(False)).alias("valid"),
    )


@query("g09_importance")
def g09(spark, sf):
    """Importances of the model that scores the external cohort, for every kind of model."""
    rows = [(m, *pair) for m in models.MODELS for _, model, names in [_external(spark, sf, m)] for pair in zip(names, models.importance(model))]
    return rounded(spark.createDataFrame(rows, "model string, feature string, imp double"))


@query(
    "g09_importance_totals",
    f"select m as model, {len(_OPTION_CELLS['Option1_Categorical'])}::bigint as features,"
    " case when m = 'LogisticRegression_L1' then null else 1.0::double end as total, true as valid"
    f" from (select unnest([{quoted(models.MODELS)}]) as m)",
)
def g09_totals(spark, sf):
    """A value for every feature, none negative; those of trees add up to 1."""
    rows = [(m, v) for m in models.MODELS for v in models.importance(_external(spark, sf, m)[1])]
    trees = F.col("model") != "LogisticRegression_L1"
    return spark.createDataFrame(rows, "model string, imp double").groupBy("model").agg(
        F.count(F.lit(1)).alias("features"), F.when(F.max(trees), r6(F.sum("imp"))).alias("total"), F.bool_and(F.col("imp") >= 0).alias("valid")
    )


@query("g10_cv_importance")
def g10(spark, sf):
    """Mean and SD over folds of the importances that cross-validation stored."""
    return rounded(models.cv_importance(_cross_validated(spark, sf)[1]))


@query(
    "g10_importance_totals",
    "select o as option, m as model, n as features, case when m = 'LogisticRegression_L1' then null else 1.0::double end as total, true as valid"
    f" from (select unnest([{quoted(features.OPTIONS)}]) as o, unnest([{', '.join(str(len(c)) for c in _OPTION_CELLS.values())}])::bigint as n),"
    f" (select unnest([{quoted(models.MODELS)}]) as m)",
)
def g10_totals(spark, sf):
    """A mean for every feature, none negative; a forest's or a boosted model's importances add up to 1."""
    means = models.cv_importance(_cross_validated(spark, sf)[1])
    trees = F.col("model") != "LogisticRegression_L1"
    return means.groupBy("option", "model").agg(
        F.count(F.lit(1)).alias("features"),
        F.when(F.max(trees), r6(F.sum("mean"))).alias("total"),
        F.bool_and(F.col("mean") >= 0).alias("valid"),
    )


@query("g11_top_features")
def g11(spark, sf):
    return models.top_features(rounded(models.cv_importance(_cross_validated(spark, sf)[1])))


@query(
    "g11_top_counts",
    f"select o as option, m as model, least(n, 20)::bigint as n, true as ordered"
    f" from (select unnest([{quoted(features.OPTIONS)}]) as o, unnest([{', '.join(str(len(c)) for c in _OPTION_CELLS.values())}])::bigint as n),"
    f" (select unnest([{quoted(models.MODELS)}]) as m)",
)
def g11_counts(spark, sf):
    """Places run from 1 and means do not rise with them."""
    top = models.top_features(models.cv_importance(_cross_validated(spark, sf)[1]))
    means = F.array_sort(F.collect_list(F.struct("place", "mean")))
    ordered = F.forall(
        F.sequence(F.lit(1), F.size(means)),
        lambda i: (means[i - 1]["place"] == i) & ((i == 1) | (means[i - 1]["mean"] <= means[F.greatest(i - 2, F.lit(0))]["mean"])),
    )
    return top.groupBy("option", "model").agg(F.count(F.lit(1)).alias("n"), ordered.alias("ordered"))


# importances as a long table: the mean price of a part per brand stands for a feature's importance
_IMPS = (
    "with imps as (select concat('o', p_size % 4) as option, p_type as model, p_brand as feature, cast(p_partkey % 5 as integer) as fold,"
    " avg(p_retailprice) as imp from part group by all),"
    " means as (select option, model, feature, avg(imp) as mean, stddev_pop(imp) as sd from imps group by all)"
)


def _importances(spark, sf):
    return (
        view(spark, sf, "part")
        .groupBy(
            F.concat(F.lit("o"), (F.col("p_size") % 4).cast("string")).alias("option"),
            F.col("p_type").alias("model"),
            F.col("p_brand").alias("feature"),
            (F.col("p_partkey") % 5).cast("int").alias("fold"),
        )
        .agg(F.avg("p_retailprice").alias("imp"))
    )


@query("g10_importance_stats", _IMPS + f" select option, model, feature, {R('mean')} as mean, {R('sd')} as sd from means")
def g10_stats(spark, sf):
    return rounded(models.cv_importance(_importances(spark, sf)))


@query(
    "g11_top_of_stats",
    _IMPS
    + ", rounded as (select option, model, feature, round(mean, 6) as mean, round(sd, 6) as sd from means),"
    + " ranked as (select *, cast(row_number() over (partition by option, model order by mean desc, feature) as integer) as place from rounded)"
    + " select * from ranked where place <= 20",
)
def g11_stats(spark, sf):
    return models.top_features(rounded(models.cv_importance(_importances(spark, sf))))
