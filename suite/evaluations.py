"""Queries for discrimination, curves and summaries of scored rows (H)."""

from __future__ import annotations

from strataframe.operators import evaluate
from suite.registry import query, rounded
from suite.sql import r6 as R
from suite.views import ctes, view

BY = ["option", "model"]
_BASE = ctes("fx_scores")


def _scores(spark, sf):
    return view(spark, sf, "fx_scores")


def _confusion_sql(t: float, by: str = "option, model") -> str:
    return (
        f"select {by}, count(*) filter (prob >= {t}::double and label = 1) as tp, count(*) filter (prob >= {t}::double and label = 0) as fp,"
        f" count(*) filter (prob < {t}::double and label = 1) as fn, count(*) filter (prob < {t}::double and label = 0) as tn from fx_scores group by {by}"
    )


@query("h01_confusion", f"{_BASE} {_confusion_sql(0.5)}")
def h01(spark, sf):
    return evaluate.confusion(_scores(spark, sf), 0.5, BY)


def _share(a: str, b: str) -> str:
    return f"coalesce({a}::double / nullif({a} + {b}, 0), 0)"


_RATES = {
    "Sensitivity": _share("tp", "fn"),
    "Specificity": _share("tn", "fp"),
    "PPV": _share("tp", "fp"),
    "NPV": _share("tn", "fn"),
    "Precision": _share("tp", "fp"),
    "Recall": _share("tp", "fn"),
}


@query(
    "h02_rates",
    f"{_BASE}, c as ({_confusion_sql(0.99)}) select option, model, " + ", ".join(f'{R(e)} as "{n}"' for n, e in _RATES.items()) + " from c",
)
def h02(spark, sf):
    return rounded(evaluate.rates(evaluate.confusion(_scores(spark, sf), 0.99, BY), BY))


def _ranked_sql(by: str) -> str:
    """Per distinct score from the highest: pos, neg, running tp and fp, and totals."""
    return (
        f"counts as (select {by}, prob, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg from fx_scores group by {by}, prob),"
        f" ranked as (select *, sum(pos) over (partition by {by} order by prob desc) as tp, sum(neg) over (partition by {by} order by prob desc) as fp,"
        f" sum(pos) over (partition by {by}) as np, sum(neg) over (partition by {by}) as nn from counts)"
    )


_RANKED = f"{_BASE}, {_ranked_sql('option, model')}"
_AUROC = "sum(neg * (tp - pos / 2.0::double)) / (max(np)::double * max(nn))"
_AP = "sum(pos::double / np * tp / (tp + fp))"


@query("h03_auroc", f"{_RANKED} select option, model, {R(_AUROC)} as \"AUROC\" from ranked group by option, model")
def h03(spark, sf):
    return rounded(evaluate.auroc(_scores(spark, sf), BY))


@query("h04_average_precision", f"{_RANKED} select option, model, {R(_AP)} as \"AUPRC\" from ranked group by option, model")
def h04(spark, sf):
    return rounded(evaluate.average_precision(_scores(spark, sf), BY))


@query(
    "h05_roc_curve",
    _RANKED.replace("ranked as", "ranked0 as")
    + ", ranked as (select *, lead(pos) over w as np2, lead(neg) over w as nn2, row_number() over w as r from ranked0 window w as (partition by option, model order by prob desc)),"
    + " kept as (select * from ranked where r = 1 or not coalesce(np2 = pos and nn2 = neg, false))"
    + f" select option, model, {R('fp::double / nn')} as fpr, {R('tp::double / np')} as tpr, {R('prob')} as threshold from kept"
    + " union all select distinct option, model, 0.0::double, 0.0::double, 'inf'::double from fx_scores",
)
def h05(spark, sf):
    return rounded(evaluate.roc_curve(_scores(spark, sf), BY, drop_collinear=True))


@query(
    "h06_pr_curve",
    f"{_RANKED} select option, model, {R('tp::double / np')} as recall, {R('tp::double / (tp + fp)')} as precision, {R('prob')} as threshold,"
    f" {R('np::double / (np + nn)')} as prevalence from ranked union all"
    f" select option, model, 0.0::double, 1.0::double, null, {R('max(np)::double / (max(np) + max(nn))')} from ranked group by option, model",
)
def h06(spark, sf):
    return rounded(evaluate.pr_curve(_scores(spark, sf), BY))


_CUTS = [0.05, 0.1, 0.25, 0.5, 0.75, 1.0]


def _benefit_sql(t: float) -> str:
    if t >= 1:
        return "0.0::double"
    part = "count(*) filter (prob >= {0}::double and label = {1})::double / count(*)"
    return f"{part.format(t, 1)} - {part.format(t, 0)} * ({t}::double / (1.0::double - {t}::double))"


@query(
    "h07_net_benefit",
    _BASE
    + " "
    + " union all ".join(
        f"select option, model, {t}::double as threshold, {R(_benefit_sql(t))} as net_benefit from fx_scores group by option, model" for t in _CUTS
    ),
)
def h07(spark, sf):
    return rounded(evaluate.net_benefit(_scores(spark, sf), _CUTS, BY))


@query(
    "h08_decision_curve",
    _BASE
    + ", ts as (select case when i = 199 then 0.99::double else 0.01::double + i * ((0.99::double - 0.01::double) / 199) end as t from range(200) g(i)),"
    + " c as (select option, model, t, count(*) as n, count(*) filter (label = 1) as np, count(*) filter (label = 0) as nn,"
    + " count(*) filter (prob >= t and label = 1) as tp, count(*) filter (prob >= t and label = 0) as fp from fx_scores, ts group by option, model, t)"
    + f" select option, model, {R('t')} as threshold, {R('tp::double / n - fp::double / n * (t / (1 - t))')} as model_benefit,"
    + f" {R('np::double / n - (1 - np::double / n) * (t / (1 - t))')} as treat_all, 0.0::double as treat_none from c",
)
def h08(spark, sf):
    by = ["option", "group_model"]
    scores = _scores(spark, sf).withColumnRenamed("model", "group_model")
    curve = evaluate.decision_curve(scores, by)
    return rounded(curve.withColumnRenamed("model", "model_benefit").withColumnRenamed("group_model", "model"))


_PER_FOLD = (
    f"{_BASE}, c as ({_confusion_sql(0.5, 'option, model, fold')}), {_ranked_sql('option, model, fold')},"
    f" d as (select option, model, fold, {_AUROC} as auroc, {_AP} as auprc from ranked group by option, model, fold),"
    " m as (select option, model, fold, unnest(['Sensitivity', 'Specificity', 'PPV', 'NPV', 'Precision', 'Recall', 'AUROC', 'AUPRC']) as metric,"
    f" unnest([{', '.join(_RATES.values())}, auroc, auprc]) as value from c join d using (option, model, fold))"
)


@query(
    "h09_cv_summary",
    f"{_PER_FOLD} select option as \"Option\", model as \"Model\", metric as \"Metric\", {R('avg(value)')} as \"Mean\", {R('stddev_samp(value)')} as \"Std\""
    " from m group by option, model, metric",
)
def h09(spark, sf):
    return rounded(evaluate.cv_summary(evaluate.metrics(_scores(spark, sf), ["option", "model", "fold"])))


@query(
    "h10_ext_summary",
    f"{_BASE}, c as ({_confusion_sql(0.5)}), {_ranked_sql('option, model')},"
    f" d as (select option, model, {_AUROC} as auroc, {_AP} as auprc from ranked group by option, model),"
    " m as (select option, model, unnest(['Sensitivity', 'Specificity', 'PPV', 'NPV', 'Precision', 'Recall', 'AUROC', 'AUPRC']) as metric,"
    f" unnest([{', '.join(_RATES.values())}, auroc, auprc]) as value from c join d using (option, model))"
    f" select option as \"Option\", model as \"Model\", metric as \"Metric\", {R('value')} as \"Value\" from m",
)
def h10(spark, sf):
    return rounded(evaluate.ext_summary(_scores(spark, sf)))


@query("h11_pool_folds", f"{_BASE} select stay_id, option, model, cast(label as integer) as label, {R('prob')} as prob from fx_scores")
def h11(spark, sf):
    return rounded(evaluate.pool_folds(_scores(spark, sf)))
