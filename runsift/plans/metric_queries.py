"""Evaluation metrics over scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from runsift import constants as K
from runsift.operators import metrics as M
from runsift.plans.model_inputs import SCORED_SQL, scored

RATES = ("accuracy", "precision", "recall", "zero_recall", "f1")


def _rounded(df, names):
    return df.withColumns({n: F.round(n, 9) for n in names})


def metric_confusion(spark, d):
    counts = M.confusion(scored(spark, d), ["split_id"], "true_failure", (F.col("risk") >= 0.5).cast("int"))
    return _rounded(M.quality_columns(counts), RATES)


def metric_sweep(spark, d):
    return _rounded(M.threshold_sweep(scored(spark, d), ["split_id"], "true_failure", "risk"), RATES)


def metric_auc(spark, d):
    return _rounded(M.roc_auc(scored(spark, d), "true_failure", "risk", ["split_id"]), ["roc_auc"])


def metric_auc_overall(spark, d):
    return _rounded(M.roc_auc(scored(spark, d), "true_failure", "risk"), ["roc_auc"])


def metric_splits(spark, d):
    rows = scored(spark, d)
    sweep = M.threshold_sweep(rows, ["split_id"], "true_failure", "risk")
    joined = sweep.join(M.roc_auc(rows, "true_failure", "risk", ["split_id"]), "split_id")
    out = M.across_splits(joined, ["threshold"], ["recall", "precision", "f1", "roc_auc"])
    return out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double" and c != "threshold"})


def metric_diagnosis(spark, d):
    return _rounded(M.risk_diagnosis(scored(spark, d), "true_failure", "risk", "record_id", ["split_id"]), ["median_risk"])


def metric_wide(spark, d):
    wide = M.wide_predictions(scored(spark, d), "risk")
    return wide.select("record_id", *[c for c in wide.columns if c.startswith("predicted_failure_")])


def metric_verdict(spark, d):
    """Even splits stand for the in-domain experiment, odd splits for the held-out one."""
    name = F.when(F.col("split_id") % 2 == 0, "baseline_random_split").otherwise("material_group_split")
    rows = scored(spark, d).withColumn("experiment", name).withColumn("success_probability", 1 - F.col("risk"))
    sweep = M.threshold_sweep(rows, ["experiment"], "success", "success_probability", K.SUCCESS_THRESHOLDS)
    out = M.generalization_verdict(sweep, "baseline_random_split", "material_group_split")
    return _rounded(out, [c for c in out.columns if c != "verdict"])


def metric_class_counts(spark, d):
    rows = scored(spark, d).withColumn("is_test", (F.col("record_id") % 5 == 0).cast("int"))
    return M.class_counts(rows, ["split_id", "is_test"])


QUERIES = {f.__name__: f for f in (
    metric_confusion, metric_sweep, metric_auc, metric_auc_overall, metric_splits, metric_diagnosis, metric_wide,
    metric_verdict, metric_class_counts)}

_COUNTS = """count(*) filter (where {y} = 0 and not {p}) as tn, count(*) filter (where {y} = 0 and {p}) as fp,
  count(*) filter (where {y} = 1 and not {p}) as fn, count(*) filter (where {y} = 1 and {p}) as tp"""
_RATES = """round(coalesce((tp + tn) / nullif(cast(tp + tn + fp + fn as double), 0), 0), 9) as accuracy,
  round(coalesce(tp / nullif(cast(tp + fp as double), 0), 0), 9) as precision,
  round(coalesce(tp / nullif(cast(tp + fn as double), 0), 0), 9) as recall,
  round(coalesce(tn / nullif(cast(tn + fp as double), 0), 0), 9) as zero_recall,
  round(coalesce(2 * tp / nullif(cast(2 * tp + fp + fn as double), 0), 0), 9) as f1"""
_THRESHOLDS = ", ".join(f"({t}e0)" for t in K.RISK_THRESHOLDS)
_SWEEP = f"""
sw as (select split_id, threshold, {_COUNTS.format(y="true_failure", p="risk >= threshold")}
  from {{rows}}, (values {_THRESHOLDS}) as t(threshold) group by split_id, threshold),
swr as (select split_id, threshold, tn, fp, fn, tp, {_RATES} from sw)"""
_AUC = """
auc as (
  select a.split_id, sum(case when a.risk > b.risk then 1e0 when a.risk = b.risk then 0.5e0 else 0e0 end) / count(*) as roc_auc
  from {rows} a join {rows} b on a.split_id = b.split_id and a.true_failure = 1 and b.true_failure = 0 group by a.split_id)"""

ORACLES = {
    "metric_confusion": f"""with {SCORED_SQL}, c as (select split_id, {_COUNTS.format(y="true_failure", p="risk >= 0.5e0")} from sc group by split_id)
select split_id, tn, fp, fn, tp, {_RATES} from c""",
    "metric_sweep": f"with {SCORED_SQL}, {_SWEEP.format(rows='sc')} select * from swr",
    "metric_auc": f"""with {SCORED_SQL}, {_AUC.format(rows='sc')}
select s.split_id, round(roc_auc, 9) as roc_auc from (select distinct split_id from sc) s left join auc on auc.split_id = s.split_id""",
    "metric_auc_overall": f"""with {SCORED_SQL}, one as (select risk, true_failure from sc),
r as (select true_failure, rank() over (order by risk) + (count(*) over (partition by risk) - 1) / 2e0 as mid from one)
select round((sum(case when true_failure = 1 then mid end) - count(*) filter (where true_failure = 1)
    * (count(*) filter (where true_failure = 1) + 1) / 2e0)
  / (count(*) filter (where true_failure = 1) * cast(count(*) filter (where true_failure = 0) as double)), 9) as roc_auc from r""",
    "metric_splits": f"""with {SCORED_SQL}, {_SWEEP.format(rows='sc')}, {_AUC.format(rows='sc')}
select threshold, count(*) as n_splits, round(avg(recall), 6) as recall_mean, round(stddev_pop(recall), 6) as recall_std,
  round(avg(precision), 6) as precision_mean, round(stddev_pop(precision), 6) as precision_std, round(avg(f1), 6) as f1_mean,
  round(stddev_pop(f1), 6) as f1_std, round(avg(roc_auc), 6) as roc_auc_mean, round(stddev_pop(roc_auc), 6) as roc_auc_std
from swr left join auc on auc.split_id = swr.split_id group by threshold""",
    "metric_diagnosis": f"""with {SCORED_SQL}, m as (select split_id, median(risk) as median_risk from sc where true_failure = 1 group by 1)
select split_id, round(median_risk, 9) as median_risk, case when median_risk < 0.05e0 then 'feature_or_data'
  when median_risk < 0.2e0 then 'threshold_and_calibration' else 'threshold_selection' end as diagnosis from m""",
    "metric_wide": f"with {SCORED_SQL} select record_id, " + ", ".join(
        f"case when risk >= {t}e0 then 1 else 0 end as predicted_failure_{round(t * 100):03d}" for t in K.RISK_THRESHOLDS) + " from sc",
    "metric_verdict": f"""with {SCORED_SQL}, x as (select *, split_id % 2 as held, 1 - risk as p from sc),
s as (select held, t, round(coalesce(count(*) filter (where success = 0 and p < t)
  / nullif(cast(count(*) filter (where success = 0) as double), 0), 0), 9) as zr
  from x, (values (0.3e0), (0.4e0), (0.5e0), (0.6e0), (0.7e0)) as v(t) group by held, t),
o as (select max(case when held = 0 then zr end) as in_domain_best, max(case when held = 0 and t = 0.5e0 then zr end) as in_domain_default,
  max(case when held = 1 then zr end) as held_out_best, max(case when held = 1 and t = 0.5e0 then zr end) as held_out_default from s)
select *, case when held_out_best > held_out_default then 'improves' else 'does not improve' end as verdict from o""",
    "metric_class_counts": f"""with {SCORED_SQL} select split_id, case when record_id % 5 = 0 then 1 else 0 end as is_test,
  count(*) as n_rows, count(*) filter (where success = 1) as n_success, count(*) filter (where success = 0) as n_failure
from sc group by 1, 2""",
}
