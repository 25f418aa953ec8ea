"""Queries: imputation, metrics, comparisons, residual tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.operators import impute, metrics as m
from tagloom.plans import inputs as src
from tagloom.plans.registry import query, r6, rounded

NUMBERS = ["quantity", "price", "tax"]
IDS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
MEDIANS_SQL = f"""{src.GAPPY_SQL},
medians AS (SELECT median(quantity) FILTER (WHERE part = 'train') AS q, median(price) FILTER (WHERE part = 'train') AS p,
  median(tax) FILTER (WHERE part = 'train') AS t, median(quantity) AS q_all, median(price) AS p_all, median(tax) AS t_all FROM gappy)"""


def _trained(spark, d):
    rows = src.gappy(spark, d)
    return rows, impute.fit_medians(rows, NUMBERS)


@query("train_medians", f"WITH {MEDIANS_SQL} SELECT q AS quantity, p AS price, t AS tax FROM medians")
def train_medians(spark, d):
    return _trained(spark, d)[1]


@query(
    "impute_median",
    f"""WITH {MEDIANS_SQL} SELECT {IDS}, coalesce(quantity, q) AS quantity, coalesce(price, p) AS price,
        coalesce(tax, t) AS tax FROM gappy, medians""",
)
def impute_median(spark, d):
    rows, medians = _trained(spark, d)
    return impute.impute_median(rows, medians).select(*src.LINE_IDS, *NUMBERS)


@query(
    "impute_median_zero",
    f"""WITH {MEDIANS_SQL} SELECT {IDS}, coalesce(quantity, q, 0) AS quantity, coalesce(price, p, 0) AS price,
        coalesce(tax, t, 0) AS tax FROM gappy, medians""",
)
def impute_median_zero(spark, d):
    rows, medians = _trained(spark, d)
    return impute.impute_median(rows, medians, fallback=0.0).select(*src.LINE_IDS, *NUMBERS)


@query(
    "impute_median_global",
    f"""WITH {MEDIANS_SQL} SELECT {IDS}, coalesce(quantity, q_all) AS quantity, coalesce(price, p_all) AS price,
        coalesce(tax, t_all) AS tax FROM gappy, medians""",
)
def impute_median_global(spark, d):
    rows = src.gappy(spark, d)
    filled = impute.impute_median(rows, impute.fit_medians(rows, NUMBERS, where=None))
    return filled.select(*src.LINE_IDS, *NUMBERS)


@query(
    "impute_drop_empty",
    f"""WITH {MEDIANS_SQL} SELECT {IDS}, coalesce(quantity, q) AS quantity, coalesce(price, p) AS price
        FROM gappy, medians""",
)
def impute_drop_empty(spark, d):
    rows, medians = _trained(spark, d)
    filled = impute.impute_median(rows, medians, drop_empty=True)
    return filled.drop("l_shipdate", "part")


@query("regression_metrics", f"WITH {src.PREDICTIONS_SQL} SELECT * FROM {src.metrics_sql('target, model')}")
def regression_metrics(spark, d):
    return src.metrics(spark, d, "target", "model")


SUMMARY_SQL = ", ".join(
    [f"round(avg({c}) + 1e-9, 6) AS {c}_mean, round(stddev_pop({c}) + 1e-9, 6) AS {c}_std" for c in m.METRICS]
)


@query(
    "fold_summary",
    f"WITH {src.PREDICTIONS_SQL} SELECT model, {SUMMARY_SQL} FROM {src.metrics_sql('model, fold')} GROUP BY model",
)
def fold_summary(spark, d):
    rows = m.fold_summary(src.metrics(spark, d, "model", "fold"), ["model"])
    return rounded(rows, *[f"{c}_{s}" for c in m.METRICS for s in ("mean", "std")])


@query(
    "stability_verdict",
    f"""WITH {src.PREDICTIONS_SQL} SELECT model, count(*) AS n_folds, count(*) FILTER (WHERE r2 < 0) AS negative_r2,
        CASE count(*) FILTER (WHERE r2 < 0) WHEN 0 THEN 'stable' WHEN 1 THEN 'conditional' ELSE 'weak' END AS verdict
        FROM {src.metrics_sql('model, fold')} GROUP BY model""",
)
def stability_verdict(spark, d):
    return m.stability_verdict(src.metrics(spark, d, "model", "fold"), ["model"])


DELTA_SQL = """round(v.rmse - b.rmse + 1e-9, 6) AS delta_rmse, round(v.r2 - b.r2 + 1e-9, 6) AS delta_r2,
  v.rmse - b.rmse <= 0 AND v.r2 - b.r2 >= 0 AS not_worse"""


@query(
    "delta_vs_baseline",
    f"""WITH {src.PREDICTIONS_SQL} SELECT v.*, {DELTA_SQL} FROM {src.metrics_sql('target, model')} v, {src.metrics_sql('')} b""",
)
def delta_vs_baseline(spark, d):
    rows = m.delta_vs_baseline(src.metrics(spark, d, "target", "model"), src.metrics(spark, d))
    return rounded(rows, "delta_rmse", "delta_r2")


@query(
    "wide_summary",
    f"""WITH {src.PREDICTIONS_SQL} SELECT target,
        {", ".join(f"max({c}) FILTER (WHERE model = '{k}') AS {s}_{c}" for k, s in (('retail', 'rt'), ('flat', 'fl'), ('ridge', 'ridge')) for c in m.METRICS)}
        FROM {src.metrics_sql('target, model')} GROUP BY target""",
)
def wide_summary(spark, d):
    short = {"retail": "rt", "flat": "fl", "ridge": "ridge"}
    return m.wide_summary(src.metrics(spark, d, "target", "model"), ["target"], short)


@query(
    "comparison_table",
    f"""WITH {src.PREDICTIONS_SQL},
        every AS (SELECT 'all_models' AS variant, * FROM {src.metrics_sql('')} UNION ALL
                  SELECT 'model_' || model, n, mae, rmse, r2 FROM {src.metrics_sql('model')})
        SELECT v.*, {DELTA_SQL} FROM every v, (SELECT * FROM {src.metrics_sql('')}) b""",
)
def comparison_table(spark, d):
    base = src.metrics(spark, d).withColumn("variant", F.lit("all_models"))
    variants = src.metrics(spark, d, "model")
    variants = variants.withColumn("variant", F.concat(F.lit("model_"), F.col("model"))).drop("model")
    rows = m.comparison_table(base, variants, base)
    return rounded(rows, "delta_rmse", "delta_r2")


@query(
    "accept_gate",
    f"WITH {src.PREDICTIONS_SQL} SELECT *, r2 > 0 AS accepted FROM {src.metrics_sql('model, fold')}",
)
def accept_gate(spark, d):
    return m.accept_gate(src.metrics(spark, d, "model", "fold"), 0.0)


@query(
    "metric_long",
    f"""WITH {src.PREDICTIONS_SQL}, rows AS (SELECT * FROM {src.metrics_sql('model, fold')})
        {" UNION ALL ".join(f"SELECT model, fold, '{c}' AS metric, {c} AS metric_value FROM rows" for c in m.METRICS)}""",
)
def metric_long(spark, d):
    return m.metric_long(src.metrics(spark, d, "model", "fold"), ["model", "fold"])


@query("union_folds", f"WITH {src.PREDICTIONS_SQL} SELECT fold, model, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM predictions GROUP BY ALL")
def union_folds(spark, d):
    rows = src.predictions(spark, d).select("fold", "model", "l_orderkey")
    early = rows.where(F.col("fold") < "fold_1997")
    late = rows.where(F.col("fold") >= "fold_1997")
    return m.union_all([early, late]).groupBy("fold", "model").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys")
    )


@query(
    "residuals",
    f"""WITH {src.PREDICTIONS_SQL} SELECT {IDS}, model, round(y_true - y_pred + 1e-9, 6) AS residual,
        round(abs(y_true - y_pred) + 1e-9, 6) AS abs_err FROM predictions""",
)
def residuals(spark, d):
    rows = m.residuals(src.predictions(spark, d))
    return rows.select(*src.LINE_IDS, "model", r6("residual").alias("residual"), r6("abs_err").alias("abs_err"))


@query(
    "residual_histogram",
    f"""WITH {src.PREDICTIONS_SQL}, r AS (SELECT y_true - y_pred AS v FROM predictions),
        b AS (SELECT min(v) AS lo, (max(v) - min(v)) / 10 AS w FROM r),
        counted AS (SELECT least(CAST(floor((v - lo) / w) AS BIGINT), 9) AS bin, count(*) AS n FROM r, b GROUP BY 1)
        SELECT bins.bin, round(lo + bins.bin * w + 1e-9, 6) AS bin_from, round(lo + (bins.bin + 1) * w + 1e-9, 6) AS bin_to,
          coalesce(n, 0) AS n FROM range(10) bins(bin) CROSS JOIN b LEFT JOIN counted USING (bin)""",
)
def residual_histogram(spark, d):
    rows = m.residual_histogram(m.residuals(src.predictions(spark, d)), 10)
    return rounded(rows, "bin_from", "bin_to")


@query(
    "test_series",
    f"""WITH {src.PREDICTIONS_SQL} SELECT {IDS}, target, model, y_true, round(y_pred + 1e-9, 6) AS y_pred,
        row_number() OVER (PARTITION BY target, model ORDER BY l_shipdate, {IDS}) - 1 AS test_index FROM predictions""",
)
def test_series(spark, d):
    rows = m.test_series(src.predictions(spark, d), ["l_shipdate", *src.LINE_IDS])
    rows = rows.select(*src.LINE_IDS, "target", "model", "y_true", "y_pred", "test_index")
    return rounded(rows, "y_pred")
