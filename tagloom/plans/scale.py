"""Queries that force the paths large tables take, hard inputs (ties, text and decimal ids, outliers), guards and sinks.

A path that only runs above a row count would otherwise never be compared with SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tagloom.models.fit import persistence
from tagloom.operators import columns, impute, order, scans, series
from tagloom.operators.clean import require_min_rows
from tagloom.operators.metrics import fold_summary, regression_metrics
from tagloom.operators.metrics import test_series as indexed_series
from tagloom.plans import inputs as src
from tagloom.plans.evaluation import IDS, MEDIANS_SQL, NUMBERS
from tagloom.plans.inputs import EVENT_ORDER, table
from tagloom.plans.registry import ORACLES, query, r6, rounded
from tagloom.plans.windows import _features_sql
from tagloom.sources import sinks
from tagloom.sources.staging import shared_folder
from tagloom.sources.tables import ordered_distinct

SMALL = {"max_group_rows": 50, "block_rows": 400}


@query("lag_features_blocks", ORACLES["lag_features"])
def lag_features_blocks(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts", "event_type", "value")
    return series.add_lags(rows, ["value"], [1, 2], EVENT_ORDER, ["event_type"], **SMALL).drop("ts")


@query("rolling_mean_blocks", ORACLES["rolling_mean"])
def rolling_mean_blocks(spark, d):
    gaps = "CASE WHEN value >= 5 THEN value END AS value"
    rows = table(spark, d, "events").selectExpr("event_id", "ts", "user_id", gaps)
    limits = {"max_group_rows": 1, "block_rows": 400}
    rolled = series.add_rolling_mean(rows, ["value"], [3], EVENT_ORDER, ["user_id"], **limits)
    return rolled.select("event_id", "user_id", r6("value_roll3_mean").alias("value_roll3_mean"))


@query("horizon_label_blocks", ORACLES["horizon_label"])
def horizon_label_blocks(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts", "user_id", "value")
    limits = {"max_group_rows": 1, "block_rows": 400}
    return series.add_horizon_label(rows, "value", 2, EVENT_ORDER, ["user_id"], **limits).drop("ts")


@query("persistence_blocks", ORACLES["persistence_metrics"])
def persistence_blocks(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts", "event_type", "value")
    known = persistence(rows, "value", EVENT_ORDER, ["event_type"], **SMALL)
    return rounded(regression_metrics(known, ["event_type"]), "mae", "rmse", "r2")


@query("test_series_numbered", ORACLES["test_series"])
def test_series_numbered(spark, d):
    rows = indexed_series(src.predictions(spark, d), ["l_shipdate", *src.LINE_IDS], max_group_rows=50)
    return rounded(rows.select(*src.LINE_IDS, "target", "model", "y_true", "y_pred", "test_index"), "y_pred")


test_series_numbered.__test__ = False


@query(
    "impute_median_counted",
    f"""WITH {MEDIANS_SQL} SELECT {IDS}, coalesce(quantity, q_all) AS quantity, coalesce(price, p_all) AS price,
        coalesce(tax, t_all) AS tax FROM gappy, medians""",
)
def impute_median_counted(spark, d):
    rows = src.gappy(spark, d)
    medians = impute.fit_medians(rows, NUMBERS, where=None, max_cells=0, finish_rows=500)
    return impute.impute_median(rows, medians).select(*src.LINE_IDS, *NUMBERS)


@query("window_features_chunks", ORACLES["window_features"])
def window_features_chunks(spark, d):
    rows = scans.window_features(src.anchors(spark, d), src.sensor(spark, d), max_group_rows=0)
    return rounded(rows, "mean", "std", "delta")


def _digits(c: str) -> str:
    """Six decimals, or five leading digits of large numbers."""
    return f"CASE WHEN abs({c}) > 1e5 THEN round({c} / pow(10, floor(log10(abs({c}))) - 5)) ELSE round({c} + 1e-9, 6) END AS {c}"


OUTLIERS = "CASE WHEN event_id % 300 = 7 THEN -1e9 {inf} ELSE value END"


@query(
    "window_features_outliers",
    f"""WITH {src.SENSOR_SQL.replace("event_id AS row_id, value FROM events WHERE event_type <> 'purchase'",
        f"event_id AS row_id, {OUTLIERS.format(inf='')} AS value FROM events WHERE event_type <> 'purchase' AND event_id % 400 NOT IN (3, 5)")},
        {_features_sql("w60", 60, 0).replace("round(avg(value) + 1e-9, 6)", "avg(value)").replace("round(stddev_samp(value) + 1e-9, 6)", "stddev_samp(value)")}
        SELECT anchor_id, "window", tag, n, min, max, last, {_digits("mean")}, {_digits("std")} FROM features""",
)
def window_features_outliers(spark, d):
    """Readings of -1e9 and of both infinities among the others; infinities count as missing."""
    infinite = "WHEN event_id % 400 = 3 THEN double('inf') WHEN event_id % 400 = 5 THEN double('-inf')"
    value = f"CASE {infinite} WHEN event_id % 300 = 7 THEN -1e9D ELSE value END AS value"
    events = table(spark, d, "events").where("event_type <> 'purchase'")
    sensor = events.selectExpr("event_type AS tag", "ts", "event_id AS row_id", value)
    rows = scans.window_features(src.anchors(spark, d), sensor)
    return rows.selectExpr("anchor_id", "`window`", "tag", "n", "min", "max", "last", _digits("mean"), _digits("std"))


ASOF_ALL_SQL = f"""WITH {src.SENSOR_SQL}, asked AS (SELECT anchor_id, ts, tag FROM anchors, (SELECT DISTINCT tag FROM sensor))
        SELECT anchor_id, a.tag, s.value, epoch_us(a.ts) - epoch_us(s.ts) AS age_micros
          FROM asked a ASOF LEFT JOIN sensor s ON a.tag = s.tag AND a.ts >= s.ts"""


@query("asof_any_age", ASOF_ALL_SQL)
def asof_any_age(spark, d):
    return scans.asof_join(src.anchors(spark, d), src.sensor(spark, d), src.TAGS)


@query("asof_chunks", ASOF_ALL_SQL)
def asof_chunks(spark, d):
    return scans.asof_join(src.anchors(spark, d), src.sensor(spark, d), src.TAGS, max_group_rows=0)


@query(
    "range_join_pairs",
    f"""WITH {src.SENSOR_SQL} SELECT anchor_id, s.row_id, s.tag FROM anchors a
        JOIN sensor s ON s.ts > a.ts - INTERVAL 60 MINUTE AND s.ts <= a.ts""",
)
def range_join_pairs(spark, d):
    pairs = scans.range_join(src.anchors(spark, d), src.sensor(spark, d), 60, max_bucket_rows=3)
    return pairs.select(F.col("anchor_anchor_id").alias("anchor_id"), "row_id", "tag")


def _id_split_sql(key: str) -> str:
    return f"""WITH numbered AS (SELECT event_id, {key} AS k FROM events), ranked AS (
        SELECT event_id, row_number() OVER (ORDER BY k) AS rn, count(*) OVER () AS n FROM numbered)
        SELECT event_id, CASE WHEN rn <= floor(n * (1 - CAST(0.25 AS DOUBLE))) THEN 'train' ELSE 'test' END AS part FROM ranked"""


@query("text_id_split", _id_split_sql("event_type || '_' || event_id"))
def text_id_split(spark, d):
    rows = table(spark, d, "events").select("event_id", F.concat_ws("_", "event_type", "event_id").alias("k"))
    return order.time_split(rows, None, 0.25, "floor", ["k"]).select("event_id", "part")


@query("decimal_id_split", _id_split_sql("CAST(event_id * 7919 % 10007 AS DECIMAL(38,0)) * 1000000 + event_id"))
def decimal_id_split(spark, d):
    """Ids near 1.2e19, which doubles cannot tell apart."""
    key = "CAST('12000000000000000000' AS DECIMAL(38,0)) + CAST(event_id * 7919 % 10007 AS DECIMAL(38,0)) * 1000000 + event_id"
    rows = table(spark, d, "events").selectExpr("event_id", f"CAST({key} AS DECIMAL(38,0)) AS k")
    return order.time_split(rows, None, 0.25, "floor", ["k"]).select("event_id", "part")


@query(
    "tied_folds",
    """WITH numbered AS (SELECT o_orderkey, row_number() OVER (ORDER BY year(o_orderdate), o_orderkey) AS rn, count(*) OVER () AS n FROM orders),
       folds AS (SELECT o_orderkey, k AS fold, rn, n - (4 - k + 1) * (n // 5) AS trains, n // 5 AS m FROM numbered, range(1, 5) t(k))
       SELECT o_orderkey, CAST(fold AS INTEGER) AS fold, CASE WHEN rn <= trains THEN 'train' ELSE 'test' END AS role
       FROM folds WHERE rn <= trains + m""",
)
def tied_folds(spark, d):
    """Time keys with a few values only; the ids break the ties."""
    rows = table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), "o_orderkey")
    return order.expanding_folds(rows, 4, "y", ["o_orderkey"]).select("o_orderkey", "fold", "role")


def _folder(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tagloom-{uuid.uuid4().hex}"


@query("guarded_rows", "SELECT event_id, value FROM events")
def guarded_rows(spark, d):
    """Rows that pass the guards on columns, types, row count and a strict feature list."""
    events = table(spark, d, "events")
    rows = require_min_rows(columns.require_columns(events, ["event_id", "value"]), 10)
    columns.validate_numeric(rows, ["value"])
    listed = events.select(F.lit("value").alias("feature"), F.col("event_id").alias("pos"))
    names = columns.require_features(ordered_distinct(listed, "feature", "pos"), rows)
    return rows.select("event_id", *names)


@query("metrics_read_back", f"WITH {src.PREDICTIONS_SQL} SELECT * FROM {src.metrics_sql('target, model')}")
def metrics_read_back(spark, d):
    path = _folder(spark)
    sinks.write_metrics(src.metrics(spark, d, "target", "model"), path)
    return spark.read.parquet(path)


@query(
    "run_log_read_back",
    f"""WITH {src.PREDICTIONS_SQL}, rows AS (SELECT * FROM {src.metrics_sql('target, model')})
        SELECT *, true AS dated FROM rows UNION ALL SELECT *, true FROM rows""",
)
def run_log_read_back(spark, d):
    """Two runs appended to one log."""
    path, metrics = _folder(spark), src.metrics(spark, d, "target", "model")
    for _ in range(2):
        sinks.write_run_log(metrics, path)
    log = spark.read.parquet(path)
    return log.withColumn("dated", F.col("run_date").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$")).drop("run_date")


@query(
    "predictions_read_back",
    f"WITH {src.PREDICTIONS_SQL} SELECT {IDS}, model, y_true, round(y_pred + 1e-9, 6) AS y_pred FROM predictions",
)
def predictions_read_back(spark, d):
    path = _folder(spark)
    sinks.write_predictions(src.predictions(spark, d).select(*src.LINE_IDS, "model", "y_true", "y_pred"), path)
    return rounded(spark.read.parquet(path), "y_pred")


@query(
    "run_info_read_back",
    f"""WITH {src.PREDICTIONS_SQL}, folds AS (SELECT * FROM {src.metrics_sql('fold')})
        SELECT 'flat_and_retail' AS experiment_name, 7 AS n_splits, folds.*, round((SELECT avg(mae) FROM folds) + 1e-9, 6) AS mae_mean FROM folds""",
)
def run_info_read_back(spark, d):
    """A run document written as JSON and read back: its settings, its folds and a summary value."""
    folds = src.metrics(spark, d, "fold")
    info = sinks.run_info(folds, {"experiment_name": "flat_and_retail", "n_splits": 7}, fold_summary(folds))
    path = _folder(spark)
    sinks.write_run_info(info, path)
    read = spark.read.schema(info.schema).json(path)
    flat = read.select("experiment_name", "n_splits", F.inline("folds"), F.col("summary.mae_mean").alias("mae_mean"))
    return rounded(flat, "mae_mean")
