"""Queries: time index, splits, folds, rankings, lags, rolling means, resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.operators import order, series
from tagloom.operators.metrics import run_sizes
from tagloom.plans import inputs as src
from tagloom.plans.inputs import EVENT_ORDER, table
from tagloom.plans.registry import query, r6, rounded

ORDER_KEYS = ["o_orderdate", "o_orderkey"]


def _orders_split(spark, d):
    rows = table(spark, d, "orders").select(*ORDER_KEYS, "o_totalprice")
    return order.time_split(rows, "o_orderdate", 0.2, "floor", ["o_orderkey"])


ORDERS_SPLIT_SQL = """
numbered AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders),
split AS (SELECT *, CASE WHEN rn <= floor(n * (1 - CAST(0.2 AS DOUBLE))) THEN 'train' ELSE 'test' END AS part FROM numbered)"""

EVENTS_NUMBERED_SQL = """
numbered AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM events)"""


@query(
    "time_index",
    "SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders",
)
def time_index(spark, d):
    return order.with_time_index(table(spark, d, "orders").select(*ORDER_KEYS), "o_orderdate", "o_orderkey")


@query("time_split", f"WITH {ORDERS_SPLIT_SQL} SELECT o_orderkey, o_orderdate, part FROM split")
def time_split(spark, d):
    return _orders_split(spark, d).select("o_orderkey", "o_orderdate", "part")


@query(
    "time_split_rounded",
    f"""WITH {EVENTS_NUMBERED_SQL} SELECT event_id, ts,
        CASE WHEN rn <= n - greatest(1, round_even(n * CAST(0.15 AS DOUBLE), 0)) THEN 'train' ELSE 'test' END AS part FROM numbered""",
)
def time_split_rounded(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts")
    return order.time_split(rows, "ts", 0.15, "half_even", ["event_id"])


@query(
    "order_split",
    """WITH numbered AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
       SELECT o_orderkey, CASE WHEN rn <= floor(n * (1 - CAST(0.3 AS DOUBLE))) THEN 'train' ELSE 'test' END AS part FROM numbered""",
)
def order_split(spark, d):
    return order.time_split(table(spark, d, "orders").select("o_orderkey"), None, 0.3, "floor", ["o_orderkey"])


@query(
    "cutoff_split",
    """SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'train' ELSE 'test' END AS part FROM orders""",
)
def cutoff_split(spark, d):
    rows = order.cutoff_split(table(spark, d, "orders"), "o_orderdate", "1999-01-01")
    return rows.select("o_orderkey", "part")


FOLDS_SQL = f"""{EVENTS_NUMBERED_SQL},
bounds AS (SELECT k, n - (4 - k + 1) * (n // 5) AS trains, n // 5 AS m FROM (SELECT DISTINCT n FROM numbered), range(1, 5) t(k)),
folds AS (SELECT e.*, CAST(k AS INTEGER) AS fold, CASE WHEN rn <= trains THEN 'train' ELSE 'test' END AS role
  FROM numbered e JOIN bounds b ON rn <= trains + m)"""


def event_folds(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts", "event_type", "value")
    return order.expanding_folds(rows, 4, "ts", ["event_id"])


@query("expanding_folds", f"WITH {FOLDS_SQL} SELECT event_id, fold, role FROM folds")
def expanding_folds(spark, d):
    return event_folds(spark, d).select("event_id", "fold", "role")


SCORES_SQL = """scores AS (SELECT 'part_' || l_partkey AS feature, sum(l_quantity) AS importance FROM lineitem GROUP BY l_partkey)"""


def _scores(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("importance"))
    return lines.select(F.concat(F.lit("part_"), F.col("l_partkey")).alias("feature"), "importance")


@query("top_n_importance", f"WITH {SCORES_SQL} SELECT * FROM scores ORDER BY importance DESC, feature LIMIT 20")
def top_n_importance(spark, d):
    return order.top_n(_scores(spark, d), "importance", 20, ["feature"])


@query(
    "top_n_variants",
    f"""WITH {SCORES_SQL}, ranked AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM scores)
        SELECT feature, importance, rank, 'top_' || n AS variant FROM ranked JOIN (VALUES (30), (50), (100)) v(n) ON rank <= n""",
)
def top_n_variants(spark, d):
    return order.top_n_variants(_scores(spark, d), "importance", [30, 50, 100], ["feature"])


BEST_SQL = f"""
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY mae, model) AS pick
  FROM {src.metrics_sql("target, model")}) WHERE pick = 1)"""


def _best(spark, d):
    return order.best_by(src.metrics(spark, d, "target", "model"), ["target"], "mae", ["model"])


@query("best_model_per_target", f"WITH {src.PREDICTIONS_SQL}, {BEST_SQL} SELECT target, model, n, mae, rmse, r2 FROM best")
def best_model_per_target(spark, d):
    return _best(spark, d)


@query(
    "rank_results",
    f"""WITH {src.PREDICTIONS_SQL} SELECT *, row_number() OVER (ORDER BY mae, target, model, fold) AS rank
        FROM {src.metrics_sql("target, model, fold")}""",
)
def rank_results(spark, d):
    rows = src.metrics(spark, d, "target", "model", "fold")
    return order.rank_results(rows, "mae", ["target", "model", "fold"])


@query(
    "first_per_family",
    """SELECT p_type, p_name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS pick
       FROM part) WHERE pick = 1""",
)
def first_per_family(spark, d):
    rows = table(spark, d, "part").select("p_type", "p_name", "p_partkey")
    return order.first_per_family(rows, "p_type", "p_partkey")


@query(
    "rank_targets",
    f"""WITH {src.PREDICTIONS_SQL}, {BEST_SQL},
        ranked AS (SELECT target, model, n, mae, rmse, r2, row_number() OVER (ORDER BY mae, target) AS rank, count(*) OVER () AS k FROM best)
        SELECT target, model, n, mae, rmse, r2, rank, CASE WHEN rank = 1 THEN 'best_target' WHEN r2 > 0 THEN 'positive_r2'
          WHEN rank = k THEN 'hardest_target' END AS status FROM ranked""",
)
def rank_targets(spark, d):
    return order.rank_targets(_best(spark, d))


@query(
    "run_sizes",
    f"""WITH {ORDERS_SPLIT_SQL} SELECT count(*) AS n_rows, CAST(1 AS BIGINT) AS n_features,
        count(*) FILTER (WHERE part = 'train') AS train_size, count(*) FILTER (WHERE part = 'test') AS test_size FROM split""",
)
def run_sizes_query(spark, d):
    return run_sizes(_orders_split(spark, d), 1)


@query(
    "lag_features",
    """SELECT event_id, event_type, value, lag(value, 1) OVER w AS value_lag1, lag(value, 2) OVER w AS value_lag2
       FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""",
)
def lag_features(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts", "event_type", "value")
    lagged = series.add_lags(rows, ["value", "no_such_signal"], [1, 2], EVENT_ORDER, ["event_type"])
    return lagged.drop("ts")


@query(
    "rolling_mean",
    """WITH gaps AS (SELECT event_id, ts, user_id, CASE WHEN value >= 5 THEN value END AS value FROM events)
       SELECT event_id, user_id, round(CASE WHEN count(value) OVER w = 3 THEN avg(value) OVER w END + 1e-9, 6) AS value_roll3_mean
       FROM gaps WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def rolling_mean(spark, d):
    rows = table(spark, d, "events").selectExpr(
        "event_id", "ts", "user_id", "CASE WHEN value >= 5 THEN value END AS value"
    )
    rolled = series.add_rolling_mean(rows, ["value"], [3], EVENT_ORDER, ["user_id"])
    return rolled.select("event_id", "user_id", r6("value_roll3_mean").alias("value_roll3_mean"))


@query(
    "lag_within_split",
    f"""WITH {EVENTS_NUMBERED_SQL}, split AS (SELECT *, CASE WHEN rn <= floor(n * (1 - CAST(0.2 AS DOUBLE)))
          THEN 'train' ELSE 'test' END AS part FROM numbered)
        SELECT event_id, part, lag(value, 1) OVER (PARTITION BY event_type, part ORDER BY ts, event_id) AS value_lag1 FROM split""",
)
def lag_within_split(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts", "event_type", "value")
    split = order.time_split(rows, "ts", 0.2, "floor", ["event_id"])
    lagged = series.add_lags(split, ["value"], [1], EVENT_ORDER, ["event_type", "part"])
    return lagged.select("event_id", "part", "value_lag1")


DAILY_SIGNALS = ("n_orders", "total_cents", "max_cents")


@query(
    "temporal_features",
    f"""WITH {src.DAILY_SQL} SELECT day, n_orders, total_cents, max_cents, n_customers,
        {", ".join(f"lag({c}, 1) OVER w AS {c}_lag1, lag({c}, 2) OVER w AS {c}_lag2" for c in DAILY_SIGNALS)},
        {", ".join(f"round(CASE WHEN count({c}) OVER r = 3 THEN avg({c}) OVER r END + 1e-9, 6) AS {c}_roll3_mean" for c in DAILY_SIGNALS)}
        FROM daily WINDOW w AS (ORDER BY day), r AS (ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def temporal_features(spark, d):
    rows = series.temporal_features(src.daily(spark, d), ["day"], signals=DAILY_SIGNALS)
    return rounded(rows, *[f"{c}_roll3_mean" for c in DAILY_SIGNALS])


@query(
    "horizon_label",
    """SELECT event_id, user_id, value, lead(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events""",
)
def horizon_label(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts", "user_id", "value")
    return series.add_horizon_label(rows, "value", 2, EVENT_ORDER, ["user_id"]).drop("ts")


@query(
    "resample_6min",
    """SELECT event_type, time_bucket(INTERVAL '6 minutes', ts) AS step, round(avg(value) + 1e-9, 6) AS mean,
         round(stddev_samp(value) + 1e-9, 6) AS std, min(value) AS min, max(value) AS max, arg_max(value, (ts, event_id)) AS last
       FROM events GROUP BY ALL""",
)
def resample_6min(spark, d):
    rows = series.resample(table(spark, d, "events"), "ts", "value", 6, ["event_type"], "event_id")
    return rounded(rows, "mean", "std")


@query(
    "resample_6min_filled",
    """WITH steps AS (SELECT event_type, time_bucket(INTERVAL '6 minutes', ts) AS step, round(avg(value) + 1e-9, 6) AS mean,
         min(value) AS min, max(value) AS max, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY ALL),
       ends AS (SELECT event_type, min(step) AS a, max(step) AS b FROM steps GROUP BY event_type),
       grid AS (SELECT event_type, unnest(generate_series(a, b, INTERVAL '6 minutes')) AS step FROM ends)
       SELECT event_type, step, mean, min, max, last_value(last IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY step) AS last,
         s.max IS NULL AS empty FROM grid LEFT JOIN steps s USING (event_type, step)""",
)
def resample_6min_filled(spark, d):
    stats = ("mean", "min", "max", "last")
    rows = series.resample_filled(table(spark, d, "events"), "ts", "value", 6, ["event_type"], "event_id", stats)
    return rounded(rows, "mean")
