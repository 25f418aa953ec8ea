"""Queries: models and experiments."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tagloom.models import experiments as ex
from tagloom.models.boosting import tree_columns
from tagloom.models.fit import NaiveMean, assemble, fit_model, importance, naive_mean, persistence, predict
from tagloom.models.runs import run_grid_logged
from tagloom.models.specs import SPECS, Spec
from tagloom.operators.metrics import regression_metrics
from tagloom.operators.order import cutoff_split, expanding_folds, time_split
from tagloom.operators.series import temporal_features
from tagloom.plans import inputs as src
from tagloom.plans.inputs import EVENT_ORDER, table
from tagloom.plans.ordering import DAILY_SIGNALS, FOLDS_SQL, event_folds
from tagloom.plans.registry import ORACLES, query, r6, rounded
from tagloom.sources import sinks
from tagloom.sources.staging import shared_folder, stage
from tagloom.sources.tables import ordered_distinct

LABEL = "total_cents"
NEAR = ["n_orders", "n_customers", "max_cents"]
PAST = [f"{c}_{s}" for c in DAILY_SIGNALS for s in ("lag1", "lag2", "roll3_mean")]
FEATURES = [*NEAR, *PAST]
ROUNDED = ("mae", "rmse", "r2")


def _daily(spark, d):
    """Daily order totals with lags, written once; the label is in millions.

    An experiment passes over its feature table many times, so it is a table of its own.
    """
    rows = temporal_features(src.daily(spark, d), ["day"], signals=DAILY_SIGNALS)
    return stage(
        rows.withColumns({LABEL: F.col(LABEL) / 1e8, "top_order": F.col("max_cents") / 1e6})
    )


def _split(spark, d):
    return time_split(_daily(spark, d), "day", 0.2)


def _predict(spark, d, name):
    return ex.fit_predict(_split(spark, d), FEATURES, LABEL, SPECS[name], ["day"], ["day"])


@query("rf_predict")
def rf_predict(spark, d):
    return _predict(spark, d, "rf_medium")


@query("gbt_predict")
def gbt_predict(spark, d):
    return _predict(spark, d, "gb_default")


DAYS_SQL = f"""{src.DAILY_SQL},
numbered AS (SELECT *, row_number() OVER (ORDER BY day) AS rn, count(*) OVER () AS n FROM daily),
days AS (SELECT day, rn, n, n_orders, n_customers, total_cents / 1e8 AS total, max_cents / 1e6 AS top_order,
  CASE WHEN rn <= floor(n * (1 - CAST(0.2 AS DOUBLE))) THEN 'train' ELSE 'test' END AS part FROM numbered)"""


def _line_sql(x: str, y: str, model: str, rows: str, group: str = "") -> str:
    """Test predictions of a one-feature linear model in closed form, per group."""
    slope = {
        "ridge": "sxy / (sxx + 1)",
        "elasticnet": "sign(sxy) * greatest(abs(sxy) / k - 0.5, 0) / (sxx / k + 0.5)",
        "naive_mean": "0",
    }[model]
    key, using = (f"{group},", f"USING ({group})") if group else ("", "ON true")
    return f"""SELECT t.*, {y} AS y_true, my + ({slope}) * ({x} - mx) AS y_pred FROM (SELECT * FROM {rows} WHERE part = 'test') t
      JOIN (SELECT {key} count(*) AS k, avg({x}) AS mx, avg({y}) AS my, regr_sxy({y}, {x}) AS sxy, regr_sxx({y}, {x}) AS sxx
            FROM {rows} WHERE part = 'train' {f"GROUP BY {group}" if group else ""}) f {using}"""


@query(
    "elasticnet_predict",
    f"""WITH {DAYS_SQL} SELECT day, y_true, round(y_pred + 1e-9, 6) AS y_pred
        FROM ({_line_sql("n_orders", "total", "elasticnet", "days")})""",
)
def elasticnet_predict(spark, d):
    rows = ex.fit_predict(_split(spark, d), ["n_orders"], LABEL, SPECS["elasticnet"], ["day"], ["day"])
    return rounded(rows, "y_pred")


LINEAR = ("ridge", "elasticnet", "naive_mean")


@query(
    "run_grid_linear",
    f"""WITH {DAYS_SQL}, predictions AS (
        {" UNION ALL ".join(f"SELECT '{k}' AS run, y_true, y_pred FROM ({_line_sql('n_orders', 'total', k, 'days')})" for k in LINEAR)})
        SELECT * FROM {src.metrics_sql('run')}""",
)
def run_grid_linear(spark, d):
    grid = ex.run_grid(_split(spark, d), ["n_orders"], LABEL, [SPECS[k] for k in LINEAR], ["day"])
    return rounded(grid, *ROUNDED).select("run", "n", *ROUNDED)


@query("run_grid_resumed", f"SELECT *, run <> 'naive_mean' AS reused FROM ({ORACLES['run_grid_linear']})")
def run_grid_resumed(spark, d):
    """A grid of two configurations, then one of three that takes those two from the table of finished runs."""
    rows, folder = _split(spark, d), f"{shared_folder(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    specs = [SPECS[k] for k in LINEAR]
    run_grid_logged(rows, ["n_orders"], LABEL, specs[:2], folder, ["day"])
    grid = run_grid_logged(rows, ["n_orders"], LABEL, specs, folder, ["day"])
    return rounded(grid, *ROUNDED).select("run", "n", *ROUNDED, "reused")


@query(
    "walk_forward_ridge",
    f"""WITH {DAYS_SQL}, cuts AS (SELECT k AS fold, n - (4 - k + 1) * (n // 5) AS trains, n // 5 AS m
          FROM (SELECT DISTINCT n FROM days), range(1, 5) t(k)),
        folds AS (SELECT CAST(fold AS INTEGER) AS fold, n_orders, total, CASE WHEN rn <= trains THEN 'train' ELSE 'test' END AS part
          FROM days JOIN cuts ON rn <= trains + m),
        sizes AS (SELECT fold, count(*) AS train_size FROM folds WHERE part = 'train' GROUP BY fold),
        predictions AS ({_line_sql("n_orders", "total", "ridge", "folds", "fold")})
        SELECT fold, train_size, n AS test_size, mae, rmse, r2 FROM {src.metrics_sql('fold')} JOIN sizes USING (fold)""",
)
def walk_forward_ridge(spark, d):
    folds = expanding_folds(_daily(spark, d), 4, "day")
    metrics = ex.walk_forward(folds, ["n_orders"], LABEL, SPECS["ridge"], 4, order=["day"])[1]
    return rounded(metrics, *ROUNDED).drop("reselected")


@query(
    "compare_targets_linear",
    f"""WITH {DAYS_SQL}, predictions AS (
        {" UNION ALL ".join(f"SELECT '{t}' AS target, '{k}' AS run, y_true, y_pred FROM ({_line_sql('n_customers', y, k, 'days')})"
                            for t, y in (("total_cents", "total"), ("top_order", "top_order")) for k in ("ridge", "naive_mean"))})
        SELECT target, run, n, mae, rmse, r2 FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY mae) AS pick
          FROM {src.metrics_sql('target, run')}) WHERE pick = 1""",
)
def compare_targets_linear(spark, d):
    specs = [SPECS["ridge"], SPECS["naive_mean"]]
    best = ex.compare_targets(_split(spark, d), [LABEL, "top_order"], ["n_customers"], specs, ["day"])[1]
    return rounded(best, *ROUNDED).select("target", "run", "n", *ROUNDED)


@query(
    "ablation_linear",
    f"""WITH {DAYS_SQL}, predictions AS (
        SELECT 'without_customers' AS variant, y_true, y_pred FROM ({_line_sql("n_orders", "total", "ridge", "days")})
        UNION ALL SELECT 'without_orders', y_true, y_pred FROM ({_line_sql("n_customers", "total", "ridge", "days")}))
        SELECT * FROM {src.metrics_sql('variant')}""",
)
def ablation_linear(spark, d):
    sets = {"without_customers": ["n_customers"], "without_orders": ["n_orders"]}
    runs = ex.ablation(_split(spark, d), ["n_orders", "n_customers"], LABEL, [SPECS["ridge"]], sets, ["day"])
    return rounded(runs, *ROUNDED).select("variant", "n", *ROUNDED)


@query(
    "transfer_ridge",
    f"""WITH {DAYS_SQL}, cut AS (SELECT * EXCLUDE (part), CASE WHEN rn <= n - greatest(1, round_even(n * CAST(0.2 AS DOUBLE), 0))
          THEN 'train' ELSE 'test' END AS part FROM days),
        predictions AS ({_line_sql("n_orders", "top_order", "ridge", "cut")})
        SELECT *, (SELECT count(DISTINCT o_orderpriority) + 1 FROM orders) AS n_requested_features, 1 AS n_found_features,
          (SELECT count(DISTINCT o_orderpriority) FROM orders) AS n_missing_features FROM {src.metrics_sql('')}""",
)
def transfer_ridge(spark, d):
    """A feature list found in the data, of which the daily table has one."""
    names = F.explode(F.array(F.col("o_orderpriority"), F.lit("n_orders")))
    listed = table(spark, d, "orders").select(names.alias("feature"), F.col("o_orderkey").alias("pos"))
    features = ordered_distinct(listed, "feature", "pos")
    metrics = ex.transfer(_daily(spark, d), features, "top_order", SPECS["ridge"], "day", [])[1]
    return rounded(metrics, *ROUNDED).drop("run").withColumn("n_found_features", F.col("n_found_features").cast("int"))


@query("rf_importance")
def rf_importance(spark, d):
    return ex.fit_importance(_split(spark, d), FEATURES, LABEL, SPECS["rf_medium"], ["day"])


@query(
    "ridge_fit",
    """WITH train AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01'),
       c AS (SELECT avg(x) AS mx, avg(y) AS my FROM train),
       s AS (SELECT count(*) AS n, sum((x - mx) * (y - my)) AS sxy, sum((x - mx) * (x - mx)) AS sxx, any_value(mx) AS mx, any_value(my) AS my FROM train, c)
       SELECT n, round(sxy / (sxx + 1) + 1e-9, 6) AS slope, round(my - mx * sxy / (sxx + 1) + 1e-9, 6) AS intercept FROM s""",
)
def ridge_fit(spark, d):
    rows = cutoff_split(table(spark, d, "lineitem"), "l_shipdate", "1999-01-01").where("part = 'train'")
    train = assemble(rows.withColumn("y", F.col("l_extendedprice") / 1000), ["l_quantity"], "y")
    model = fit_model(train, SPECS["ridge"])
    return train.agg(F.count(F.lit(1)).alias("n")).select(
        "n",
        r6(F.lit(float(model.coefficients[0]))).alias("slope"),
        r6(F.lit(float(model.intercept))).alias("intercept"),
    )


@query(
    "naive_mean_metrics",
    f"""WITH numbered AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM events),
        cut AS (SELECT event_type, rn <= floor(n * (1 - CAST(0.2 AS DOUBLE))) AS train, value FROM numbered),
        means AS (SELECT avg(value) AS y_pred FROM cut WHERE train),
        predictions AS (SELECT event_type, value AS y_true, y_pred FROM cut, means WHERE NOT train)
        SELECT * FROM {src.metrics_sql('event_type')}""",
)
def naive_mean_metrics(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts", "event_type", "value")
    split = time_split(rows, "ts", 0.2, "floor", ["event_id"])
    return rounded(regression_metrics(naive_mean(split, "value"), ["event_type"]), *ROUNDED)


@query(
    "persistence_metrics",
    f"""WITH predictions AS (SELECT event_type, value AS y_true,
          lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS y_pred FROM events),
        known AS (SELECT * FROM predictions WHERE y_pred IS NOT NULL)
        SELECT * FROM {src.metrics_sql('event_type', 'known')}""",
)
def persistence_metrics(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts", "event_type", "value")
    return rounded(
        regression_metrics(persistence(rows, "value", EVENT_ORDER, ["event_type"]), ["event_type"]), *ROUNDED
    )


def _stump_sql(x: str, y: str) -> str:
    """The best split of one feature with few values, and the means on its two sides."""
    return f"""WITH rows AS (SELECT {x} AS x, {y} AS y FROM lineitem),
        bars AS (SELECT x, lead(x) OVER (ORDER BY x) AS next FROM (SELECT DISTINCT x FROM rows)),
        sides AS (SELECT (bars.x + next) / 2 AS bar, rows.x <= bars.x AS low, count(*) AS n, sum(y) AS s
          FROM rows, bars WHERE next IS NOT NULL GROUP BY 1, 2),
        gains AS (SELECT bar, sum(s * s / n) AS gain, max(s / n) FILTER (WHERE low) AS mean_low, max(s / n) FILTER (WHERE NOT low) AS mean_high
          FROM sides GROUP BY bar)"""


@query(
    "stump_fit",
    f"""{_stump_sql("l_linenumber", "l_extendedprice / 1000")} SELECT bar AS threshold, round(mean_low + 1e-9, 6) AS mean_low,
        round(mean_high + 1e-9, 6) AS mean_high, CAST(1 AS DOUBLE) AS importance FROM gains ORDER BY gain DESC LIMIT 1""",
)
def stump_fit(spark, d):
    """One tree of depth one over all rows: its split, its leaves and its importance have a closed form.

    The split is read from the predictions: it lies halfway between the greatest value on the low side and the
    least one on the high side.
    """
    lines = table(spark, d, "lineitem").select("l_linenumber", (F.col("l_extendedprice") / 1000).alias("y"))
    spec = Spec("stump", "random_forest", {"trees": 1, "depth": 1, "bootstrap": False})
    data = assemble(lines, ["l_linenumber"], "y")
    model = fit_model(data, spec)
    sides = predict(model, data, ["l_linenumber"]).groupBy("y_pred").agg(
        F.min("l_linenumber").alias("first"), F.max("l_linenumber").alias("last")
    )
    split = sides.agg(
        ((F.min("last") + F.max("first")) / 2).alias("threshold"),
        F.min_by("y_pred", "first").alias("mean_low"),
        F.max_by("y_pred", "first").alias("mean_high"),
    )
    return rounded(split, "mean_low", "mean_high").withColumn("importance", F.lit(float(model.featureImportances[0])))


@query(
    "model_read_back",
    f"""WITH {DAYS_SQL} SELECT run, day, y_true, round(y_pred + 1e-9, 6) AS y_pred FROM (
        {" UNION ALL ".join(f"SELECT '{k}' AS run, day, y_true, y_pred FROM ({_line_sql('n_orders', 'total', k, 'days')})" for k in ("ridge", "naive_mean"))})""",
)
def model_read_back(spark, d):
    """Models saved, loaded into fresh objects, and used on the test rows."""
    data = stage(ex.prepare(_split(spark, d), ["n_orders"], LABEL, ["day"]))
    folder, found = f"{shared_folder(spark).rstrip('/')}/models-{uuid.uuid4().hex}", []
    for name, load in (("ridge", sinks.load_model), ("naive_mean", NaiveMean.load)):
        path = sinks.save_model(fit_model(data.where("part = 'train'"), SPECS[name]), folder, "days", name)
        found.append(predict(load(path), data.where("part = 'test'"), ["day"]).withColumn("run", F.lit(name)))
    return rounded(found[0].unionByName(found[1]), "y_pred")


STUMPS = Spec("stumps", "boosted_trees", {"trees": 2, "depth": 1, "rate": 0.5, "rows": 0.9, "columns": 0.7})
FEW = ["l_linenumber", "tax", "discount"]


def _boost_step_sql(tree: int, rows: str) -> str:
    """One boosting step over ``rows`` (with ``margin``): the best split of the tree's columns on its own rows."""
    chosen = [FEW[c] for c in tree_columns(len(FEW), STUMPS.params["columns"], tree)]
    part = f"CAST('0x' || substr(md5(concat_ws('|', {tree}, {', '.join(src.LINE_IDS)})), 1, 8) AS BIGINT) < {int(STUMPS.params['rows'] * 2**32)}"
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x, y - margin AS r FROM {rows} WHERE {part}" for c in chosen)
    value = " ".join(f"WHEN '{c}' THEN {c}" for c in chosen)
    return f"""bars{tree} AS (SELECT feature, x, lead(x) OVER w AS next, sum(n) OVER w AS nl, sum(s) OVER w AS sl,
          sum(n) OVER (PARTITION BY feature) AS n, sum(s) OVER (PARTITION BY feature) AS s
          FROM (SELECT feature, x, count(*) AS n, sum(r) AS s FROM ({long}) GROUP BY ALL) WINDOW w AS (PARTITION BY feature ORDER BY x)),
        best{tree} AS (SELECT feature, (x + next) / 2 AS bar, sl / nl AS low, (s - sl) / (n - nl) AS high FROM bars{tree} WHERE next IS NOT NULL
          ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC LIMIT 1),
        step{tree} AS (SELECT t.* REPLACE (margin + {STUMPS.params["rate"]} * CASE WHEN CASE feature {value} END <= bar THEN low ELSE high END AS margin)
          FROM {rows} t, best{tree})"""


@query(
    "boosted_stumps",
    f"""WITH lines AS (SELECT *, round(l_tax * 100) AS tax, round(l_discount * 100) AS discount, l_extendedprice / 1000 AS y FROM lineitem),
        step AS (SELECT *, avg(y) OVER () AS margin FROM lines), {_boost_step_sql(0, "step")}, {_boost_step_sql(1, "step0")}
        SELECT l_linenumber, tax, discount, count(*) AS n, round(max(margin) + 1e-9, 6) AS y_pred FROM step1 GROUP BY ALL""",
)
def boosted_stumps(spark, d):
    """Two boosting steps of depth one over all line items, each with its own columns and rows."""
    lines = table(spark, d, "lineitem").select(
        *src.LINE_IDS, F.round(F.col("l_tax") * 100).alias("tax"), F.round(F.col("l_discount") * 100).alias("discount"),
        (F.col("l_extendedprice") / 1000).alias("y"),
    )
    data = assemble(lines, FEW, "y")
    found = predict(fit_model(data, STUMPS, src.LINE_IDS), data, FEW)
    return rounded(found.groupBy(*FEW).agg(F.count(F.lit(1)).alias("n"), F.max("y_pred").alias("y_pred")), "y_pred")


TREE = Spec("tree", "random_forest", {"trees": 1, "depth": 2, "bootstrap": False})


def _tree_level_sql(level: int, rows: str) -> str:
    """The best split of every node of ``rows`` (with ``node``), and the rows in the nodes below."""
    long = " UNION ALL ".join(f"SELECT node, '{c}' AS feature, {c} AS x, y FROM {rows}" for c in FEW)
    value = " ".join(f"WHEN '{c}' THEN {c}" for c in FEW)
    return f"""cells{level} AS (SELECT node, feature, x, lead(x) OVER w AS next, sum(n) OVER w AS nl, sum(s) OVER w AS sl,
          sum(n) OVER (PARTITION BY node, feature) AS n, sum(s) OVER (PARTITION BY node, feature) AS s
          FROM (SELECT node, feature, x, count(*) AS n, sum(y) AS s FROM ({long}) GROUP BY ALL) WINDOW w AS (PARTITION BY node, feature ORDER BY x)),
        best{level} AS (SELECT DISTINCT ON (node) node, feature, (x + next) / 2 AS bar, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n AS gain
          FROM cells{level} WHERE next IS NOT NULL ORDER BY node, gain DESC),
        level{level} AS (SELECT t.* REPLACE (2 * node + CASE WHEN CASE feature {value} END > bar THEN 1 ELSE 0 END AS node)
          FROM {rows} t JOIN best{level} USING (node))"""


TREE_SQL = f"""WITH lines AS (SELECT l_linenumber, round(l_tax * 100) AS tax, round(l_discount * 100) AS discount, l_extendedprice / 1000 AS y, 1 AS node FROM lineitem),
        {_tree_level_sql(0, "lines")}, {_tree_level_sql(1, "level0")}"""


def _tree(spark, d):
    """Two levels of one tree over all line items, grown on features with few values, so that its splits have a closed form."""
    lines = table(spark, d, "lineitem").select(
        "l_linenumber", F.round(F.col("l_tax") * 100).alias("tax"), F.round(F.col("l_discount") * 100).alias("discount"),
        (F.col("l_extendedprice") / 1000).alias("y"),
    )
    data = assemble(lines, FEW, "y")
    return data, fit_model(data, TREE)


@query(
    "tree_importance",
    f"""{TREE_SQL}, gains AS (SELECT feature, gain FROM best0 UNION ALL SELECT feature, gain FROM best1),
        shares AS (SELECT feature, coalesce(sum(gain), 0) / (SELECT sum(gain) FROM gains) AS share
          FROM (VALUES {", ".join(f"('{c}')" for c in FEW)}) f(feature) LEFT JOIN gains USING (feature) GROUP BY feature)
        SELECT feature, round(share + 1e-9, 6) AS importance, row_number() OVER (ORDER BY share DESC, feature) AS rank FROM shares""",
)
def tree_importance(spark, d):
    return rounded(importance(spark, _tree(spark, d)[1], FEW), "importance")


@query(
    "tree_predict",
    f"""{TREE_SQL}, means AS (SELECT node, avg(y) AS y_pred FROM level1 GROUP BY node)
        SELECT l_linenumber, tax, discount, count(*) AS n, round(max(y_pred) + 1e-9, 6) AS y_pred
        FROM level1 JOIN means USING (node) GROUP BY l_linenumber, tax, discount""",
)
def tree_predict(spark, d):
    """Predictions of the tree for every combination of its features, with the rows that have it."""
    data, model = _tree(spark, d)
    found = predict(model, data, FEW).groupBy(*FEW).agg(F.count(F.lit(1)).alias("n"), F.max("y_pred").alias("y_pred"))
    return rounded(found, "y_pred")


@query("run_grid")
def run_grid(spark, d):
    specs = [SPECS[n] for n in ("gb_default", "ridge", "naive_mean")]
    return ex.run_grid(_split(spark, d), FEATURES, LABEL, specs, ["day"])


@query("topn_refit")
def topn_refit(spark, d):
    return ex.select_and_refit(_split(spark, d), FEATURES, LABEL, [3, 5, 8], SPECS["gb_default"], order=["day"])


@query("walk_forward")
def walk_forward(spark, d):
    folds = expanding_folds(_daily(spark, d), 4, "day")
    return ex.walk_forward(folds, FEATURES, LABEL, SPECS["gb_default"], 4, order=["day"])[1]


@query(
    "walk_forward_mean",
    f"""WITH {FOLDS_SQL}, means AS (SELECT fold, avg(value) AS y_pred FROM folds WHERE role = 'train' GROUP BY fold),
        predictions AS (SELECT fold, value AS y_true, y_pred FROM folds JOIN means USING (fold) WHERE role = 'test')
        SELECT * FROM {src.metrics_sql('fold')}""",
)
def walk_forward_mean(spark, d):
    folds = event_folds(spark, d).withColumnRenamed("role", "part")
    return rounded(regression_metrics(naive_mean(folds, "value", ["fold"]), ["fold"]), *ROUNDED)


@query("transfer")
def transfer(spark, d):
    """The importance ranking found on one label, used on another."""
    ranked = ex.fit_importance(_split(spark, d), FEATURES, LABEL, SPECS["gb_default"], ["day"])
    features = ranked.selectExpr("rank AS pos", "feature")
    other = _daily(spark, d).drop("max_cents", "max_cents_lag1")
    return ex.transfer(other, features, "top_order", SPECS["gb_default"], "day", [])[1]


@query("compare_targets")
def compare_targets(spark, d):
    specs = [SPECS[n] for n in ("ridge", "elasticnet", "gb_default")]
    return ex.compare_targets(_split(spark, d), [LABEL, "top_order"], ["n_orders", *PAST], specs, ["day"])[1]


@query("ablation")
def ablation(spark, d):
    sets = {"with_all": [], "without_orders": ["n_orders", "n_customers"]}
    return ex.ablation(_split(spark, d), FEATURES, LABEL, [SPECS["gb_default"], SPECS["ridge"]], sets, ["day"])
