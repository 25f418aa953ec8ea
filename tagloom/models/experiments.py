"""Experiment loops: grids, selection, walk-forward, transfer, targets, ablation.

A loop runs over configurations, folds or targets, never over rows. Every fit is a
distributed Spark ML job on rows cached once; fits of one loop run a few at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, functions as F

from tagloom.models.fit import assemble, fit_model, importance, params_json, predict
from tagloom.models.slices import SLICE, cross_products, fold_predictions, slices_of, solve
from tagloom.models.specs import SPECS, Spec
from tagloom.operators.clean import null_non_finite, require_min_rows
from tagloom.operators.columns import exclude_columns, feature_names, reconcile_features, validate_numeric
from tagloom.operators.impute import fit_medians, impute_median
from tagloom.operators.metrics import comparison_table, regression_metrics, union_all
from tagloom.operators.order import best_by, time_split
from tagloom.sources.staging import stage

PARALLEL_FITS = 4
LINEAR_MODELS = ("ridge", "elasticnet", "naive_mean")
# The fewest rows a transfer and a walk-forward run are allowed to start from.
TRANSFER_ROWS, WALK_FORWARD_ROWS = 10, 20


def _each(spark, work: Callable, items: Sequence, parallel: int) -> list:
    if parallel <= 1 or len(items) <= 1:
        return [work(i) for i in items]
    with ThreadPool(min(parallel, len(items))) as pool:
        return pool.map(inheritable_thread_target(spark)(work), items)


@contextmanager
def _cached(df: DataFrame):
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def _fixed(df: DataFrame) -> DataFrame:
    """A result with one row per configuration, computed now so its inputs can be released."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def prepare(
    df: DataFrame, features: Sequence[str], label: str, order: Sequence[str] = ()
) -> DataFrame:
    """Split rows to model rows: non-finite to null, training medians, then 0, then vectors."""
    numeric, _ = validate_numeric(df, list(features), "strict")
    finite = null_non_finite(df.where(F.col(label).isNotNull()), numeric)
    filled = impute_median(finite, fit_medians(finite, numeric), fallback=0.0)
    return assemble(filled, numeric, label, order)


def _score(predictions: list[tuple[Spec, DataFrame]]) -> DataFrame:
    """One metric row per configuration from one aggregate over all their predictions."""
    tagged = [p.withColumn("run", F.lit(s.name)) for s, p in predictions]
    metrics = regression_metrics(union_all(tagged), ["run"])
    rows = [(s.name, s.model, params_json(s), i) for i, (s, _) in enumerate(predictions)]
    known = metrics.sparkSession.createDataFrame(rows, "run string, model string, params string, pos int")
    return known.join(metrics, "run").select("run", "model", "params", "pos", "n", "mae", "rmse", "r2")


def run_grid(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    specs: Sequence[Spec],
    order: Sequence[str] = (),
    parallel: int = PARALLEL_FITS,
    fitted: dict | None = None,
) -> DataFrame:
    """Fit every configuration on the train part and score it on the test part.

    Columns: run, model, params (JSON), pos (grid position), n, mae, rmse, r2. Pass a dict as
    ``fitted`` to get the models by name.
    """
    with _cached(prepare(df, features, label, order)) as data:
        train, test = data.where("part = 'train'"), data.where("part = 'test'")
        models = _each(df.sparkSession, lambda s: fit_model(train, s, order), list(specs), parallel)
        if fitted is not None:
            fitted.update({s.name: m for s, m in zip(specs, models)})
        return _fixed(_score([(s, predict(m, test)) for s, m in zip(specs, models)]))


def fit_predict(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    spec: Spec,
    keep: Sequence[str] = (),
    order: Sequence[str] = (),
) -> DataFrame:
    """Test predictions of one configuration."""
    data = stage(prepare(df, features, label, order))  # read by the fit and, later, by the prediction
    model = fit_model(data.where("part = 'train'"), spec, order)
    return predict(model, data.where("part = 'test'"), keep)


def fit_importance(
    df: DataFrame, features: Sequence[str], label: str, spec: Spec, order: Sequence[str] = ()
) -> DataFrame:
    with _cached(prepare(df, features, label, order)) as data:
        model = fit_model(data.where("part = 'train'"), spec, order)
    return importance(df.sparkSession, model, features)


def select_and_refit(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    ns: Sequence[int],
    spec: Spec = SPECS["rf_v6_plain"],
    baseline: DataFrame | None = None,
    order: Sequence[str] = (),
    parallel: int = PARALLEL_FITS,
) -> DataFrame:
    """Rank features on the train part, refit on the best N for every N, and compare.

    The first row is the full set. Changes are against ``baseline`` (one metric row), by default
    the full set itself.
    """
    spark = df.sparkSession
    with _cached(prepare(df, features, label, order)) as data:
        vectors = data.drop("features", "label")
        full = fit_model(data.where("part = 'train'"), spec, order)
        ranked = [r.feature for r in importance(spark, full, features).orderBy("rank").collect()]

        def refit(n: int):
            chosen = assemble(vectors, ranked[:n], label, order)
            model = fit_model(chosen.where("part = 'train'"), spec, order)
            return predict(model, chosen.where("part = 'test'"))

        tried = [("base_full", len(ranked), predict(full, data.where("part = 'test'")))]
        sizes = [min(n, len(ranked)) for n in ns]
        refits = _each(spark, refit, sizes, parallel)
        tried += [(f"top_{n}", k, p) for n, k, p in zip(ns, sizes, refits)]
        scored = regression_metrics(
            union_all([p.withColumn("variant", F.lit(v)) for v, _, p in tried]), ["variant"]
        )
        counts = spark.createDataFrame(
            [(v, k, params_json(spec)) for v, k, _ in tried],
            "variant string, n_features int, params string",
        )
        metrics = _fixed(counts.join(scored, "variant"))
    base = metrics.where("variant = 'base_full'")
    variants = metrics.where("variant <> 'base_full'")
    return comparison_table(base, variants, base if baseline is None else baseline)


def walk_forward(
    folds: DataFrame,
    features: Sequence[str],
    label: str,
    spec: Spec,
    n_splits: int,
    reselect: int | None = None,
    order: Sequence[str] = (),
    keep: Sequence[str] = (),
    parallel: int = PARALLEL_FITS,
) -> tuple[DataFrame, DataFrame]:
    """Refit imputation and model on the past of every fold; returns (predictions, metrics).

    ``folds`` comes from ``expanding_folds``. With ``reselect=n`` each fold also picks its own ``n`` best
    features from its own past; without it the given features are used in every fold, which
    leaks if they were picked on rows that later folds test on. Linear models and the mean of all folds come
    from one pass over the rows (``slices``). For trees the rows are stored once, by slice, and a fold reads the
    slices it needs. Fewer than ``WALK_FORWARD_ROWS`` rows are an error.
    """
    spark, rows = folds.sparkSession, slices_of(folds, n_splits)
    if reselect is None and spec.model in LINEAR_MODELS:
        predictions, sizes = _linear_folds(rows, features, label, spec, n_splits, keep)
    else:
        rows = stage(rows, [SLICE])
        require_min_rows(rows, WALK_FORWARD_ROWS)

        def one(k: int):
            part = F.when(F.col(SLICE) == k, "test").otherwise("train")
            mine = rows.where(F.col(SLICE) <= k).withColumns({"fold": F.lit(k), "part": part})
            data = stage(prepare(mine, features, label, order))  # read by the fits and, later, by the prediction
            train = data.where("part = 'train'")
            train_size = train.count()
            model = fit_model(train, spec, order)
            test = data.where("part = 'test'")
            if reselect is not None:
                ranked = importance(spark, model, features).orderBy("rank").limit(reselect)
                chosen = [r.feature for r in ranked.collect()]
                again = assemble(data.drop("features", "label"), chosen, label, order)
                model = fit_model(again.where("part = 'train'"), spec, order)
                test = again.where("part = 'test'")
            return k, train_size, predict(model, test, ["fold", *keep])

        done = _each(spark, one, list(range(1, n_splits + 1)), parallel)
        predictions = union_all([p for _, _, p in done])
        sizes = [(k, n) for k, n, _ in done]
    metrics = _fixed(
        spark.createDataFrame(sizes, "fold int, train_size long")
        .join(regression_metrics(predictions, ["fold"]), "fold")
        .withColumnRenamed("n", "test_size")
        .withColumn("reselected", F.lit(reselect is not None))
    )
    return predictions, metrics


def _linear_folds(rows: DataFrame, features: Sequence[str], label: str, spec: Spec, n_splits: int, keep: Sequence[str]):
    """Predictions and (fold, training rows) of a model that follows from cross products."""
    numeric, _ = validate_numeric(rows, list(features), "strict")
    products = cross_products(rows, numeric, label, n_splits)
    if products.rows.sum() < WALK_FORWARD_ROWS:
        require_min_rows(rows, WALK_FORWARD_ROWS)
    gaps = [f for f, n in zip(numeric, products.missing(n_splits)) if n]
    fitted, medians, sizes = [], [], []
    for k in range(1, n_splits + 1):
        middle = dict.fromkeys(numeric, 0.0)
        if gaps:
            known = rows.where((F.col(SLICE) < k) & F.col(label).isNotNull())
            middle |= {f: m for f, m in fit_medians(known, gaps, where=None).first().asDict().items() if m is not None}
        medians.append(np.array([middle[f] for f in numeric]))
        gram = products.filled(k, medians[-1])
        fitted.append(solve(gram, spec))
        sizes.append((k, round(gram[-2, -2])))
    return fold_predictions(rows, numeric, label, fitted, medians, products.shift, keep), sizes


def transfer(
    df: DataFrame,
    feature_list: DataFrame,
    label: str,
    spec: Spec,
    time_col: str,
    id_cols: Sequence[str],
    test_size: float = 0.2,
    keep: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Use a frozen feature list on another table; returns (test predictions, metric row).

    Features the table lacks are left out and counted; the test count is rounded. Fewer than
    ``TRANSFER_ROWS`` rows with a label are an error.
    """
    require_min_rows(df.where(F.col(label).isNotNull()), TRANSFER_ROWS)
    found, _ = reconcile_features(feature_list, df)
    names = feature_names(found)
    requested = feature_list.count()
    if not names:
        raise ValueError("the table has none of the requested features")
    rows = time_split(df, time_col, test_size, "half_even", list(id_cols))
    predictions = fit_predict(rows, names, label, spec, keep, id_cols)
    metrics = regression_metrics(predictions).withColumns(
        {
            "run": F.lit(spec.name),
            "n_requested_features": F.lit(requested).cast("long"),
            "n_found_features": F.lit(len(names)).cast("long"),
            "n_missing_features": F.lit(requested - len(names)).cast("long"),
        }
    )
    return predictions, metrics


def compare_targets(
    df: DataFrame,
    targets: Sequence[str],
    features: Sequence[str],
    specs: Sequence[Spec],
    order: Sequence[str] = (),
    metric: str = "mae",
) -> tuple[DataFrame, DataFrame]:
    """Every configuration on every target; returns (all metrics, best row per target)."""
    grids = [
        run_grid(df, features, t, specs, order).withColumn("target", F.lit(t)) for t in targets
    ]
    metrics = union_all(grids)
    return metrics, best_by(metrics, ["target"], metric, ["pos"])


def ablation(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    specs: Sequence[Spec],
    exclude_sets: dict[str, Sequence[str]],
    order: Sequence[str] = (),
) -> DataFrame:
    """The same grid with and without groups of features, one ``variant`` per group."""
    runs = []
    for variant, excluded in exclude_sets.items():
        left = [f for f in features if f not in set(excluded)]
        rows = exclude_columns(df, list(excluded))
        runs.append(
            run_grid(rows, left, label, specs, order).withColumns(
                {"variant": F.lit(variant), "n_features": F.lit(len(left))}
            )
        )
    return union_all(runs)
