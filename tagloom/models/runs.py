"""A table of finished runs, so that a stopped grid goes on where it was.

A run is known by a hash of its rows, features, label and parameters. Its metric row is written when it ends, in a
folder of its own, so runs that end at the same time do not disturb each other and a half-written row is never seen.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tagloom.models.experiments import PARALLEL_FITS, _cached, _each, prepare
from tagloom.models.fit import fit_model, params_json, predict
from tagloom.models.specs import SEED, Spec
from tagloom.operators.metrics import regression_metrics

RUN_SCHEMA = "model string, params string, n long, mae double, rmse double, r2 double, seconds double, ended string, run_key string"


def table_hash(df: DataFrame, columns: Sequence[str]) -> str:
    """A hash of a table's rows in these columns, whatever their order; repeated rows count, nulls have their place.

    One aggregate with map-side combine: the row count and the sums of two row hashes.
    """
    # Hash functions skip nulls, so which columns are null is hashed too.
    cells = [c for name in columns for c in (F.col(f"`{name}`").isNull(), F.col(f"`{name}`"))]
    sums = [F.sum(F.xxhash64(F.lit(salt), *cells).cast("decimal(28,0)")) for salt in (0, 1)]
    found = df.agg(F.count(F.lit(1)), *sums).first()
    kinds = [df.schema[name].dataType.simpleString() for name in columns]
    return hashlib.sha256(json.dumps([list(columns), kinds, *map(str, found)]).encode()).hexdigest()


def run_keys(df: DataFrame, features: Sequence[str], label: str, specs: Sequence[Spec], order: Sequence[str] = ()) -> list[str]:
    """One key per configuration; its name is no part of it, so a renamed configuration is the same run."""
    used = list(dict.fromkeys(["part", label, *features, *order]))
    data = table_hash(df, used)
    parts = [[data, list(features), label, list(order), SEED, s.model, params_json(s)] for s in specs]
    return [hashlib.sha256(json.dumps(p).encode()).hexdigest() for p in parts]


def read_runs(spark, path: str) -> DataFrame:
    """All finished runs; an empty table where there are none yet."""
    base = path.rstrip("/")
    # The folder must exist to be read; an empty table under a key that no run has makes it.
    spark.createDataFrame([], RUN_SCHEMA).drop("run_key").write.mode("overwrite").parquet(f"{base}/run_key=none")
    return spark.read.schema(RUN_SCHEMA).parquet(base)


def run_grid_logged(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    specs: Sequence[Spec],
    path: str,
    order: Sequence[str] = (),
    parallel: int = PARALLEL_FITS,
) -> DataFrame:
    """``run_grid`` that writes every configuration's row to ``path`` when it ends and skips those found there.

    Columns: those of ``run_grid``, the ``seconds`` of the fit and its scoring, and ``reused`` for rows found in the
    table. If a fit fails its error is raised after the others have ended, and these are kept. Give ``order`` (unique
    ids) when there are seeded models, as their samples otherwise depend on the layout of the rows, which no key
    covers. One grid at a time may write the same configuration.
    """
    spark, keys = df.sparkSession, run_keys(df, features, label, specs, order)
    known = {r.run_key for r in read_runs(spark, path).where(F.col("run_key").isin(keys)).select("run_key").collect()}
    missing = {k: s for k, s in zip(keys, specs) if k not in known}

    if missing:
        with _cached(prepare(df, features, label, order)) as data:
            train, test = data.where("part = 'train'"), data.where("part = 'test'")

            def one(item: tuple[str, Spec]):
                (key, spec), start = item, time.monotonic()
                try:
                    found = regression_metrics(predict(fit_model(train, spec, order), test)).first()
                except Exception as error:  # raised below, when the other runs are stored
                    return error
                row = (spec.model, params_json(spec), found.n, found.mae, found.rmse, found.r2, time.monotonic() - start)
                ended = time.strftime("%Y-%m-%dT%H:%M:%S")
                stored = spark.createDataFrame([(*row, ended, key)], RUN_SCHEMA).drop("run_key").coalesce(1)
                stored.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run_key={key}")
                return None

            errors = [e for e in _each(spark, one, list(missing.items()), parallel) if e is not None]
        if errors:
            raise errors[0]
    asked = [(k, s.name, i, k in known) for i, (k, s) in enumerate(zip(keys, specs))]
    rows = spark.createDataFrame(asked, "run_key string, run string, pos int, reused boolean")
    done = read_runs(spark, path).where(F.col("run_key").isin(keys))
    return rows.join(done, "run_key").select("run", "model", "params", "pos", "n", "mae", "rmse", "r2", "seconds", "reused")
