"""Queries: window features before anchors, as-of lookups, interval counts."""

from __future__ import annotations

from tagloom.operators import scans
from tagloom.plans import inputs as src
from tagloom.plans.registry import query, rounded


def _features_sql(name: str, lo: int, hi: int) -> str:
    return f"""
features AS (SELECT anchor_id, '{name}' AS "window", tag, count(*) AS n, round(avg(value) + 1e-9, 6) AS mean,
  min(value) AS min, max(value) AS max, round(stddev_samp(value) + 1e-9, 6) AS std,
  arg_max(value, (s.ts, row_id)) AS last,
  round(arg_max(value, (s.ts, row_id)) - arg_min(value, (s.ts, row_id)) + 1e-9, 6) AS delta
  FROM anchors a JOIN sensor s ON s.ts > a.ts - INTERVAL {lo} MINUTE AND s.ts <= a.ts - INTERVAL {hi} MINUTE
  GROUP BY anchor_id, tag)"""


def _features(spark, d, window):
    rows = scans.window_features(src.anchors(spark, d), src.sensor(spark, d), [window])
    return rounded(rows, "mean", "std", "delta")


@query("window_features", f"WITH {src.SENSOR_SQL}, {_features_sql('w60', 60, 0)} SELECT * FROM features")
def window_features(spark, d):
    return _features(spark, d, ("w60", 60, 0))


@query("window_features_gap", f"WITH {src.SENSOR_SQL}, {_features_sql('w120_30', 120, 30)} SELECT * FROM features")
def window_features_gap(spark, d):
    return _features(spark, d, ("w120_30", 120, 30))


@query(
    "window_features_wide",
    f"""WITH {src.SENSOR_SQL}, {_features_sql('w60', 60, 0)},
        counted AS (SELECT anchor_id, count(DISTINCT s.ts) AS w60__rows FROM anchors a
          LEFT JOIN sensor s ON s.ts > a.ts - INTERVAL 60 MINUTE AND s.ts <= a.ts GROUP BY anchor_id)
        SELECT anchor_id, any_value(w60__rows) AS w60__rows,
        {", ".join(f"max({s}) FILTER (WHERE tag = '{t}') AS w60__{s}__{t}" for s in scans.STATS for t in src.TAGS)}
        FROM counted LEFT JOIN features USING (anchor_id) GROUP BY anchor_id""",
)
def window_features_wide(spark, d):
    wide = scans.pivot_window_features(_features(spark, d, ("w60", 60, 0)), src.TAGS, ["w60"])
    rows = scans.window_counts(
        src.anchors(spark, d), src.sensor(spark, d), ("w60", 60, 0), distinct_times=True, name="w60__rows"
    )
    return rows.join(wide, "anchor_id", "left")


@query(
    "range_join_count",
    f"""WITH {src.SENSOR_SQL} SELECT anchor_id, count(s.row_id) AS n FROM anchors a
        LEFT JOIN sensor s ON s.ts > a.ts - INTERVAL 60 MINUTE AND s.ts <= a.ts GROUP BY anchor_id""",
)
def range_join_count(spark, d):
    return scans.window_counts(src.anchors(spark, d), src.sensor(spark, d), ("w60", 60, 0), name="n")


@query(
    "asof_last",
    f"""WITH {src.SENSOR_SQL}, asked AS (SELECT anchor_id, ts, tag FROM anchors, (SELECT DISTINCT tag FROM sensor)),
        hits AS (SELECT anchor_id, a.tag, s.value, epoch_us(a.ts) - epoch_us(s.ts) AS age
          FROM asked a ASOF LEFT JOIN sensor s ON a.tag = s.tag AND a.ts >= s.ts)
        SELECT anchor_id, tag, CASE WHEN age <= 3600000000 THEN value END AS value,
          CASE WHEN age <= 3600000000 THEN age END AS age_micros FROM hits""",
)
def asof_last(spark, d):
    return scans.asof_join(src.anchors(spark, d), src.sensor(spark, d), src.TAGS, 60)
