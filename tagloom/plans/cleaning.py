"""Queries: sources, cleaning, column rules, shift labels, lab samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions.labels import proxy_time, shift_hour
from tagloom.functions.timecols import coerce_timestamp
from tagloom.operators import clean, columns, lab as lab_ops
from tagloom.operators.metrics import column_profile, fold_summary
from tagloom.operators.scans import window_feature_names
from tagloom.plans import inputs as src
from tagloom.plans.inputs import table
from tagloom.plans.registry import query, r6
from tagloom.sources.sinks import run_info
from tagloom.sources.tables import ordered_distinct, read_table


@query("read_orders", "SELECT * FROM orders")
def read_orders(spark, d):
    return read_table(spark, d, "parquet", name="orders")


@query(
    "ordered_dedupe",
    """SELECT min(event_id) AS pos, event_type || '_' || user_id AS feature FROM events
       WHERE event_type <> 'error' GROUP BY ALL""",
)
def ordered_dedupe(spark, d):
    name = F.when(F.col("event_type") != "error", F.concat_ws("_", "event_type", "user_id"))
    rows = table(spark, d, "events").select(name.alias("feature"), F.col("event_id").alias("pos"))
    return ordered_distinct(rows, "feature", "pos")


@query("run_info_json")
def run_info_json(spark, d):
    folds = src.metrics(spark, d, "fold")
    info = run_info(folds, {"experiment_name": "flat_and_retail", "n_splits": 7}, fold_summary(folds))
    return info.select(F.to_json(F.struct(*info.columns)).alias("run_info"))


@query("dedupe_rows", "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def dedupe_rows(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return clean.drop_duplicates(rows)


@query(
    "drop_all_null",
    """SELECT * FROM (SELECT CASE WHEN value >= 5 THEN value END AS v, CASE WHEN event_type <> 'error' THEN user_id END AS u
       FROM events) WHERE v IS NOT NULL OR u IS NOT NULL""",
)
def drop_all_null(spark, d):
    rows = table(spark, d, "events").selectExpr(
        "CASE WHEN value >= 5 THEN value END AS v", "CASE WHEN event_type <> 'error' THEN user_id END AS u"
    )
    return clean.drop_all_null(rows)


@query(
    "drop_null_keys",
    """SELECT event_id, ts, value AS target FROM events WHERE event_type <> 'error' AND value >= 5""",
)
def drop_null_keys(spark, d):
    rows = table(spark, d, "events").selectExpr(
        "event_id",
        "CASE WHEN event_type <> 'error' THEN ts END AS ts",
        "CASE WHEN value >= 5 THEN value END AS target",
    )
    return clean.drop_null_keys(rows, ["ts", "target"])


@query(
    "coerce_timestamp",
    """SELECT o_orderkey, try_cast(CASE WHEN o_orderstatus = 'F' THEN 'n/a' ELSE CAST(o_orderdate AS VARCHAR) END
       AS TIMESTAMP) AS moment FROM orders""",
)
def coerce_timestamp_query(spark, d):
    text = F.when(F.col("o_orderstatus") == "F", "n/a").otherwise(F.col("o_orderdate").cast("string"))
    return coerce_timestamp(table(spark, d, "orders").select("o_orderkey", text.alias("moment")), "moment")


@query(
    "select_numeric",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem""",
)
def select_numeric(spark, d):
    return columns.select_numeric(table(spark, d, "lineitem"))


@query("exclude_columns", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def exclude_columns(spark, d):
    return columns.exclude_columns(
        table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "no_such_column"]
    )


@query(
    "select_prefix",
    "SELECT l_quantity AS k1_quantity, l_discount AS k1_discount, l_returnflag AS k1_note FROM lineitem",
)
def select_prefix(spark, d):
    return columns.select_prefix(src.wide(spark, d), "k1_")


@query("feature_rules", "SELECT l_extendedprice AS w60__mean__price, l_tax AS w60__last__tax FROM lineitem")
def feature_rules(spark, d):
    return columns.select_features(
        src.wide(spark, d), ["w60__mean__", "w60__last__"], ["lab_date"], ["target"]
    )


@query(
    "prefix_plus_candidates",
    """SELECT l_quantity AS k1_quantity, l_discount AS k1_discount, l_returnflag AS k1_note, l_tax AS tax_share,
       l_discount AS price_cut FROM lineitem""",
)
def prefix_plus_candidates(spark, d):
    names = ["price_cut", "no_such_column", "tax_share"]
    return columns.select_prefix_plus(src.wide(spark, d), "k1_", names)


@query(
    "null_non_finite",
    "SELECT event_id, CASE WHEN value BETWEEN 1 AND 200 THEN value END AS value FROM events",
)
def null_non_finite(spark, d):
    rows = table(spark, d, "events").selectExpr(
        "event_id",
        "CASE WHEN value > 300 THEN double('-inf') WHEN value > 200 THEN double('inf')"
        " WHEN value < 1 THEN double('nan') ELSE value END AS value",
    )
    return clean.null_non_finite(rows)


@query(
    "common_columns",
    """SELECT l_orderkey AS key, l_extendedprice AS price FROM lineitem
       UNION ALL SELECT o_orderkey, o_totalprice FROM orders""",
)
def common_columns(spark, d):
    a = table(spark, d, "lineitem").selectExpr("l_orderkey AS key", "l_tax AS tax", "l_extendedprice AS price")
    b = table(spark, d, "orders").selectExpr("o_totalprice AS price", "o_orderstatus AS status", "o_orderkey AS key")
    left, right = columns.common_columns(a, b)
    return left.unionByName(right)


def _requested(spark, d):
    events = table(spark, d, "events")
    names = F.explode(
        F.array(*[F.concat(F.lit(f"w60__{s}__"), F.col("event_type")) for s in ("mean", "median")])
    )
    return ordered_distinct(events.select(names.alias("feature"), F.col("event_id").alias("pos")), "feature", "pos")


def _reconciled(spark, d):
    names = window_feature_names(src.TAGS, ["w60"])
    return columns.reconcile_features(_requested(spark, d), names)


@query(
    "features_found",
    """SELECT 'w60__mean__' || event_type AS feature, min(event_id) AS pos FROM events
       WHERE event_type <> 'purchase' GROUP BY event_type""",
)
def features_found(spark, d):
    return _reconciled(spark, d)[0]


@query(
    "features_missing",
    """SELECT f AS feature, min(event_id) AS pos FROM (
         SELECT event_id, 'w60__median__' || event_type AS f FROM events
         UNION ALL SELECT event_id, 'w60__mean__purchase' FROM events WHERE event_type = 'purchase') GROUP BY f""",
)
def features_missing(spark, d):
    return _reconciled(spark, d)[1]


@query("shift_hour", f"WITH {src.SHIFT_LABEL_SQL} SELECT event_id, shift, shift_hour FROM hours")
def shift_hour_query(spark, d):
    rows = src.shift_labels(spark, d)
    return rows.select("event_id", "shift", shift_hour(F.col("shift")).alias("shift_hour"))


@query(
    "proxy_time",
    f"""WITH {src.SHIFT_LABEL_SQL}
        SELECT event_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) + to_hours(shift_hour) AS proxy_time FROM hours""",
)
def proxy_time_query(spark, d):
    rows = src.shift_labels(spark, d)
    return rows.select("event_id", proxy_time(F.col("ts"), F.col("shift")).alias("proxy_time"))


@query(
    "logbook_times",
    f"WITH {src.LAB_SQL} SELECT o_orderkey, book_date, time_range, timestamp_start, timestamp_end, timestamp_mid FROM lab",
)
def logbook_times(spark, d):
    return src.lab(spark, d).select(
        "o_orderkey", "book_date", "time_range", "timestamp_start", "timestamp_end", "timestamp_mid"
    )


@query("shift_block", f"WITH {src.LAB_SQL} SELECT o_orderkey, block FROM lab")
def shift_block(spark, d):
    return src.lab(spark, d).select("o_orderkey", "block")


@query(
    "lab_event_id",
    f"WITH {src.LAB_SQL} SELECT o_orderkey, 'reading__' || strftime(timestamp_mid, '%Y%m%dT%H%M') AS event_id FROM lab",
)
def lab_event_id(spark, d):
    return src.lab(spark, d).select("o_orderkey", "event_id")


@query(
    "parse_readings",
    f"""WITH {src.LAB_SQL} SELECT o_orderkey, g1_raw, v1 AS g1_raw_value, v2 AS g2_raw_value, v3 AS g3_raw_value,
        manual_text_flags FROM lab""",
)
def parse_readings(spark, d):
    return src.lab(spark, d).select(
        "o_orderkey", "g1_raw", *[f"{c}_value" for c in src.RAW], "manual_text_flags"
    )


@query(
    "row_mean_valid",
    f"WITH {src.LAB_SQL} SELECT o_orderkey, valid_groups_count, round(value_mean + 1e-9, 6) AS value_mean FROM lab_flagged",
)
def row_mean_valid(spark, d):
    return src.lab(spark, d).select("o_orderkey", "valid_groups_count", r6("value_mean").alias("value_mean"))


@query("quality_flag", f"WITH {src.LAB_SQL} SELECT o_orderkey, quality_flag FROM lab_flagged")
def quality_flag(spark, d):
    return src.lab(spark, d).select("o_orderkey", "quality_flag")


COUNTS_SQL = """count(*) AS rows, count(*) FILTER (WHERE quality_flag = 'OK_3GROUPS') AS ok_3groups,
  count(*) FILTER (WHERE quality_flag = 'PARTIAL_1GROUP') AS partial_1group,
  count(*) FILTER (WHERE quality_flag = 'PARTIAL_WITH_TEXT_FLAGS') AS partial_with_text_flags"""


@query(
    "quality_by_day",
    f"WITH {src.LAB_SQL} SELECT CAST(timestamp_mid AS DATE) AS date, {COUNTS_SQL} FROM lab_flagged GROUP BY 1",
)
def quality_by_day(spark, d):
    return lab_ops.quality_by_day(src.lab(spark, d))


PARTS = [
    ("early", "1995-01-01", "1996-12-31"),
    ("middle", "1997-01-01", "1998-12-31"),
    ("late", "1999-01-01", "2001-12-31"),
]


@query(
    "quality_by_part",
    f"""WITH {src.LAB_SQL}, parts(part, date_from, date_to) AS (VALUES
          ('early', DATE '1995-01-01', DATE '1996-12-31'), ('middle', DATE '1997-01-01', DATE '1998-12-31'),
          ('late', DATE '1999-01-01', DATE '2001-12-31'))
        SELECT part, date_from, date_to, {COUNTS_SQL}, min(timestamp_mid) AS min_timestamp, max(timestamp_mid) AS max_timestamp
        FROM lab_flagged JOIN parts ON CAST(timestamp_mid AS DATE) BETWEEN date_from AND date_to GROUP BY ALL""",
)
def quality_by_part(spark, d):
    return lab_ops.quality_by_part(src.lab(spark, d), PARTS)


@query(
    "distinct_per_group",
    "SELECT l_suppkey, count(DISTINCT l_partkey) AS unique_parts FROM lineitem GROUP BY l_suppkey",
)
def distinct_per_group(spark, d):
    return lab_ops.distinct_per_group(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", "unique_parts")


@query(
    "list_per_day",
    f"""WITH {src.LAB_SQL} SELECT book_date, string_agg(time_range, '; ' ORDER BY time_range) AS time_ranges
        FROM (SELECT DISTINCT book_date, time_range FROM lab) GROUP BY book_date""",
)
def list_per_day(spark, d):
    return lab_ops.list_per_day(src.lab(spark, d), "book_date", "time_range", "time_ranges")


@query(
    "shift_features",
    f"""WITH {src.SENSOR_SQL}, {src.SHIFT_SQL} SELECT book_date, block, tag, round(mean + 1e-9, 6) AS mean,
        round(std + 1e-9, 6) AS std, round(min + 1e-9, 6) AS min, round(max + 1e-9, 6) AS max FROM shifts""",
)
def shift_features(spark, d):
    rows = lab_ops.shift_features(src.sensor(spark, d))
    return rows.select("book_date", "block", "tag", *[r6(s).alias(s) for s in ("mean", "std", "min", "max")])


@query(
    "merge_shift",
    f"""WITH {src.SENSOR_SQL}, {src.SHIFT_SQL},
        lab AS (SELECT anchor_id, CAST(ts + INTERVAL 4 HOUR AS DATE) AS book_date,
          CASE WHEN hour(ts) >= 20 OR hour(ts) < 8 THEN 'night_20_08' ELSE 'day_08_20' END AS block FROM anchors)
        SELECT anchor_id, book_date, block,
          {", ".join(f"round(max(mean) FILTER (WHERE tag = '{t}') + 1e-9, 6) AS k1_{t}_mean" for t in src.TAGS)}
        FROM lab LEFT JOIN shifts USING (book_date, block) GROUP BY anchor_id, book_date, block""",
)
def merge_shift(spark, d):
    shifts = lab_ops.pivot_shift_features(
        lab_ops.shift_features(src.sensor(spark, d)), src.TAGS, ["mean"], prefix="k1"
    )
    merged = lab_ops.merge_shift(src.shift_anchors(spark, d), shifts)
    means = [f"k1_{t}_mean" for t in src.TAGS]
    return merged.select("anchor_id", "book_date", "block", *[r6(m).alias(m) for m in means])


@query(
    "column_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, '{t}' AS column_type, count(*) - count({c}) AS null_count,
            CAST(count(*) - count({c}) AS DOUBLE) / count(*) AS null_share,
            CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM orders"""
        for c, t in [
            ("o_orderkey", "bigint"),
            ("o_custkey", "bigint"),
            ("o_orderstatus", "string"),
            ("o_totalprice", "double"),
            ("o_orderdate", "timestamp_ntz"),
            ("o_orderpriority", "string"),
        ]
    ),
)
def column_profile_query(spark, d):
    return column_profile(table(spark, d, "orders"))
