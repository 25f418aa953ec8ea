"""Process-data views of the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagloom.functions.labels import block_of_hour, book_date_of
from tagloom.operators.lab import lab_samples
from tagloom.operators.metrics import regression_metrics
from tagloom.plans.registry import rounded
from tagloom.sources.tables import read_table

TAGS = ["click", "error", "signup", "view"]
EVENT_ORDER = ["ts", "event_id"]
LINE_IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
RAW = ["g1_raw", "g2_raw", "g3_raw"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, "parquet", name=name)


def sensor(spark, d) -> DataFrame:
    events = table(spark, d, "events").where("event_type <> 'purchase'")
    return events.selectExpr("event_type AS tag", "ts", "event_id AS row_id", "value")


def anchors(spark, d) -> DataFrame:
    events = table(spark, d, "events").where("event_type = 'purchase'")
    return events.selectExpr("event_id AS anchor_id", "ts")


SENSOR_SQL = """
sensor AS (SELECT event_type AS tag, ts, event_id AS row_id, value FROM events WHERE event_type <> 'purchase'),
anchors AS (SELECT event_id AS anchor_id, ts FROM events WHERE event_type = 'purchase')"""


def lab_raw(spark, d) -> DataFrame:
    """One logbook row per order: lines 1-3 are the three readings, returned ones are text."""
    text = F.when(F.col("l_returnflag") == "R", "пер").otherwise(F.col("l_quantity").cast("string"))
    lines = table(spark, d, "lineitem").where(F.col("l_linenumber") <= len(RAW)).select("l_orderkey", "l_linenumber", text.alias("raw"))
    readings = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        *[F.max(F.when(F.col("l_linenumber") == i + 1, F.col("raw"))).alias(c) for i, c in enumerate(RAW)]
    )
    hour = F.col("o_orderkey") % 24
    clock = [F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":00")) for h in (hour, hour + 1)]
    books = table(spark, d, "orders").select(
        "o_orderkey",
        F.col("o_orderdate").cast("date").alias("book_date"),
        F.concat_ws("-", *clock).alias("time_range"),
    )
    return books.join(readings, "o_orderkey", "left")


def lab(spark, d) -> DataFrame:
    return lab_samples(lab_raw(spark, d), "reading", RAW)


LAB_SQL = """
lab_raw AS (
  SELECT o.o_orderkey, CAST(o_orderdate AS DATE) AS book_date, o.o_orderkey % 24 AS h,
    lpad(CAST(o.o_orderkey % 24 AS VARCHAR), 2, '0') || ':00-' ||
    lpad(CAST(o.o_orderkey % 24 + 1 AS VARCHAR), 2, '0') || ':00' AS time_range,
    g1_raw, g2_raw, g3_raw
  FROM orders o LEFT JOIN (
    SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN raw END) AS g1_raw,
      max(CASE WHEN l_linenumber = 2 THEN raw END) AS g2_raw,
      max(CASE WHEN l_linenumber = 3 THEN raw END) AS g3_raw
    FROM (SELECT l_orderkey, l_linenumber,
            CASE WHEN l_returnflag = 'R' THEN 'пер' ELSE CAST(l_quantity AS VARCHAR) END AS raw
          FROM lineitem) GROUP BY l_orderkey) r ON r.l_orderkey = o.o_orderkey),
lab_timed AS (
  SELECT *, CAST(CASE WHEN h >= 20 THEN book_date - 1 ELSE book_date END AS TIMESTAMP) + to_hours(h) AS timestamp_start,
    try_cast(g1_raw AS DOUBLE) AS v1, try_cast(g2_raw AS DOUBLE) AS v2, try_cast(g3_raw AS DOUBLE) AS v3
  FROM lab_raw),
lab AS (
  SELECT *, timestamp_start + INTERVAL 1 HOUR AS timestamp_end, timestamp_start + INTERVAL 30 MINUTE AS timestamp_mid,
    CASE WHEN h >= 20 OR h < 8 THEN 'night_20_08' ELSE 'day_08_20' END AS block,
    CAST((v1 IS NOT NULL) AS INTEGER) + CAST((v2 IS NOT NULL) AS INTEGER) + CAST((v3 IS NOT NULL) AS INTEGER) AS valid_groups_count,
    CASE WHEN g1_raw = 'пер' OR g2_raw = 'пер' OR g3_raw = 'пер' THEN 'пер' END AS manual_text_flags
  FROM lab_timed),
lab_flagged AS (
  SELECT *, (coalesce(v1, 0) + coalesce(v2, 0) + coalesce(v3, 0)) / nullif(valid_groups_count, 0) AS value_mean,
    CASE WHEN manual_text_flags IS NOT NULL THEN 'PARTIAL_WITH_TEXT_FLAGS' WHEN valid_groups_count = 3 THEN 'OK_3GROUPS'
      WHEN valid_groups_count = 1 THEN 'PARTIAL_1GROUP' END AS quality_flag
  FROM lab)"""


def shift_labels(spark, d) -> DataFrame:
    """Events with a shift label spelled in one of the ways logbooks use."""
    spellings = ["1", " 1.0 ", "2 смена", "II", "I", "x2", "12", "ночь", None]
    label = F.element_at(F.array(*[F.lit(s) for s in spellings]), (F.col("user_id") % 9 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", "ts", label.alias("shift"))


SHIFT_LABEL_SQL = """
labelled AS (SELECT event_id, ts, CASE user_id % 9 WHEN 0 THEN '1' WHEN 1 THEN ' 1.0 ' WHEN 2 THEN '2 смена' WHEN 3 THEN 'II'
  WHEN 4 THEN 'I' WHEN 5 THEN 'x2' WHEN 6 THEN '12' WHEN 7 THEN 'ночь' END AS shift FROM events),
hours AS (SELECT *, CASE WHEN shift IS NULL THEN 12 WHEN lower(trim(shift)) IN ('1', '1.0', 'i', '1 смена', 'смена 1') THEN 8
  WHEN lower(trim(shift)) IN ('2', '2.0', 'ii', '2 смена', 'смена 2') THEN 20
  WHEN shift LIKE '%1%' THEN 8 WHEN shift LIKE '%2%' THEN 20 ELSE 12 END AS shift_hour FROM labelled)"""


def wide(spark, d) -> DataFrame:
    """Line items under the column names of a merged shift table."""
    return table(spark, d, "lineitem").selectExpr(
        *LINE_IDS,
        "l_shipdate AS lab_date",
        "l_quantity AS k1_quantity",
        "l_discount AS k1_discount",
        "l_returnflag AS k1_note",
        "l_extendedprice AS w60__mean__price",
        "l_tax AS w60__last__tax",
        "l_tax AS w60__max__tax",
        "l_extendedprice AS w60__mean__Target_price",
        "l_tax AS tax_share",
        "l_discount AS price_cut",
        "l_extendedprice AS target_value",
    )


def daily(spark, d) -> DataFrame:
    """One row per order date: a regular series for lags and models. Sums are in whole cents."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return (
        table(spark, d, "orders")
        .groupBy(F.col("o_orderdate").alias("day"))
        .agg(
            F.count(F.lit(1)).cast("double").alias("n_orders"),
            F.sum(cents).cast("double").alias("total_cents"),
            F.max(cents).cast("double").alias("max_cents"),
            F.countDistinct("o_custkey").cast("double").alias("n_customers"),
        )
    )


DAILY_SQL = """
daily AS (SELECT o_orderdate AS day, CAST(count(*) AS DOUBLE) AS n_orders,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS total_cents,
  CAST(max(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS max_cents,
  CAST(count(DISTINCT o_custkey) AS DOUBLE) AS n_customers FROM orders GROUP BY o_orderdate)"""


def predictions(spark, d) -> DataFrame:
    """Two simple price models scored on every line item; target is the return flag."""
    lines = table(spark, d, "lineitem").select(
        *LINE_IDS, "l_shipdate", "l_returnflag", "l_quantity", "l_extendedprice", "l_tax"
    )
    parts = table(spark, d, "part").selectExpr("p_partkey AS l_partkey", "p_retailprice")
    return (
        lines.join(parts, "l_partkey")
        .selectExpr(
            *LINE_IDS,
            "l_shipdate",
            "l_returnflag AS target",
            "concat('fold_', year(l_shipdate)) AS fold",
            "l_extendedprice / 1000D AS y_true",
            "inline(array(struct('retail' AS model, l_quantity * p_retailprice / 450D AS y_pred),"
            " struct('flat' AS model, 52.5D + l_tax AS y_pred)))",
        )
    )


PREDICTIONS_SQL = """
lines AS (SELECT * FROM lineitem JOIN part ON p_partkey = l_partkey),
predictions AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag AS target,
    'fold_' || year(l_shipdate) AS fold, l_extendedprice / 1000 AS y_true, 'retail' AS model,
    l_quantity * p_retailprice / 450 AS y_pred FROM lines
  UNION ALL
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag,
    'fold_' || year(l_shipdate), l_extendedprice / 1000, 'flat', CAST(52.5 AS DOUBLE) + l_tax FROM lines)"""


def metrics_sql(group: str, source: str = "predictions") -> str:
    """A subquery with rounded metrics per group."""
    by = f"GROUP BY {group}" if group else ""
    head = f"{group}, " if group else ""
    return f"""(SELECT {head}n, round(mae + 1e-9, 6) AS mae, round(rmse + 1e-9, 6) AS rmse, round(r2 + 1e-9, 6) AS r2 FROM (
  SELECT {head}count(*) AS n, avg(abs(y_true - y_pred)) AS mae, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse,
    CASE WHEN var_pop(y_true) > 0 THEN 1 - avg((y_true - y_pred) * (y_true - y_pred)) / var_pop(y_true)
      WHEN avg(abs(y_true - y_pred)) = 0 THEN 1 ELSE 0 END AS r2 FROM {source} {by}))"""


def metrics(spark, d, *group: str) -> DataFrame:
    return rounded(regression_metrics(predictions(spark, d), group), "mae", "rmse", "r2")


def gappy(spark, d) -> DataFrame:
    """Line items with missing values, split at 1999; ``tax`` has no value before the split."""
    cut = F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz")
    return table(spark, d, "lineitem").select(
        *LINE_IDS,
        "l_shipdate",
        F.when(F.col("l_quantity") >= 5, F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_extendedprice") <= 90000, F.col("l_extendedprice")).alias("price"),
        F.when(cut, F.col("l_tax")).alias("tax"),
        F.when(cut, "test").otherwise("train").alias("part"),
    )


GAPPY_SQL = """
gappy AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
  CASE WHEN l_quantity >= 5 THEN l_quantity END AS quantity,
  CASE WHEN l_extendedprice <= 90000 THEN l_extendedprice END AS price,
  CASE WHEN l_shipdate >= TIMESTAMP '1999-01-01' THEN l_tax END AS tax,
  CASE WHEN l_shipdate >= TIMESTAMP '1999-01-01' THEN 'test' ELSE 'train' END AS part FROM lineitem)"""


def shift_anchors(spark, d) -> DataFrame:
    """Purchases as lab samples with the shift they fall into."""
    return anchors(spark, d).select(
        "anchor_id",
        book_date_of(F.col("ts")).alias("book_date"),
        block_of_hour(F.hour("ts")).alias("block"),
    )


SHIFT_SQL = """
hourly AS (SELECT tag, date_trunc('hour', ts) AS hour, avg(value) AS v FROM sensor GROUP BY ALL),
shifts AS (SELECT CAST(hour + INTERVAL 4 HOUR AS DATE) AS book_date,
  CASE WHEN hour(hour) >= 20 OR hour(hour) < 8 THEN 'night_20_08' ELSE 'day_08_20' END AS block, tag,
  avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max FROM hourly GROUP BY ALL)"""
