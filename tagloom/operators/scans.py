"""Window features before anchor events, as-of lookups and interval joins.

A trailing window ``(t - lo, t - hi]`` is cut at the boundary of time blocks that are exactly as
long as the window. It then always consists of the end of one block and the beginning of the
next, and both are running aggregates, read off at the two edges of the window. No
anchor-reading pairs are formed: the work grows with readings plus anchors, not with their
product. When a counting pass finds a block too big for one task, blocks are scanned in chunks
whose carried-over totals are added afterwards, and readings that share a timestamp are merged
first, so the largest group is bounded by the clock's resolution, not by how hot a tag is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from tagloom.functions.timecols import MICROS_PER_HOUR, MICROS_PER_MINUTE, floor_div, order_key
from tagloom.operators.ranks import MAX_GROUP_ROWS, largest_group

STATS = ("mean", "min", "max", "std", "last", "delta")
CHUNKS_PER_WINDOW = 240
# Places a carrying window scans, and levels above the first. On the last one a place is 1,900 years of hours or
# 8 years of quarter minutes, so all times a timestamp can hold are at most some 1,300 places there.
CARRY_FAN, CARRY_LEVELS = 4096, 2
# Readings that salts of an interval join hold in a large bucket, however low its limit is. So many meet each copy of an anchor,
# which makes copies few beside the pairs. A merge join keeps up to 4,096 rows of a key as they are.
SALT_ROWS = 3000
MOMENTS = ("n", "mean", "m2", "lo", "hi", "first", "last")

Bounds = tuple[str, int, int]  # name, minutes before the anchor: from (exclusive), to (inclusive)


def _moments(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of the readings of every key; partial aggregates are merged by Spark."""
    return readings.groupBy(*keys).agg(
        F.expr("count(_v) AS n"),
        F.expr("avg(_v) AS mean"),
        F.expr("var_pop(_v) * count(_v) AS m2"),
        F.expr("min(_v) AS lo"),
        F.expr("max(_v) AS hi"),
        F.expr("min_by(_v, struct(_x, _id)) AS first"),
        F.expr("max_by(_v, struct(_x, _id)) AS last"),
    )


def _running(prefix: str, partition: list[str], order: str, frame: str, descending: bool) -> list[str]:
    """Running sums over a window, from which ``_settle`` makes moments.

    Sums are taken around the first value of the scan (``_cu_`` or ``_cd_``). Every window that the scan
    reads off holds that value, so readings outside a window cannot spoil its moments.
    ``first`` and ``last`` stay in time order when the scan runs backwards.
    """
    centre = f"_c{prefix}"
    over = f"OVER (PARTITION BY {', '.join(partition)} ORDER BY {order} {frame})"
    early, late = ("last", "first") if descending else ("first", "last")
    return [
        f"coalesce(sum(n) {over}, 0) AS {prefix}n",
        f"sum(n * (mean - {centre})) {over} AS {prefix}d",
        f"sum(m2 + n * (mean - {centre}) * (mean - {centre})) {over} AS {prefix}q",
        f"min(lo) {over} AS {prefix}lo",
        f"max(hi) {over} AS {prefix}hi",
        f"{early}(first, true) {over} AS {prefix}first",
        f"{late}(last, true) {over} AS {prefix}last",
    ]


def _centres(partition: list[str], order: str) -> list[str]:
    """The first and the last value of a partition; asked for in the order of the next window, to share its sort."""
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    over = f"OVER (PARTITION BY {', '.join(partition)} ORDER BY {order} {frame})"
    return [f"first(mean, true) {over} AS _cu_", f"last(mean, true) {over} AS _cd_"]


def _settle(prefix: str) -> list[str]:
    """Moments of the side an edge asks for, from both running scans."""
    picked = {m: f"if(side = 'late', u_{m}, d_{m})" for m in ("n", "d", "q", "lo", "hi", "first", "last")}
    n, d, q = picked["n"], picked["d"], picked["q"]
    return [
        f"{n} AS {prefix}n",
        f"if(side = 'late', _cu_, _cd_) + {d} / nullif({n}, 0) AS {prefix}mean",
        f"if({n} > 0, greatest({q} - {d} * {d} / {n}, 0D), null) AS {prefix}m2",
        *[f"{picked[m]} AS {prefix}{m}" for m in ("lo", "hi", "first", "last")],
    ]


def _combine(a: str, b: str) -> dict[str, str]:
    """Moments of two disjoint row sets, all of ``a`` earlier than all of ``b``."""
    both = f"{a}n > 0 AND {b}n > 0"
    gap = f"({b}mean - {a}mean)"
    n = f"(coalesce({a}n, 0) + coalesce({b}n, 0))"
    return {
        "n": n,
        "mean": f"if({both}, {a}mean + {gap} * {b}n / {n}, coalesce({a}mean, {b}mean))",
        "m2": f"if({both}, {a}m2 + {b}m2 + {gap} * {gap} * {a}n * {b}n / {n}, coalesce({a}m2, {b}m2))",
        "lo": f"least({a}lo, {b}lo)",
        "hi": f"greatest({a}hi, {b}hi)",
        "first": f"coalesce({a}first, {b}first)",
        "last": f"coalesce({b}last, {a}last)",
    }


def _window_moments(
    readings: DataFrame, ends: DataFrame, keys: list[str], width: int, max_group_rows: int
) -> DataFrame:
    """Moments of the readings in ``(end - width, end]`` for every key with any.

    ``readings``: keys, ``_x`` (time), ``_id``, ``_v``. ``ends``: distinct window ends as ``_x`` plus those of the
    keys that anchors share with readings. Returns keys, ``_x`` (the end) and the moments.
    """
    shared = [k for k in keys if k in ends.columns]
    named = [f"`{k}`" for k in keys]
    place = {"_block": floor_div(F.col("_x"), width)}
    rows = readings.withColumns(place)
    # Two edges per window: its end ('late') and its beginning ('early', one block before).
    edges = ends.selectExpr(
        *[f"`{k}`" for k in shared],
        f"inline(array(struct('late' AS side, _x), struct('early' AS side, _x - {width} AS _x)))",
    ).withColumns(place)
    active = rows.select(*keys, "_block").distinct()
    asked = edges.join(active, [*shared, "_block"])

    hottest = max(
        largest_group(rows, [*keys, "_block"]), largest_group(edges, [*shared, "_block"])
    )
    if hottest <= max_group_rows:
        sides = _scan_blocks(rows, asked, named)
    else:
        sides = _scan_chunks(rows, asked, keys, named, max(1, width // CHUNKS_PER_WINDOW))
    merged = (
        sides.selectExpr(*named, f"if(side = 'late', _x, _x + {width}) AS _x", "side", *MOMENTS)
        .groupBy(*keys, "_x")
        .agg(
            *[F.expr(f"max({m}) FILTER (WHERE side = 'early') AS e_{m}") for m in MOMENTS],
            *[F.expr(f"max({m}) FILTER (WHERE side = 'late') AS l_{m}") for m in MOMENTS],
        )
    )
    total = [f"{c} AS {m}" for m, c in _combine("e_", "l_").items()]
    return merged.selectExpr(*named, "_x", *total).where("n > 0")


RUNNING = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
OTHER_CHUNKS = "RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _scan_blocks(rows: DataFrame, asked: DataFrame, named: list[str]) -> DataFrame:
    """Moments from the block's edge to every asked edge, one window group per block."""
    block = [*named, "_block"]
    single = rows.selectExpr(
        *block,
        "_x",
        "_id",
        "1L AS n",
        "_v AS mean",
        "0D AS m2",
        *[f"_v AS {m}" for m in ("lo", "hi", "first", "last")],
    )
    # At one timestamp a late edge follows the reading, an early edge skips it.
    up = _running("u_", block, "_x, side NULLS FIRST, _id", RUNNING, False)
    down = _running("d_", block, "_x DESC, side NULLS LAST, _id DESC", RUNNING, True)
    return (
        single.withColumn("side", F.lit(None).cast("string"))
        .unionByName(asked, allowMissingColumns=True)
        .selectExpr("*", *_centres(block, "_x, side NULLS FIRST, _id"))
        .selectExpr(*named, "_x", "side", "_cu_", "_cd_", *up, *down)
        .where("side IS NOT NULL")
        .selectExpr(*named, "_x", "side", *_settle(""))
    )


def _scan_chunks(
    rows: DataFrame, asked: DataFrame, keys: list[str], named: list[str], chunk: int
) -> DataFrame:
    """The same for blocks too hot for one task: chunks of a block, then carried totals."""
    block, cell = [*named, "_block"], [*named, "_block", "_chunk"]
    place = {"_chunk": floor_div(F.col("_x"), chunk)}
    rows, asked = rows.withColumns(place), asked.withColumns(place)
    by_time = _moments(rows, [*keys, "_block", "_chunk", "_x"])
    by_chunk = _moments(rows, [*keys, "_block", "_chunk"])
    up = _running("u_", cell, "_x, side NULLS FIRST", RUNNING, False)
    down = _running("d_", cell, "_x DESC, side NULLS LAST", RUNNING, True)
    scanned = (
        by_time.unionByName(asked, allowMissingColumns=True)
        .selectExpr("*", *_centres(cell, "_x, side NULLS FIRST"))
        .selectExpr(*cell, "_x", "side", "_cu_", "_cd_", *up, *down)
        .where("side IS NOT NULL")
        .selectExpr(*cell, "_x", "side", *_settle("in_"))
    )
    # The other chunks of the block: everything before (late) or after (early) the edge's chunk.
    before = _running("u_", block, "_chunk", OTHER_CHUNKS, False)
    after = _running("d_", block, "_chunk DESC", OTHER_CHUNKS, True)
    carried = (
        by_chunk.unionByName(
            asked.select(*keys, "_block", "_chunk", "side").distinct(), allowMissingColumns=True
        )
        .selectExpr("*", *_centres(block, "_chunk"))
        .selectExpr(*cell, "side", "_cu_", "_cd_", *before, *after)
        .where("side IS NOT NULL")
        .selectExpr(*cell, "side", *_settle("out_"))
    )
    early, late = _combine("in_", "out_"), _combine("out_", "in_")
    return scanned.join(carried, [*keys, "_block", "_chunk", "side"]).selectExpr(
        *named, "_x", "side", *[f"if(side = 'late', {late[m]}, {early[m]}) AS {m}" for m in MOMENTS]
    )


def _readings(
    sensor: DataFrame, keys: Sequence[str], time: str, row_id: str, value: str | None
) -> DataFrame:
    v = F.lit(0.0) if value is None else F.col(value).cast("double")
    rows = sensor.select(
        *keys, order_key(sensor, time).alias("_x"), F.col(row_id).alias("_id"), v.alias("_v")
    )
    finite = ~F.isnan("_v") & (F.abs("_v") != F.lit(float("inf")))
    return rows.where(F.col("_x").isNotNull() & F.col("_v").isNotNull() & finite)


def _anchor_ends(
    anchors: DataFrame, anchor_id: str, anchor_time: str, entity: list[str], to_minutes: int
) -> DataFrame:
    end = order_key(anchors, anchor_time) - F.lit(to_minutes * MICROS_PER_MINUTE)
    return anchors.select(F.col(anchor_id), *entity, end.alias("_x"))


def window_features(
    anchors: DataFrame,
    sensor: DataFrame,
    windows: Sequence[Bounds] = (("w60", 60, 0),),
    anchor_id: str = "anchor_id",
    anchor_time: str = "ts",
    tag: str = "tag",
    time: str = "ts",
    row_id: str = "row_id",
    value: str = "value",
    entity: Sequence[str] = (),
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Statistics per anchor, window and tag over the readings of a trailing window.

    A window ``(name, lo, hi)`` covers ``(t - lo min, t - hi min]``. Columns: anchor id, ``window``, tag,
    ``n`` and the six statistics; ``std`` is the sample deviation, ``last`` the value at the greatest
    (time, row id), ``delta`` last minus first. Anchors and tags without readings have no row.
    """
    entity = list(entity)
    readings = _readings(sensor, [*entity, tag], time, row_id, value)
    out = None
    for name, lo, hi in windows:
        ids = _anchor_ends(anchors, anchor_id, anchor_time, entity, hi)
        ends = ids.drop(anchor_id).distinct()
        width = (lo - hi) * MICROS_PER_MINUTE
        m = _window_moments(readings, ends, [*entity, tag], width, max_group_rows)
        rows = ids.join(m, [*entity, "_x"]).select(
            anchor_id,
            F.lit(name).alias("window"),
            tag,
            "n",
            "mean",
            F.col("lo").alias("min"),
            F.col("hi").alias("max"),
            F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("std"),
            "last",
            (F.col("last") - F.col("first")).alias("delta"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def window_counts(
    anchors: DataFrame,
    sensor: DataFrame,
    window: Bounds = ("w60", 60, 0),
    anchor_id: str = "anchor_id",
    anchor_time: str = "ts",
    time: str = "ts",
    row_id: str = "row_id",
    entity: Sequence[str] = (),
    distinct_times: bool = False,
    name: str = "rows",
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Readings (or distinct timestamps) in the window of every anchor, 0 included."""
    entity = list(entity)
    _, lo, hi = window
    readings = _readings(sensor, entity, time, row_id, None)
    if distinct_times:
        readings = readings.select(*entity, "_x", "_v").distinct().withColumn("_id", F.lit(0))
    ids = _anchor_ends(anchors, anchor_id, anchor_time, entity, hi)
    ends = ids.drop(anchor_id).distinct()
    m = _window_moments(readings, ends, entity, (lo - hi) * MICROS_PER_MINUTE, max_group_rows)
    found = ids.join(m.select(*entity, "_x", "n"), [*entity, "_x"], "left")
    return found.select(anchor_id, F.coalesce("n", F.lit(0)).cast("long").alias(name))


def window_feature_names(tags: Sequence[str], windows: Sequence[str], stats: Sequence[str] = STATS) -> list[str]:
    """The columns ``pivot_window_features`` gives besides the anchor id."""
    return [f"{w}__{s}__{t}" for w in windows for s in stats for t in tags]


def pivot_window_features(
    features: DataFrame,
    tags: Sequence[str],
    windows: Sequence[str],
    stats: Sequence[str] = STATS,
    anchor_id: str = "anchor_id",
    tag: str = "tag",
) -> DataFrame:
    """Wide form: one row per anchor, columns ``{window}__{stat}__{tag}``.

    The column list comes from the arguments, so no extra pass looks for distinct names.
    """
    cell = F.concat_ws("__", "window", tag)
    wide = (
        features.withColumn("_cell", cell)
        .groupBy(anchor_id)
        .pivot("_cell", [f"{w}__{t}" for w in windows for t in tags])
        .agg(F.max(F.struct(*stats)))
    )
    return wide.select(
        anchor_id,
        *[
            F.col(f"`{w}__{t}`.{s}").alias(f"{w}__{s}__{t}")
            for w in windows
            for s in stats
            for t in tags
        ],
    )


def unpivot_window_features(wide: DataFrame, anchor_id: str = "anchor_id") -> DataFrame:
    """Back to long form: anchor id, window, stat, tag, value (nulls left out). Tags may hold ``__``."""
    names = [c for c in wide.columns if len(p := c.split("__", 2)) == 3 and p[1] in STATS]
    long = wide.unpivot([anchor_id], names, "_name", "value").where(F.col("value").isNotNull())
    part = F.split("_name", "__", 3)
    return long.select(
        anchor_id,
        part.getItem(0).alias("window"),
        part.getItem(2).alias("tag"),
        part.getItem(1).alias("stat"),
        "value",
    )


def carried_hits(newest: DataFrame, asked: DataFrame, keys: list[str], place: str, levels: int = CARRY_LEVELS) -> DataFrame:
    """The ``hit`` of the last place of ``newest`` before every asked place: keys, place, hit.

    Places lie in blocks of ``CARRY_FAN``. A window scans one block; what a block has not, the newest hits of the blocks
    before it have, which are found in the same way one level up. So no window holds more places than a block has,
    however long a series is. Places of the last level are few, whatever the times.
    """
    block = f"{place}_block"
    newest = newest.withColumn(block, floor_div(F.col(place), CARRY_FAN))
    asked = asked.withColumns({block: floor_div(F.col(place), CARRY_FAN), "ask": F.lit(1)})
    group = [*keys, block] if levels else keys
    earlier = Window.partitionBy(*group).orderBy(place).rangeBetween(Window.unboundedPreceding, -1)
    near = (
        newest.unionByName(asked, allowMissingColumns=True)
        .withColumn("near", F.last("hit", True).over(earlier))
        .where(F.col("ask") == 1)
        .select(*keys, block, place, "near")
    )
    if not levels:
        return near.select(*keys, place, F.col("near").alias("hit"))
    blocks = newest.groupBy(*keys, block).agg(F.max("hit").alias("hit"))
    # Only blocks that some place finds nothing in ask further.
    open_blocks = near.where(F.col("near").isNull()).select(*keys, block).distinct()
    far = carried_hits(blocks, open_blocks, keys, block, levels - 1)
    return near.join(far, [*keys, block], "left").select(*keys, place, F.coalesce("near", "hit").alias("hit"))


def asof_join(
    anchors: DataFrame,
    sensor: DataFrame,
    tags: Sequence[str],
    tolerance_minutes: int | None = None,
    anchor_id: str = "anchor_id",
    anchor_time: str = "ts",
    tag: str = "tag",
    time: str = "ts",
    row_id: str = "row_id",
    value: str = "value",
    entity: Sequence[str] = (),
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Most recent reading at or before every anchor, one row per anchor and tag.

    ``value`` and ``age_micros`` are null where there is none (within the tolerance) and for anchors
    without a time. The tags are given, as the columns of a table would be. Only the newest reading of a chunk is carried on,
    block by block; chunks are an hour, or 15 seconds when a counting pass finds an hour too big for one task.
    """
    entity = list(entity)
    keys = [*entity, tag]
    chunk = MICROS_PER_HOUR
    plain = _readings(sensor, keys, time, row_id, value).where(F.col(tag).isin(*tags))
    readings = plain.withColumn("_chunk", floor_div(F.col("_x"), chunk))
    if largest_group(readings, [*keys, "_chunk"]) > max_group_rows:
        chunk = MICROS_PER_HOUR // CHUNKS_PER_WINDOW
        readings = plain.withColumn("_chunk", floor_div(F.col("_x"), chunk))
    ids = _anchor_ends(anchors, anchor_id, anchor_time, entity, 0)
    asked = (
        ids.drop(anchor_id)
        .distinct()
        .withColumn(tag, F.explode(F.array(*[F.lit(t) for t in tags])))
        .withColumns({"_chunk": floor_div(F.col("_x"), chunk), "ask": F.lit(1)})
    )
    newest = F.max(F.struct("_x", "_id", "_v")).alias("hit")
    by_time = readings.groupBy(*keys, "_chunk", "_x").agg(newest)
    by_chunk = readings.groupBy(*keys, "_chunk").agg(newest)
    so_far = (Window.unboundedPreceding, Window.currentRow)
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_x", F.col("ask").asc_nulls_first())
    scanned = (
        by_time.unionByName(asked, allowMissingColumns=True)
        .withColumn("_in", F.last("hit", True).over(inside.rowsBetween(*so_far)))
        .where(F.col("ask") == 1)
        .select(*keys, "_chunk", "_x", "_in")
    )
    carried = carried_hits(by_chunk, asked.select(*keys, "_chunk").distinct(), keys, "_chunk").withColumnRenamed("hit", "_out")
    hit = F.coalesce("_in", "_out")
    if tolerance_minutes is not None:
        hit = F.when(hit["_x"] >= F.col("_x") - F.lit(tolerance_minutes * MICROS_PER_MINUTE), hit)
    found = scanned.join(carried, [*keys, "_chunk"]).select(*keys, "_x", hit.alias("hit"))
    every = ids.withColumn(tag, F.explode(F.array(*[F.lit(t) for t in tags])))
    return every.join(found, [*keys, "_x"], "left").select(
        anchor_id,
        tag,
        F.col("hit._v").alias("value"),
        (F.col("_x") - F.col("hit._x")).alias("age_micros"),
    )


def range_join(
    anchors: DataFrame,
    sensor: DataFrame,
    from_minutes: int,
    to_minutes: int = 0,
    anchor_time: str = "ts",
    time: str = "ts",
    entity: Sequence[str] = (),
    max_bucket_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Interval join: every anchor with every reading in ``(t - from, t - to]``.

    The result is the matches themselves; to aggregate them use ``window_features`` or
    ``window_counts``, which never form them. Readings are keyed by time bucket, anchors by the
    (two or three) buckets they reach, so only neighbours meet. The readings of a bucket with more than
    ``max_bucket_rows`` are dealt out over as many salts as it needs, and only the anchors that reach
    this bucket are copied for them. A limit below ``SALT_ROWS`` gives no more salts than two or one per ``SALT_ROWS``
    readings, as copies for every few readings would be nearly as many as the pairs. Both sides are shuffled: the planner's
    sizes do not count the copies, so it would broadcast them. Reading columns keep their names, anchor columns get ``anchor_``.
    """
    entity = list(entity)
    width = (from_minutes - to_minutes) * MICROS_PER_MINUTE
    rows = sensor.withColumn("_x", order_key(sensor, time))
    rows = rows.withColumn("_bucket", floor_div(F.col("_x"), width)).where("_bucket IS NOT NULL")
    buckets = [*entity, "_bucket"]
    hot = rows.groupBy(*buckets).count().where(F.col("count") > max_bucket_rows)
    enough = F.greatest(F.ceil(F.col("count") / SALT_ROWS), F.lit(2).cast("long"))
    hot = hot.select(*buckets, F.least(F.ceil(F.col("count") / max_bucket_rows), enough).alias("_salts"))
    salts = F.coalesce("_salts", F.lit(1).cast("long"))
    # A row's salt follows from its own values, so a task that runs again deals it to the same place.
    place = F.xxhash64(*[F.col(c) for c in sensor.columns if not isinstance(sensor.schema[c].dataType, (T.MapType, T.VariantType))])
    rows = rows.withColumn("_row", place).join(hot, buckets, "left")
    rows = rows.withColumn("_salt", F.pmod(F.col("_row"), salts)).drop("_salts", "_row")
    end = order_key(anchors, anchor_time) - F.lit(to_minutes * MICROS_PER_MINUTE)
    points = anchors.select(
        *entity,
        *[F.col(c).alias(f"anchor_{c}") for c in anchors.columns if c not in entity],
        end.alias("_end"),
    )
    reach = F.sequence(floor_div(F.col("_end") - F.lit(width), width), floor_div(F.col("_end"), width))
    points = points.withColumn("_bucket", F.explode(reach)).join(hot, buckets, "left")
    points = points.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("_salts")
    near = (F.col("_x") > F.col("_end") - F.lit(width)) & (F.col("_x") <= F.col("_end"))
    return (
        points.hint("merge").join(rows, [*entity, "_bucket", "_salt"])
        .where(near)
        .drop("_bucket", "_salt", "_end", "_x")
    )
