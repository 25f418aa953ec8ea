"""Exact ranks without sorting wide rows and without one-task windows.

``order_statistics`` finds the value at given ranks by counting: each pass counts rows per
bin of the interval that still holds the rank, with map-side combine, and keeps the bin
the rank falls into. Only bin counts reach the driver. ``boundary_keys`` does the same for
composite keys such as (time, id). ``row_index`` numbers all rows of a table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tagloom.functions.timecols import key_literal, order_key
from tagloom.sources.staging import stage

MAX_GROUP_ROWS = 1_000_000  # a window group up to this size is left to one task
FINISH_ROWS = 50_000  # candidates up to this many are sorted directly
MAX_BIN_ROWS = 200_000  # bin counts one pass may bring to the driver


@dataclass
class _Search:
    series: str
    rank: int
    low: float
    high: float
    rows: int
    below: int = 0
    value: float | None = None


def order_statistics(
    values: DataFrame,
    ranks: Callable[[int], list[int]],
    finish_rows: int = FINISH_ROWS,
) -> dict[str, list[tuple[float, int]]]:
    """Values at exact ranks of every series.

    ``values`` has columns ``series`` (string) and ``v`` (number, no nulls). ``ranks`` maps the
    row count of a series to 1-based ranks. The result maps a series to one
    ``(value, number of smaller rows)`` pair per rank.
    """
    spark = values.sparkSession
    numeric = values.schema["v"].dataType
    seen = (
        values.groupBy("series")
        .agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .collect()
    )
    searches = [
        _Search(r.series, rank, r.lo, r.hi, r.n) for r in seen for rank in ranks(r.n)
    ]
    schema = T.StructType(
        [
            T.StructField("req", T.IntegerType()),
            T.StructField("series", T.StringType()),
            T.StructField("lo", numeric),
            T.StructField("hi", numeric),
            T.StructField("rank", T.LongType()),
        ]
    )

    def candidates(chosen: list[tuple[int, _Search]]) -> DataFrame:
        rows = [(i, s.series, s.low, s.high, s.rank - s.below) for i, s in chosen]
        wanted = F.broadcast(spark.createDataFrame(rows, schema))  # one row per rank asked for
        return values.join(wanted, "series").where(F.col("v").between(F.col("lo"), F.col("hi")))

    while True:
        for s in searches:
            if s.value is None and s.low == s.high:
                s.value = s.low
        todo = [(i, s) for i, s in enumerate(searches) if s.value is None]
        if not todo:
            break
        small = [(i, s) for i, s in todo if s.rows <= finish_rows]
        if small:
            ordered = F.array_sort(F.collect_list("v"))
            found = (
                candidates(small)
                .groupBy("req")
                .agg(ordered.alias("a"), F.first("rank").alias("rank"))
                .select("req", F.element_at("a", F.col("rank").cast("int")).alias("v"), "a")
                .select("req", "v", (F.array_position("a", F.col("v")) - 1).alias("under"))
                .collect()
            )
            for r in found:
                searches[r.req].value = r.v
                searches[r.req].below += r.under
        large = [(i, s) for i, s in todo if s.rows > finish_rows]
        if large:
            bins = max(2, min(4096, MAX_BIN_ROWS // len(large)))
            v, lo, hi = (F.col(c).cast("double") for c in ("v", "lo", "hi"))
            # Where the whole interval overflows a double, halves of it do not.
            whole, half = hi - lo, hi / 2 - lo / 2
            place = F.when(whole < F.lit(float("inf")), (v - lo) / whole).otherwise((v / 2 - lo / 2) / half)
            spread = F.when(hi > lo, F.floor(place * bins).cast("double")).otherwise(
                (F.col("v") - F.col("lo")).cast("double")
            )
            counted = (
                candidates(large)
                .groupBy("req", spread.alias("bin"))
                .agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
                .collect()
            )
            by_search: dict[int, list] = {}
            for r in counted:
                by_search.setdefault(r.req, []).append(r)
            for i, s in large:
                for r in sorted(by_search[i], key=lambda r: r.lo):
                    if s.rank <= s.below + r.n:
                        if (s.low, s.high, s.rows) == (r.lo, r.hi, r.n):
                            raise RuntimeError(f"values of {s.series} between {r.lo} and {r.hi} cannot be told apart")
                        s.low, s.high, s.rows = r.lo, r.hi, r.n
                        break
                    s.below += r.n
    result: dict[str, list[tuple[float, int]]] = {}
    for s in searches:
        result.setdefault(s.series, []).append((s.value, s.below))
    return result


def boundary_keys(
    df: DataFrame,
    keys: list[str],
    ranks: Callable[[int], list[int]],
    finish_rows: int = FINISH_ROWS,
) -> list[tuple]:
    """Composite keys at exact ranks of ``df`` ordered by ``keys`` (rows with null keys excluded).

    ``ranks`` maps the row count to 1-based ranks, so counting is part of the first pass. Goes key
    by key: the rows that share the found values of the earlier keys are ranked by the next
    one, so a time shared by a third of the table costs one more counting pass.
    """
    spark = df.sparkSession
    if any(isinstance(df.schema[k].dataType, T.StringType) for k in keys):
        return _with_text_keys(df, keys, ranks, finish_rows)
    numbers = [order_key(df, k).alias(f"k{i}") for i, k in enumerate(keys)]
    remaining: list[int] = []

    def note_ranks(n: int) -> list[int]:
        remaining[:] = ranks(n)
        return list(remaining)

    values = df.select(F.lit("all").alias("series"), numbers[0].alias("v"))
    hits = order_statistics(values.where("v IS NOT NULL"), note_ranks, finish_rows).get("all")
    if hits is None:
        note_ranks(0)
        raise ValueError("no rows to rank")
    found: list[list] = [[] for _ in hits]
    for level in range(len(keys)):
        if level > 0:
            # A filter on the stored column lets the scan skip what cannot hold the first key.
            first = {v[0]: key_literal(df.schema[keys[0]].dataType, v[0]) for v in found}
            near = df.where(F.col(keys[0]).isin(*first.values())).select(*numbers)
            schema = T.StructType(
                [T.StructField("series", T.StringType())]
                + [T.StructField(f"k{i}", near.schema[f"k{i}"].dataType) for i in range(level)]
            )
            rows = [(str(i), *vals) for i, vals in enumerate(found)]
            fixed = F.broadcast(spark.createDataFrame(rows, schema))  # one row per rank
            ties = near.join(fixed, [f"k{i}" for i in range(level)]).select(
                "series", F.col(f"k{level}").alias("v")
            )
            hits = _one_rank_per_series(ties, remaining, finish_rows)
        for i, (value, below) in enumerate(hits):
            found[i].append(value)
            remaining[i] -= below
    return [tuple(vals) for vals in found]


TEXT_BYTES = 7  # bytes of a text that fit one long


def _with_text_keys(df: DataFrame, keys: list[str], ranks, finish_rows: int) -> list[tuple]:
    """Boundary keys where some keys are texts.

    A text becomes numbers of seven bytes each that sort as its bytes do, and its length. The number
    of pieces is that of the longest text, found in one narrow pass.
    """
    texts = [k for k in keys if isinstance(df.schema[k].dataType, T.StringType)]
    sizes = df.agg(*[F.max(F.octet_length(k)).alias(f"n{i}") for i, k in enumerate(texts)]).first()
    pieces = {k: max(1, -(-(sizes[i] or 0) // TEXT_BYTES)) for i, k in enumerate(texts)}
    columns, names = [], []
    for i, k in enumerate(keys):
        if k not in pieces:
            columns.append(F.col(k).alias(f"p{i}"))
            names.append([f"p{i}"])
            continue
        raw = F.encode(F.col(k), "utf-8")
        own = []
        for j in range(pieces[k]):
            part = F.rpad(F.hex(F.substring(raw, TEXT_BYTES * j + 1, TEXT_BYTES)), 2 * TEXT_BYTES, "0")
            own.append(f"p{i}_{j}")
            columns.append(F.conv(part, 16, 10).cast("long").alias(own[-1]))
        own.append(f"p{i}_n")
        columns.append(F.octet_length(k).cast("long").alias(own[-1]))
        names.append(own)
    flat = boundary_keys(df.select(*columns), [n for own in names for n in own], ranks, finish_rows)
    found = []
    for values in flat:
        left, key = list(values), []
        for k, own in zip(keys, names):
            mine, left = left[: len(own)], left[len(own) :]
            if k in pieces:
                raw = b"".join(int(v).to_bytes(TEXT_BYTES, "big") for v in mine[:-1])[: mine[-1]]
                key.append(raw.decode("utf-8"))
            else:
                key.append(mine[0])
        found.append(tuple(key))
    return found


def _one_rank_per_series(values: DataFrame, ranks: list[int], finish_rows: int):
    """Series "0", "1", ... are asked for one rank each, ``ranks[i]``."""
    distinct = sorted(set(ranks))
    found = order_statistics(values, lambda n: [min(r, n) for r in distinct], finish_rows)
    return [found[str(i)][distinct.index(r)] for i, r in enumerate(ranks)]


def at_or_before(df: DataFrame, keys: list[str], boundary: tuple) -> Column:
    """True for rows whose composite key is not greater than ``boundary``."""
    last = len(keys) - 1

    def step(i: int) -> Column:
        c, b = F.col(keys[i]), key_literal(df.schema[keys[i]].dataType, boundary[i])
        return c <= b if i == last else (c < b) | ((c == b) & step(i + 1))

    return step(0)


def _sorted_rows(df: DataFrame, order: list[str | Column]) -> tuple[DataFrame, Column, Column]:
    """Staged rows with ``_pos``, and from it the sort partition and the place in it.

    A range-partitioned sort splits hot values by the later keys, so no task gets more than
    its share.
    """
    positioned = stage(df.orderBy(*order).withColumn("_pos", F.monotonically_increasing_id()))
    # monotonically_increasing_id: partition number in the upper 31 bits, row in the lower 33.
    return positioned, F.shiftright("_pos", 33), F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1))


def row_index(df: DataFrame, order: list[str | Column], name: str = "rn") -> DataFrame:
    """Number all rows 1..n in ``order``.

    The sorted rows are staged once, then each sort partition only needs the row count of the
    partitions before it.
    """
    positioned, part, inside = _sorted_rows(df, order)
    counts = sorted(positioned.groupBy(part.alias("p")).count().collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    spark = df.sparkSession
    offset_table = spark.createDataFrame(offsets, "_part long, _offset long")
    return (
        positioned.withColumn("_part", part)
        .join(F.broadcast(offset_table), "_part")  # one row per sort partition
        .withColumn(name, F.col("_offset") + inside + 1)
        .drop("_part", "_offset", "_pos")
    )


def largest_group(df: DataFrame, partition: list[str]) -> int:
    """Rows of the biggest group; one narrow counting pass."""
    if not partition:
        return df.count()
    return df.groupBy(*partition).count().agg(F.max("count")).first()[0] or 0


def group_index(
    df: DataFrame,
    partition: list[str],
    order: list[str | Column],
    name: str = "rn",
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Number the rows of every group 1..n.

    Above the limit all rows are sorted and staged. A group lies in one stretch of each sort partition
    it reaches, so its rows there only need the start of the stretch and the rows of the group in the
    partitions before. No step deals out rows by group alone.
    """
    if largest_group(df, partition) <= max_group_rows:
        w = Window.partitionBy(*partition).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w).cast("long"))
    if not partition:
        return row_index(df, order, name)
    positioned, part, inside = _sorted_rows(df, [*partition, *order])
    keys = [f"_k{i}" for i in range(len(partition))]
    stretches = positioned.groupBy(part.alias("_at"), *[F.col(p).alias(k) for p, k in zip(partition, keys)]).agg(
        F.count(F.lit(1)).alias("_n"), F.min(inside).alias("_start")
    )
    # One row per sort partition a group reaches.
    earlier = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long"))
    # Staged, so that the planner knows its size and shuffles the rows only when it is large.
    shifts = stage(stretches.withColumn("_shift", before - F.col("_start")).drop("_n", "_start"))
    same = reduce(
        lambda a, b: a & b, [F.col(p).eqNullSafe(F.col(k)) for p, k in zip(partition, keys)], F.col("_part") == F.col("_at")
    )
    return (
        positioned.withColumn("_part", part)
        .join(shifts, same)
        .withColumn(name, inside + F.col("_shift") + 1)
        .drop("_part", "_at", "_shift", "_pos", *keys)
    )


def over_series(
    df: DataFrame,
    partition: list[str],
    order: list[str],
    build: Callable,
    lookback: int = 0,
    lookahead: int = 0,
    max_group_rows: int = MAX_GROUP_ROWS,
    block_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add window columns that reach at most ``lookback`` rows back and ``lookahead`` on.

    ``build`` gets a window and returns ``{name: column}``. While every group fits one task the
    plain window is used. Otherwise rows are numbered over the whole table and cut into equal
    blocks; each block also gets copies of the few neighbouring rows its edges reach, so a
    group of any size is spread over many tasks and the result stays the same.
    """
    if largest_group(df, partition) <= max_group_rows:
        return df.withColumns(build(Window.partitionBy(*partition).orderBy(*order)))
    if max(lookback, lookahead) >= block_rows:
        raise ValueError("the window reaches beyond one block; raise block_rows")
    indexed = row_index(df, [*partition, *order], "_rn")
    place = F.pmod(F.col("_rn") - 1, F.lit(block_rows))
    own = ((F.col("_rn") - 1 - place) / block_rows).cast("long")
    homes = [own]
    if lookback:
        homes.append(F.when(place >= block_rows - lookback, own + 1))
    if lookahead:
        homes.append(F.when(place < lookahead, own - 1))
    copies = indexed.withColumn("_own", own).withColumn(
        "_block", F.explode(F.array_compact(F.array(*homes)))
    )
    w = Window.partitionBy("_block", *partition).orderBy("_rn")
    return (
        copies.withColumns(build(w))
        .where(F.col("_block") == F.col("_own"))
        .drop("_rn", "_own", "_block")
    )
