"""Exact medians of many columns by sketches and brackets, without turning columns into rows.

A pass is one aggregate over all columns. The first one sketches every column; the sketch proposes two values
that have the middle ranks between them. The next pass counts the rows below, at and between these values; when
few enough lie between, they are sorted in the aggregate and the middle one is read off, else they are sketched
again. A sketch's error only decides how far a bracket narrows: counts say on which side of a value a rank
lies, so a rank outside its bracket is looked for where it is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

#: Size of a sketch, its usual error in ranks (a share of the rows), and the half width of a bracket.
SKETCH, ERROR, HALF = 1000, 0.003, 0.008
#: A sketch is asked for the values at equal steps of rank, as it only takes ranks that are known beforehand.
STEPS = 256
_SHARES = ",".join(str(k / STEPS) for k in range(STEPS + 1))
#: Values of all brackets that one pass may hold, and columns of one aggregate.
HELD_VALUES, COLUMNS_PER_PASS = 2_000_000, 400


@dataclass
class Search:
    """The values of a column between ``low`` and ``high`` (both outside; None is open) and the ranks sought there."""

    column: str
    ranks: tuple[int, ...]
    below: int = 0  # values up to and at ``low``
    size: int | None = None
    low: float | None = None
    high: float | None = None
    bracket: tuple[float, float] | None = None
    found: dict = field(default_factory=dict)


def medians(rows: DataFrame, cols: Sequence[str], value: Callable[[str], Column], held: int = HELD_VALUES) -> list[float | None]:
    """The exact median of ``value(c)`` over ``rows`` for every column; null where it has no values.

    ``rows`` are read once a pass: two passes while a thirtieth of the values fits ``held``, and one more for
    every thirtieth beyond. A pass holds at most about ``held`` values in all; the driver gets a few numbers a column.
    """
    out: dict[str, float | None] = {}
    for at in range(0, len(cols), COLUMNS_PER_PASS):
        some = list(cols[at : at + COLUMNS_PER_PASS])
        out |= _medians(rows.select(*[value(c).alias(c) for c in some]), some, max(1, held // len(some)))
    return [out[c] for c in cols]


def _medians(rows: DataFrame, cols: list[str], most: int) -> dict[str, float | None]:
    counts = rows.agg(*[F.expr(x) for k, c in enumerate(cols) for x in (f"count(`{c}`) AS n{k}", f"{_sketch(f'`{c}`')} AS s{k}")])
    ends = [f"{_at(f's{k}', f'{0.5 + side}D')} AS {end}{k}" for k in range(len(cols)) for end, side in (("a", -HALF), ("b", HALF))]
    row = counts.selectExpr(*[f"n{k}" for k in range(len(cols))], *ends).first()
    open_, found = [], {c: {} for c in cols}
    for k, c in enumerate(cols):
        n = row[f"n{k}"]
        if n:
            open_.append(Search(c, tuple(sorted({(n + 1) // 2, n // 2 + 1})), size=n, bracket=(row[f"a{k}"], row[f"b{k}"])))
    while open_:
        open_ = _narrow(rows, open_, most, found)
    return {c: sum(found[c].values()) / len(found[c]) if found[c] else None for c in cols}


# Expressions are SQL texts: a wide table has thousands of them, and a text is one call to the JVM.


def _sketch(value: str) -> str:
    return f"kll_sketch_agg_double({value}, {SKETCH})"


def _at(sketch: str, shares: str) -> str:
    """The sketch's values at one share of the ranks or at an array of them; null if it has none."""
    return f"CASE WHEN kll_sketch_get_n_double({sketch}) > 0 THEN kll_sketch_get_quantile_double({sketch}, {shares}) END"


def _ends(steps: str, first: str, last: str) -> tuple[str, str]:
    """Of a sketch's values at all steps, those a half width before one share of the ranks and behind another."""
    low, high = f"floor((({first}) - {HALF}D) * {STEPS})", f"ceil((({last}) + {HALF}D) * {STEPS})"
    return tuple(f"get({steps}, CAST(least(greatest({x}, 0), {STEPS}) AS INT))" for x in (low, high))


def _inside(value: str, low: float | None, high: float | None) -> str:
    bounds = [f"{value} IS NOT NULL"] + [f"{value} {sign} {x!r}D" for sign, x in ((">", low), ("<", high)) if x is not None]
    return " AND ".join(bounds)


def _narrow(rows: DataFrame, searches: list[Search], most: int, found: dict) -> list[Search]:
    """One pass for all open searches: their answers go to ``found``, what is still open is returned."""
    aggregates, results = [], []
    for k, s in enumerate(searches):
        value, inside = f"`{s.column}`", _inside(f"`{s.column}`", s.low, s.high)
        first, last = s.ranks[0], s.ranks[-1]
        if s.bracket is None:  # no sketch of just these values yet
            aggregates += [f"count_if({inside}) AS size{k}", f"{_sketch(f'CASE WHEN {inside} THEN {value} END')} AS sketch{k}"]
            shares = [f"({r - s.below} - 0.5D) / greatest(size{k}, 1)" for r in (first, last)]
            results += [f"{q} AS {end}{k}" for end, q in zip("ab", _ends(f"steps{k}", *shares))]
            continue
        a, b = s.bracket
        middle = _inside(value, a, b)
        aggregates += [f"count_if({inside} AND {value} < {a!r}D) AS before{k}", f"count_if({value} = {a!r}D) AS at_a{k}", f"count_if({middle}) AS size{k}"]
        aggregates += [f"count_if({value} = {b!r}D) AS at_b{k}" if a != b else f"0L AS at_b{k}"]
        start = f"({s.below} + before{k} + at_a{k})"
        results += [f"{c}{k}" for c in ("before", "at_a", "size", "at_b")]
        if s.size * (2 * HALF + 2 * ERROR + 2 / STEPS) <= most:
            aggregates.append(f"sort_array(collect_list(CASE WHEN {middle} THEN {value} END)) AS values{k}")
            results += [f"get(values{k}, CAST({r} - {start} - 1 AS INT)) AS pick{k}_{r}" for r in s.ranks]
        else:
            aggregates.append(f"{_sketch(f'CASE WHEN {middle} THEN {value} END')} AS sketch{k}")
            shares = [f"({r} - {start} - 0.5D) / greatest(size{k}, 1)" for r in (first, last)]
            results += [f"{q} AS {end}{k}" for end, q in zip("ab", _ends(f"steps{k}", *shares))]
    made = rows.agg(*[F.expr(x) for x in aggregates])
    sketches = [c for c in made.columns if c.startswith("sketch")]
    shares = f"CAST(split('{_SHARES}', ',') AS ARRAY<DOUBLE>)"
    made = made.selectExpr("*", *[f"{_at(c, shares)} AS {c.replace('sketch', 'steps')}" for c in sketches])
    row, left = made.selectExpr(*results).first().asDict(), []
    for k, s in enumerate(searches):
        if s.bracket is None:
            left.append(Search(s.column, s.ranks, s.below, s.size, s.low, s.high, (row[f"a{k}"], row[f"b{k}"])))
            continue
        a, b = s.bracket
        before, at_a, size, at_b = (row[f"{c}{k}"] for c in ("before", "at_a", "size", "at_b"))
        edge = [s.below + before]
        for n in (at_a, size, at_b):
            edge.append(edge[-1] + n)
        parts: dict[int, list[int]] = {}
        for r in s.ranks:
            parts.setdefault(sum(r > e for e in edge), []).append(r)
        for part, ranks in parts.items():
            if part in (1, 3):
                found[s.column] |= dict.fromkeys(ranks, a if part == 1 else b)
            elif part == 2 and f"pick{k}_{ranks[0]}" in row:
                found[s.column] |= {r: row[f"pick{k}_{r}"] for r in ranks}
            else:
                low, high, below, n = {0: (s.low, a, s.below, before), 2: (a, b, edge[1], size), 4: (b, s.high, edge[3], s.size - edge[3] + s.below)}[part]
                bracket = (row[f"a{k}"], row[f"b{k}"]) if part == 2 and tuple(ranks) == s.ranks else None
                left.append(Search(s.column, tuple(ranks), below, n, low, high, bracket))
    return left
