"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Every vector is projected on many fixed random directions. Two vectors collide in a projection when they lie within a
window centred on either of them. The windows and the number of collisions a pair needs follow from
the threshold alone, so that a link exactly at the threshold passes whatever other links the table
has: the difference of two unit vectors at that cosine has a known length, and its projections on
random directions follow the normal law (in few dimensions with shorter tails). Which pairs are counted is
decided by several groups of further projections: each group cuts its projections into intervals from random
starts, and vectors in the same interval of all of them share a cell. Pairs of a cell are counted, those
that were met in an earlier group excepted, along one sorted projection and
no further than its window reaches. The larger the table, the more projections a group has and the more groups there are.
Pairs that pass the count are verified with the exact cosine. Pairs never
leave a block: it returns each vector's number of links and the edges of a spanning forest.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagloom.llm.common import batch, map_arrow
from tagloom.llm.components import components
from tagloom.sources.staging import stage

COUNTED = 24
#: Half widths of the windows in spreads of a projected difference at the threshold. A counted window
#: holds 0.984 of them, the window of the sorted projection 0.9998.
COUNTED_SPREADS, SORTED_SPREADS = 2.4, 3.8
#: Shares of the links at the threshold that the count must pass and that must meet in a cell. Closer links do so more often.
RECALL, MET = 0.9999, 0.995
#: The most groups, each of which sends every vector once, and the most projections of one.
MOST_GROUPS, MOST_EACH = 128, 32
#: The pairs that are counted in the time it takes to send a vector to a further cell.
CROWD = 500
#: Vectors, and components of vectors, on one side of a block.
BLOCK, BLOCK_COMPONENTS = 16384, 1 << 23
#: Bins on either side of a value that its counted window touches.
STEPS = 40
#: Pairs counted at a time, few enough for the cache.
PAIRS = 250_000
#: The least half width of a window, for thresholds next to 1.
NARROW = 1e-3


@dataclass(frozen=True)
class Plan:
    """The counted directions and the sorted one (rows), their windows, the count to pass, and the groups.

    Group ``g`` has ``each`` directions, ``cuts[g * each : (g + 1) * each]``, cut every ``width`` from ``starts`` on.
    """

    directions: np.ndarray
    reach: float
    window: float
    least: int
    threshold: float
    groups: int
    each: int
    width: float
    cuts: np.ndarray
    starts: np.ndarray


def directions(n: int, dim: int) -> np.ndarray:
    rng, rows = np.random.default_rng(20240229), [np.zeros((0, dim))]
    while sum(map(len, rows)) < n:
        rows.append(np.linalg.qr(rng.normal(size=(dim, dim)))[0])
    return np.concatenate(rows)[:n]


def _units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by the greatest component first, which keeps very large and small ones from overflowing."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) + 0.0


def _vectors(batches):
    """(vec_id, key, raw, dim): components as they are, and a digest of the unit vector; null for vectors that link with nothing."""
    schema = pa.schema([("vec_id", pa.int64()), ("key", pa.binary()), ("raw", pa.binary()), ("dim", pa.int64())])
    for b in batches:
        column = b.column(1)
        kind = np.float32 if pa.types.is_float32(column.type.value_type) else np.float64
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)  # a null component is NaN here
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        first, out = np.cumsum(sizes) - sizes, [(None, None, None)] * len(sizes)
        for dim in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero(sizes == dim)
            x = flat[first[rows][:, None] + np.arange(dim)]
            good = np.isfinite(x).all(axis=1) & x.any(axis=1)
            x, rows = x[good], rows[good]
            for row, raw, unit in zip(rows.tolist(), x, _units(x.astype(np.float64)) if len(x) else x):
                out[row] = hashlib.blake2b(unit.tobytes(), digest_size=16).digest(), raw.tobytes(), dim
        yield batch(schema, vec_id=b.column(0), **{name: [o[k] for o in out] for k, name in enumerate(("key", "raw", "dim"))})


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors (rows) of single or double components."""
    rows = column.to_pylist()
    kind = np.float32 if rows and len(rows[0]) == 4 * dim else np.float64
    return _units(np.frombuffer(b"".join(rows), kind).astype(np.float64).reshape(-1, dim))


def _together(width: float, spread: float) -> float:
    """The chance that a random cut every ``width`` leaves two values together whose difference is normal."""
    if spread == 0:
        return 1.0
    a = width / spread
    return math.erf(a / math.sqrt(2)) - math.sqrt(2 / math.pi) / a * (1 - math.exp(-a * a / 2))


def met(differences: np.ndarray, groups: int, each: int, width: float) -> float:
    """The share of pairs that meet in a cell of some group, from their projected differences (a row a pair), over all starts."""
    alone = np.ones(len(differences))
    for g in range(groups):
        part = np.abs(differences[:, g * each : (g + 1) * each])
        alone *= 1 - np.clip(1 - part / width, 0, 1).prod(axis=1)
    return 1 - alone.mean()


def _grouped(n: int, dim: int, spread: float, threshold: float) -> tuple[int, int, float, np.ndarray]:
    """Groups, projections of each, width of their intervals, and directions: the cheapest by which links at the threshold meet.

    The cost of a vector is what its copies and the pairs with unrelated vectors take. The normal law orders the choices;
    the share that meets is then taken from differences of the exact length along the very directions.
    """
    choices = [(n / 2 + CROWD, 1, 0, 1.0)]
    for halves in range(4, 29):
        width = max(NARROW, halves / 2 * spread)
        near, far = _together(width, spread), _together(width, math.sqrt(2 / dim))
        for each in range(1, min(MOST_EACH, 4 * dim) + 1):  # in few dimensions more would say the same again
            alone = 1 - near**each
            groups = 1 if alone <= 1 - MET else math.ceil(math.log(1 - MET) / math.log(alone))
            for more in range(groups, min(MOST_GROUPS, groups + 2) + 1):
                choices.append((more * (CROWD + n * far**each / 2), more, each, width))
    rng, lines, projected = np.random.default_rng(7), np.zeros((0, dim)), np.zeros((2000, 0))
    apart = rng.normal(size=(2000, dim))
    apart *= math.sqrt(2 * (1 - threshold)) / np.linalg.norm(apart, axis=1)[:, None]
    for _, groups, each, width in sorted(choices):
        if groups * each > len(lines):
            lines = directions(COUNTED + 1 + groups * each, dim)[COUNTED + 1 :]
            projected = apart @ lines.T
        if met(projected, groups, each, width) >= MET:
            return groups, each, width, lines[: groups * each]
    raise AssertionError("one group without projections meets all pairs")


def calibrate(n: int, dim: int, threshold: float) -> Plan:
    """Windows, count and groups that links exactly at the threshold need; closer links need less."""
    spread = math.sqrt(2 * (1 - threshold) / dim)
    window, reach = max(NARROW, COUNTED_SPREADS * spread), max(NARROW, SORTED_SPREADS * spread)
    inside = math.erf(COUNTED_SPREADS / math.sqrt(2))
    least, passed = COUNTED, inside**COUNTED
    while passed < RECALL:
        least -= 1
        passed += math.comb(COUNTED, least) * inside**least * (1 - inside) ** (COUNTED - least)
    groups, each, width, cuts = _grouped(n, dim, spread, threshold)
    starts = np.random.default_rng(11).uniform(0, width, len(cuts))
    return Plan(directions(COUNTED + 1, dim), reach, window, least, threshold, groups, each, width, cuts, starts)


def _marked(plan: Plan, dim: int):
    """Adds the vector's cell in each group, as a hash. Cells of equal hashes are one cell."""
    schema = pa.schema([("vec_id", pa.int64()), ("raw", pa.binary()), ("weight", pa.int64()), ("marks", pa.list_(pa.int32()))])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                place = np.floor((_matrix(b.column(1), dim) @ plan.cuts.T + plan.starts) / plan.width).astype(np.int64)
                marks = [_name(place[:, g * plan.each : (g + 1) * plan.each]).astype(np.int32) for g in range(plan.groups)]
                yield batch(schema, vec_id=b.column(0), raw=b.column(1), weight=b.column(2), marks=list(np.stack(marks, axis=1)))

    return run


def _name(cells: np.ndarray) -> np.ndarray:
    out = np.zeros(len(cells), np.uint64)
    for k in range(cells.shape[1]):
        out = (out ^ cells[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node reachable from each of ``n`` nodes along the links (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


_FOUND = "vec_id long, n_links long, other long"


def _counted(plan: Plan, bins: np.ndarray, place: np.ndarray, home: np.ndarray, guest: np.ndarray | None):
    """Yields (i, j) of pairs of ``home`` and ``guest`` (or among ``home``, each once) that pass the count."""
    home = home[np.argsort(place[home], kind="stable")]
    guest, among = (home, True) if guest is None else (guest[np.argsort(place[guest], kind="stable")], False)
    of_home, of_guest = np.ascontiguousarray(bins[:, home]), bins[:, guest] + np.uint8(STEPS)
    step = max(1, PAIRS // len(home))
    for at in range(0, len(guest), step):
        g = guest[at : at + step]
        low = np.searchsorted(place[home], place[g[0]] - plan.reach)
        high = np.searchsorted(place[home], place[g[-1]] + plan.reach, side="right")
        low = max(low, at) if among else low
        if low >= high:
            continue
        count = np.zeros((len(g), high - low), np.uint8)
        apart, hit = np.empty_like(count), np.empty(count.shape, np.bool_)
        for k in range(COUNTED):
            np.subtract(of_guest[k, at : at + step, None], of_home[k, low:high], out=apart)
            np.less_equal(apart, np.uint8(2 * STEPS), out=hit)
            np.add(count, hit.view(np.uint8), out=count)
        i, j = np.divmod(np.flatnonzero(count >= plan.least), high - low)
        if among:
            later = j + low > i + at
            i, j = i[later], j[later]
        for k in range(0, len(i), 100_000):
            yield g[i[k : k + 100_000]], home[j[k : k + 100_000] + low]


def _block(plan: Plan, dim: int):
    """Links among the vectors of cells, or between two blocks (``h`` and ``k``) of a crowded cell.

    Rows (vec_id, links found, null) and, for components, (vec_id, 0, smaller connected vec_id). A pair that
    shares a cell of an earlier group (``met``) is left to that group. No list of all links is held.
    """
    schema = pa.schema([("vec_id", pa.int64()), ("n_links", pa.int64()), ("other", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, weight, group, mark, own, h, k = (
            np.asarray(table.column(c)) for c in ("vec_id", "weight", "g", "mark", "own", "h", "k")
        )
        before = table.column("met").combine_chunks()
        earlier, first = np.asarray(before.flatten()), np.concatenate([[0], np.cumsum(np.asarray(before.value_lengths()))])
        x = _matrix(table.column("raw").combine_chunks(), dim)
        projected = x @ plan.directions.T
        # Bins modulo 256: bins of values within the window differ by at most STEPS, and few others do.
        bins = np.floor(projected[:, :COUNTED].T * ((STEPS - 1) / plan.window)).astype(np.int64).astype(np.uint8)
        place = projected[:, COUNTED]
        # Nodes in the order of their ids, so that the smallest label is the smallest id.
        names, node = np.unique(ids, return_inverse=True)
        links, label, left, right = np.zeros(len(names)), np.arange(len(names)), [], []
        order = np.lexsort((mark, group))
        edges = np.flatnonzero((np.diff(mark[order]) != 0) | (np.diff(group[order]) != 0)) + 1
        for cell in np.split(order, edges):
            sides = (cell, None) if h[cell[0]] == k[cell[0]] else (cell[own[cell] == h[cell]], cell[own[cell] == k[cell]])
            if len(cell) < 2 or any(side is not None and not len(side) for side in sides):
                continue
            columns = np.arange(group[cell[0]])
            for a, b in _counted(plan, bins, place, *sides):
                linked = np.einsum("nd,nd->n", x[a], x[b]) >= plan.threshold
                a, b = a[linked], b[linked]
                new = ~(earlier[first[a][:, None] + columns] == earlier[first[b][:, None] + columns]).any(axis=1)
                a, b = a[new], b[new]
                links += np.bincount(node[a], weight[b], len(names)) + np.bincount(node[b], weight[a], len(names))
                a, b = label[node[a]], label[node[b]]
                left.append(a[a != b]), right.append(b[a != b])
                if sum(map(len, left)) > 500_000:
                    label, left, right = _forest(np.concatenate(left), np.concatenate(right), len(names))[label], [], []
        if left:
            label = _forest(np.concatenate(left), np.concatenate(right), len(names))[label]
        some, joined = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(names)))
        return pa.table(
            {
                "vec_id": pa.array(np.concatenate([names[some], names[joined]])),
                "n_links": pa.array(np.concatenate([links[some], np.zeros(len(joined))]).astype(np.int64)),
                "other": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(names[label[joined]], pa.int64())]),
            },
            schema=schema,
        )

    return run


def _links(classes: DataFrame, n: int, dim: int, threshold: float) -> DataFrame:
    """Rows of ``_block`` for all classes of one dimension."""
    plan, rows = calibrate(n, dim, threshold), max(512, min(BLOCK, BLOCK_COMPONENTS // dim)) if BLOCK >= 512 else BLOCK
    marked = stage(
        map_arrow(classes.select("vec_id", "raw", "weight"), lambda: _marked(plan, dim), "vec_id long, raw binary, weight long, marks array<int>")
    )
    cells = marked.select("vec_id", F.posexplode("marks").alias("g", "mark"))
    count = cells.groupBy("g", "mark").agg(F.count("*").alias("n")).where("n > 1")
    count = stage(count.withColumn("blocks", F.ceil(F.col("n") / rows).cast("long")))
    # Small cells share blocks, so that there are not many more blocks than needed; a crowded cell has its own.
    small = count.where("blocks = 1").agg(F.sum("n")).first()[0] or 0
    name, crowded = F.xxhash64("g", "mark"), F.col("blocks") > 1
    dealt = cells.join(count, ["g", "mark"]).select(
        "vec_id", "g", "mark", crowded.alias("crowded"),
        F.when(crowded, name).otherwise(F.pmod(name, F.lit(max(1, -(-small // rows))))).alias("block"),
        F.pmod(F.xxhash64("vec_id"), "blocks").alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"),
    )
    dealt = dealt.select("*", F.least("own", "other").alias("h"), F.greatest("own", "other").alias("k")).drop("other")
    whole = dealt.join(marked, "vec_id").withColumn("met", F.slice("marks", F.lit(1), F.col("g"))).drop("marks")

    def block(table):
        return _block(plan, dim)(table)

    return whole.groupBy("crowded", "block", "h", "k").applyInArrow(block, _FOUND)


def link_embeddings(
    vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per vector row: vec_id, n_links, component_id, kept.

    Two vectors link when a pair that meets in a cell and passes the count has a cosine of at least ``threshold`` in double
    precision; none below it links. Of links exactly at the threshold a share of ``MET`` is found, of closer ones more.
    Equal directions (after scaling, bit by bit) are one class that is
    compared once and always links. Vectors that are null, empty, zero or hold a null or non-finite component, and vectors of
    different lengths, link with nothing. Rows that share an id are one vector (if they differ, the one of the smallest digest); rows
    without an id link with nothing and have no component. An empty table gives no rows; labels and other columns
    are not read. Cells of any size are dealt out in blocks of at most ``BLOCK`` by ``BLOCK`` vectors.
    """
    read = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("embedding"))
    rows = stage(map_arrow(read, lambda: _vectors, "vec_id long, key binary, raw binary, dim long"))
    one = rows.where("vec_id IS NOT NULL AND key IS NOT NULL").groupBy("vec_id").agg(F.min(F.struct("key", "dim", "raw")).alias("v"))
    one = one.select("vec_id", "v.*")
    classes = one.groupBy("key", "dim").agg(F.min(F.struct("vec_id", "raw")).alias("v"), F.count("*").alias("weight"))
    classes = stage(classes.select("key", "dim", "v.*", "weight"))
    found = None
    for dim, n in sorted((r.dim, r["count"]) for r in classes.groupBy("dim").count().collect()):
        part = _links(classes.where(F.col("dim") == dim), n, dim, threshold)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = classes.select("vec_id", F.col("weight").alias("n_links"), F.col("vec_id").alias("other")).limit(0)
    found = stage(found)
    links = found.groupBy("vec_id").agg(F.sum("n_links").alias("links"))
    groups = components(found.where("other IS NOT NULL").select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    of_class = (
        classes.select("key", "vec_id", "weight")
        .join(links, "vec_id", "left")
        .join(groups.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component"))
    )
    of_vector = one.select("vec_id", "key").join(of_class, "key").drop("key")
    named = rows.where("vec_id IS NOT NULL").select("vec_id").join(of_vector, "vec_id", "left")
    nameless = rows.where("vec_id IS NULL").select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component"))
    component = F.coalesce("component", "vec_id")
    return named.unionByName(nameless).select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
