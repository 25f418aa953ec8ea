"""Exact Jaccard join of documents on word shingles, as a blocked sparse matrix product.

Documents are rows and shingles columns of an incidence matrix. Equal rows are one class. Two rows that
are similar enough share ``EXTRA`` entries among the first few columns of either row (its prefix), if all
rows order columns alike; very frequent columns come last. So only prefixes are multiplied, and rows
with fewer shared columns are done. Of each shared column the class with most shared columns is
the leader of the others.

1. Leaders and their followers with enough common columns are verified and give components.
2. Two classes of different components that share a column follow one leader. A leader's followers
   are multiplied with each other in blocks: a pair's overlap is bounded by its sizes and by the columns
   of one row whose bucket is empty in the other; pairs below the overlap that their sizes ask for are
   dropped in the block, and the rest is verified.

Each link lies within a component of the first step or is found in the second, so the components of
all verified links are those of all links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tagloom.llm.common import batch, conf, map_arrow, texts
from tagloom.llm.components import components
from tagloom.llm.hashing import WordHasher, mix, parts, words_of
from tagloom.sources.staging import stage

#: Common prefix columns that a similar pair must have (or all it needs, if its sizes allow fewer).
EXTRA = 8
#: The most columns put last as frequent. Results do not depend on it, only the number of candidates.
MOST_FREQUENT = 1_000_000
FREQUENT = 16
#: Followers of a leader in one block of the product.
BLOCK = 5_000
#: Followers verified against their leader in one group.
FOLLOWERS = 2_000
#: The most ids of a filter (40 MB); with more candidates every text is shuffled.
MOST_IDS = 20_000_000
#: The fewest buckets of a row's bit map.
BUCKETS = 1024
_M1, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x165667B19E3779F9)


class Shingler:
    """Distinct shingles of texts as sorted 64-bit hashes."""

    def __init__(self, size: int):
        self.size, self.hasher = size, WordHasher(lower=True)

    def many(self, raw: list[str]) -> list[np.ndarray]:
        h, counts = words_of(self.hasher, raw)
        rolled = np.full(max(0, len(h) - self.size + 1), self.size, np.uint64)
        for k in range(self.size):
            rolled = mix(rolled + h[k : k + len(rolled)])
        out, at = [], 0
        for n in counts.tolist():
            if n >= self.size:
                one = np.sort(rolled[at : at + n - self.size + 1])
                out.append(one[np.concatenate([[True], one[1:] != one[:-1]])])
            else:
                one = np.full(min(n, 1), n, np.uint64)
                for k in range(n):
                    one = mix(one + h[at + k])
                out.append(one)
            at += n
        return out


def classes_of(sets: list[np.ndarray]) -> np.ndarray:
    """64-bit names of sets."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    some, out = np.flatnonzero(sizes), np.zeros(len(sets), np.uint64)
    if len(some):
        flat, first = np.concatenate(sets), (np.cumsum(sizes) - sizes)[some]
        a, b = np.add.reduceat(mix(flat), first), np.add.reduceat(mix(flat * _M3 + _M1), first)
        out[some] = mix((a + sizes[some].astype(np.uint64)) ^ (b * _M3))
    return out.view(np.int64)


def _chunks(batches):
    for b in batches:
        ids, raw = b.column(0).to_pylist(), b.column(1).to_pylist()
        for part in parts(raw):
            yield ids[part], raw[part]


def _widths(sizes: np.ndarray) -> np.ndarray:
    """Buckets for sets of given sizes: a power of two, and two for each shingle, so that at most half are filled."""
    return np.maximum(BUCKETS, 2 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))


def _maps(sets: list[np.ndarray]) -> list[bytes]:
    """Which buckets of the shingles' hashes a set fills."""
    widths, out = _widths(np.fromiter(map(len, sets), np.int64, len(sets))), []
    for s, width in zip(sets, widths.tolist()):
        bits = np.zeros(width, bool)
        bits[(s >> np.uint64(13)) % np.uint64(width)] = True
        out.append(np.packbits(bits).tobytes())
    return out


class BitMaps:
    """The maps of rows sorted by size, so that rows of one width lie together."""

    def __init__(self, maps: list[bytes]):
        lengths = np.fromiter(map(len, maps), np.int64, len(maps))
        self.first = np.flatnonzero(np.diff(lengths, prepend=0))
        self.width = np.searchsorted(self.first, np.arange(len(maps)), side="right") - 1
        ends = [*self.first[1:].tolist(), len(maps)]
        self.held = {
            (k, k): np.frombuffer(b"".join(maps[a:b]), np.uint64).reshape(b - a, -1) for k, (a, b) in enumerate(zip(self.first.tolist(), ends))
        }

    def of(self, wide: int, narrow: int) -> np.ndarray:
        """The maps of one width, folded to a narrower one."""
        if (wide, narrow) not in self.held:
            words = self.held[narrow, narrow].shape[1]
            maps = self.held[wide, wide]
            self.held[wide, narrow] = np.bitwise_or.reduce(maps.reshape(len(maps), -1, words), axis=1)
        return self.held[wide, narrow]

    def apart(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of rows a < b, how many buckets of one are empty in the other."""
        only_a, only_b = np.empty(len(a), np.int64), np.empty(len(a), np.int64)
        kinds = self.width[a] * len(self.first) + self.width[b]
        for kind in np.unique(kinds).tolist():
            narrow, wide = divmod(kind, len(self.first))
            some = np.flatnonzero(kinds == kind)
            left, right = self.of(narrow, narrow), self.of(wide, narrow)
            step = max(1, 3_000_000 // left.shape[1])
            for at in range(0, len(some), step):
                part = some[at : at + step]
                x, y = left[a[part] - self.first[narrow]], right[b[part] - self.first[wide]]
                only_a[part] = np.bitwise_count(x & ~y).sum(1, dtype=np.int64)
                only_b[part] = np.bitwise_count(y & ~x).sum(1, dtype=np.int64)
        return only_a, only_b


def _sizes(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.int64()), ("map", pa.binary())])

    def run(batches):
        shingler = Shingler(size)
        for ids, raw in _chunks(batches):
            sets = shingler.many(raw)
            yield batch(schema, doc_id=ids, n_shingles=[len(s) for s in sets], map=_maps(sets), **{"class": classes_of(sets)})

    return run


def _frequent(size: int, chunk: int = 4_000_000):
    """(shingle, n): shingles that several classes of a chunk of a task share."""
    schema = pa.schema([("shingle", pa.int64()), ("n", pa.int64())])

    def run(batches):
        shingler, seen, held, total = Shingler(size), set(), [], 0

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            several = counts > 1
            return batch(schema, shingle=values[several].view(np.int64), n=counts[several])

        for _, raw in _chunks(batches):
            sets = shingler.many(raw)
            for s, c in zip(sets, classes_of(sets).tolist()):
                if len(s) and c not in seen:
                    seen.add(c), held.append(s)
                    total += len(s)
            if total >= chunk:
                yield flush()
                seen, held, total = set(), [], 0
        if held:
            yield flush()

    return run


def _prefixes(size: int, percent: int, frequent: np.ndarray):
    """(shingle, class): the prefix columns of every class, once a task."""
    schema = pa.schema([("shingle", pa.int64()), ("class", pa.int64())])

    def run(batches):
        shingler, seen = Shingler(size), set()
        for _, raw in _chunks(batches):
            found, owners = [], []
            sets = shingler.many(raw)
            for s, c in zip(sets, classes_of(sets).tolist()):
                n = len(s)
                if not n or c in seen:
                    continue
                seen.add(c)
                take = min(n, n - (percent * n + 99) // 100 + EXTRA)
                spot = np.searchsorted(frequent, s)
                often = frequent[np.minimum(spot, len(frequent) - 1)] == s if len(frequent) else np.zeros(n, bool)
                rare = s[~often]
                found.append(rare[:take] if len(rare) >= take else np.concatenate([rare, s[often][: take - len(rare)]]))
                owners.append((c, len(found[-1])))
            if found:
                names, counts = np.array(owners, np.int64).T
                yield batch(schema, shingle=np.concatenate(found).view(np.int64), **{"class": np.repeat(names, counts)})

    return run


def _cross_pairs(percent: int):
    """(x, y): pairs of different components among a leader's followers whose overlap may be large enough.

    Input rows are (leader, low, high, side, class, n, component, map) in the order of the first three.
    A block (low, high) pairs two parts of the followers, or one part with itself.
    """
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def pairs_of(numbers, maps):
        side, cls, n, comp = numbers
        order = np.argsort(n, kind="stable")
        side, cls, n, comp = side[order], cls[order], n[order], comp[order]
        maps = BitMaps([maps[k] for k in order.tolist()])
        within = (side == side[0]).all()
        top = np.searchsorted(n, 100 * n // percent, side="right")  # the rows that are not too large
        for at in range(0, len(n), 256):
            rows = np.arange(at, min(at + 256, len(n)))
            last = int(top[rows].max())
            ok = comp[rows, None] != comp[None, at:last]
            ok &= np.arange(at, last)[None, :] > rows[:, None]
            if not within:
                ok &= side[rows, None] != side[None, at:last]
            i, j = np.nonzero(ok)
            for k in range(0, len(i), 200_000):
                a, b = rows[i[k : k + 200_000]], at + j[k : k + 200_000]
                least = -(-percent * (n[a] + n[b]) // (100 + percent))
                only_a, only_b = maps.apart(a, b)
                left = np.flatnonzero(np.minimum(n[a] - only_a, n[b] - only_b) >= least)
                if len(left):
                    x, y = cls[a[left]], cls[b[left]]
                    yield batch(schema, x=np.minimum(x, y), y=np.maximum(x, y))

    def run(batches):
        numbers, maps = np.zeros((7, 0), np.int64), []
        for b in batches:
            new = np.stack([np.asarray(c) for c in b.columns[:7]])
            numbers = np.concatenate([numbers, new], axis=1)
            maps += b.column(7).to_pylist()
            cuts = [0, *(np.flatnonzero((np.diff(numbers[:3], axis=1) != 0).any(axis=0)) + 1).tolist()]
            for first, end in zip(cuts, cuts[1:]):
                yield from pairs_of(numbers[3:, first:end], maps[first:end])
            numbers, maps = numbers[:, cuts[-1] :], maps[cuts[-1] :]
        if numbers.shape[1]:
            yield from pairs_of(numbers[3:], maps)

    return run


def _similar(size: int, percent: int):
    """Links (a, b) from rows (x, block, y, packed) in this order: a leader's text (y null), then those of its followers."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        shingler, unpack = Shingler(size), zstandard.ZstdDecompressor()
        group, leader = None, None
        for b in batches:
            for at in range(0, b.num_rows, 50):
                some = b.slice(at, 50)
                raw = [unpack.decompress(z).decode("utf-8", "surrogatepass") for z in some.column(3).to_pylist()]
                sets, found = [s for part in parts(raw) for s in shingler.many(raw[part])], []
                for x, block, y, t in zip(*(some.column(k).to_pylist() for k in range(3)), sets):
                    if y is None:
                        group, leader = (x, block), t
                    elif (x, block) != group:
                        raise RuntimeError("a follower without its leader's text")
                    else:
                        both = len(np.intersect1d(leader, t, assume_unique=True))
                        if 100 * both >= percent * (len(leader) + len(t) - both):
                            found.append((x, y))
                if found:
                    yield batch(schema, a=[f[0] for f in found], b=[f[1] for f in found])

    return run


class IdFilter:
    """A Bloom filter of ids in one array of 64-bit words: an id sets two bits."""

    def __init__(self, words: int):
        self.size, self.words = np.uint64(64 * words), np.zeros(words, np.uint64)

    def places(self, ids: np.ndarray) -> np.ndarray:
        first = mix(ids.astype(np.int64).view(np.uint64) + _M1)
        return np.stack([first % self.size, mix(first + _M3) % self.size])

    def holds(self, ids: np.ndarray) -> np.ndarray:
        at = self.places(ids)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool).all(axis=0)


def _bits(words: int):
    """(word, bits) of the ids of a task, one row for each word of the filter that they touch in a batch."""
    schema = pa.schema([("word", pa.int64()), ("bits", pa.int64())])

    def run(batches):
        for b in batches:
            at = IdFilter(words).places(np.asarray(b.column(0))).ravel()
            word, which = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, which, np.uint64(1) << (at & np.uint64(63)))
            yield batch(schema, word=word.astype(np.int64), bits=bits.view(np.int64))

    return run


def _filter_of(needed: DataFrame) -> IdFilter | None:
    """The filter of at most ``MOST_IDS`` ids, 16 bits each; beyond that none, and every text is shuffled."""
    n = needed.count()
    if n > MOST_IDS:
        return None
    out = IdFilter(n // 4 + 1)
    words = map_arrow(needed, lambda: _bits(len(out.words)), "word long, bits long")
    words = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out.words[np.asarray(words["word"])] = np.asarray(words["bits"]).view(np.uint64)
    return out


def _packed(wanted):
    """(packed_id, packed): the compressed texts whose ids the filter holds, or all."""
    schema = pa.schema([("packed_id", pa.int64()), ("packed", pa.binary())])

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            b = b.filter(b.column(0).is_valid())
            if wanted.value is not None and b.num_rows:
                b = b.filter(pa.array(wanted.value.holds(np.asarray(b.column(0)))))
            for at in range(0, b.num_rows, 500):
                raw = b.column(1).slice(at, 500).to_pylist()
                packed = [pack.compress(t.encode("utf-8", "surrogatepass")) for t in raw]
                yield batch(schema, packed_id=b.column(0).slice(at, 500), packed=packed)

    return run


def _verified(pairs: DataFrame, classes: DataFrame, read: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (x, y) of classes that are similar, as links (a, b).

    A task only packs texts that some pair may need; those are shuffled once to their ids and then once for each pair
    and each block of a leader, by (leader, block). Texts are joined by sorting at every size.
    """
    one = classes.select(F.col("class").alias("x"), F.col("rep").alias("rep_x"), F.col("n_shingles").alias("n_x"))
    two = classes.select(F.col("class").alias("y"), F.col("rep").alias("rep_y"), F.col("n_shingles").alias("n_y"))
    open_pairs = stage(
        pairs.join(one, "x")
        .join(two, "y")
        .where(100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
        .select("x", "y", "rep_x", "rep_y")
        .distinct()
    )
    leaders = open_pairs.groupBy("x").agg(F.max("rep_x").alias("rep_x"), F.ceil(F.count("*") / FOLLOWERS).cast("long").alias("blocks"))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    texts_of_leaders = leaders.select(F.col("rep_x").alias("packed_id"), "x", blocks, F.lit(None).cast("long").alias("y"))
    dealt = open_pairs.join(leaders.select("x", "blocks"), "x")
    dealt = dealt.select(F.col("rep_y").alias("packed_id"), "x", F.pmod(F.xxhash64("y"), F.col("blocks")).alias("block"), "y")
    wanted = stage(texts_of_leaders.unionAll(dealt))
    shared = read.sparkSession.sparkContext.broadcast(_filter_of(wanted.select("packed_id").distinct()))
    packed = map_arrow(read, lambda: _packed(shared), "packed_id long, packed binary").dropDuplicates(["packed_id"])
    whole = wanted.hint("merge").join(packed, "packed_id").select("x", "block", "y", "packed")
    whole = whole.repartition("x", "block").sortWithinPartitions("x", "block", F.col("y").asc_nulls_first())
    return stage(map_arrow(whole, lambda: _similar(size, percent), "a long, b long").distinct())


def jaccard_groups(
    docs: DataFrame, size: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id (smallest id reachable by links).

    Two documents link when ``100 * intersection >= percent * union`` of their sets of ``size``-word
    shingles (A-Z lower-cased; the whole sequence if shorter). Shingles and sets are compared by 64-bit
    hashes in the candidate search, texts decide. Null and empty texts link with nothing; equal texts
    are one class; rows that share an id must share the text (one of them is verified); null ids keep a null component; an
    empty table gives no rows. Other columns are not read.

    Shuffled: prefixes (100 - percent of each set) twice, the packed texts of candidates (others are left out
    where they are read, by a Bloom filter of the ids), and small tables by class. The frequent columns sent to the tasks are at most ``MOST_FREQUENT``. However many
    followers a leader has, they are multiplied in blocks of ``BLOCK``.
    """
    with conf(docs.sparkSession, spark__sql__execution__arrow__maxBytesPerBatch="8m"):  # of the jobs run here
        return _groups(texts(docs, id_col, text_col), size, percent)


def _groups(read: DataFrame, size: int, percent: int) -> DataFrame:
    spark = read.sparkSession
    sizes = stage(map_arrow(read, lambda: _sizes(size), "doc_id long, n_shingles long, class long, map binary"))
    filled = sizes.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = filled.groupBy("class").agg(F.min("doc_id").alias("rep"))
    rep_rows = filled.select(F.col("doc_id").alias("rep"), "n_shingles", "map")
    classes = stage(reps.join(rep_rows, "rep").dropDuplicates(["class"]))

    often = map_arrow(read, lambda: _frequent(size), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    often = often.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT)
    often = np.sort(np.array([r.shingle for r in often.select("shingle").collect()], np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast(often)
    prefixes = map_arrow(read, lambda: _prefixes(size, percent, shared.value), "shingle long, class long")

    several = prefixes.groupBy("shingle").agg(F.min("class").alias("least"), F.max("class").alias("most"))
    common = stage(prefixes.join(several.where("least <> most").select("shingle"), "shingle").dropDuplicates(["shingle", "class"]))
    # A class with fewer common columns than a similar pair must share is similar to none.
    needs = F.least(F.lit(EXTRA), F.ceil(F.lit(percent) * F.col("n_shingles") / 100))
    shares = common.groupBy("class").agg(F.count("*").alias("shares")).join(classes.select("class", "n_shingles"), "class")
    shares = stage(shares.where(F.col("shares") >= needs).select("class", "shares"))
    common = common.join(shares, "class")
    # The class that shares most columns; a hash of its name breaks ties the same way everywhere.
    place = F.col("shares") * F.lit(1 << 32) + F.pmod(F.xxhash64("class"), F.lit(1 << 32))
    leaders = common.groupBy("shingle").agg(F.max_by("class", place).alias("leader"))
    follows = common.join(leaders, "shingle").groupBy("leader", "class").agg(F.count("*").alias("n"))
    follows = stage(follows)

    sized = classes.select(F.col("class").alias("leader"), F.col("n_shingles").alias("n_leader"))
    stars = follows.where("class <> leader").join(sized, "leader")
    # Similar rows share about half of their prefixes; a wrong guess only leaves more for the second step.
    stars = stars.where(F.col("n") * 200 >= F.col("n_leader") * (100 - percent))
    first = _verified(stars.select(F.col("leader").alias("x"), F.col("class").alias("y")), classes, read, size, percent)
    groups = components(first).select(F.col("node").alias("class"), F.col("component"))

    named = follows.join(groups, "class", "left").select("leader", "class", F.coalesce("component", "class").alias("component"))
    mixed = named.groupBy("leader").agg(
        F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("rows")
    )
    mixed = mixed.where("least <> most").select("leader", F.ceil(F.col("rows") / BLOCK).cast("long").alias("blocks"))
    named = named.join(mixed, "leader")
    side = F.pmod(F.xxhash64("class"), F.col("blocks"))
    dealt = named.select("*", side.alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.join(classes.select("class", "n_shingles", "map"), "class").select(
        "leader", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "class",
        "n_shingles", "component", "map",
    )
    dealt = dealt.repartition("leader", "low", "high").sortWithinPartitions("leader", "low", "high")
    second = _verified(map_arrow(dealt, lambda: _cross_pairs(percent), "x long, y long"), classes, read, size, percent)

    every = components(first.unionAll(second))
    named = classes.join(every.withColumnRenamed("node", "class"), "class", "left").select(
        "class", "rep", F.coalesce("component", "class").alias("component")
    )
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = named.join(smallest, "component").select("class", "component_id")
    out = sizes.join(found, "class", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
