"""Embedding near-dedup by sorted projection passes.

In each pass every vector gets a key of 64 concatenated random hyperplane signs. Vectors are sorted by
that key over the whole cluster, the order is cut into blocks of BLOCK vectors, and each block is compared
with itself and the REACH blocks that follow it. Links of all passes are united into components.

The number of passes follows from the vectors. A first guess takes them as evenly spread: two vectors at the
threshold share a sign with probability p = 1 - acos(threshold) / pi, and fall into one window if they share about
the first log2(n / window) signs. After these passes the sorted keys tell for every vector how many leading signs
lead into its window, and its distances from their planes tell how likely a neighbour at the threshold, in
a random direction, shares them. Vectors whose neighbour all passes miss with a probability above MISS, as in a
dense topic without links, go through further passes among themselves, until none is left; where comparing
the remaining ones with each other is no more work than the passes they need, that is done. So a
pair at the threshold is missed with probability MISS at most; closer pairs are missed far less.

Where a block still finds links at the end of its window, the run of similar vectors is longer than the window;
such blocks are compared further, with twice the reach each round, until their runs end. A pair that several passes
bring together counts once: every vector carries its block number in all passes and how far its blocks have been
compared, and a pass skips pairs that an earlier one has compared. A task adds up degrees and joins links to one forest
over all its windows, so what leaves it is linear in its vectors however dense a cluster is. Equal vectors are
collapsed to one numbered class first and count by their number, so copies never meet. Cosines are of doubles.

Each pass sorts 64-bit keys of all vectors that take part in it and moves these vectors once (a quarter of them twice)
to their windows. Passes grow with the logarithm of the number of vectors in the exponent of p: about 9 for 2 * 10^4,
100 for 10^9 vectors. A run of m vectors costs m * m / 2 comparisons, as its degrees ask for, and moves its vectors
m / (HOME * BLOCK) times.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components have no links
and are kept; so is a row with a null vec_id, whose component_id is null; repeated rows are links of
each other; an id that stands for several vectors has the links of each in its rows; vectors of different lengths never
link; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Stash, join_counted, ship
from .components import connected_components

THRESHOLD, MISS = 0.9, 0.005
BLOCK, REACH = 256, 2
#: Consecutive blocks that one group of rows holds, besides the REACH blocks after them.
HOME = 8
SEED = 11
#: Block number in passes that a vector takes no part in.
ABSENT = -(1 << 40)
#: Degrees and edges that a task gathers before it hands them on, and pairs that are looked up at a time.
GATHERED, LOOKED_UP = 1 << 20, 1 << 16


def passes_for(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """Passes after which a pair of evenly spread vectors at the threshold is missed with probability ``miss``."""
    same = 1 - math.acos(threshold) / math.pi
    bits = max(0.0, math.log2(max(n, 1) / (BLOCK * REACH)))
    hit = same**bits
    return 2 if hit > 0.999 else max(2, math.ceil(math.log(miss) / math.log(1 - hit)))


def usable(column):
    """A column that is true for vectors that can link."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    length = F.aggregate(column, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.coalesce(column.isNotNull() & ~bad & (length > 0) & (length < float("inf")), F.lit(False))


def _planes(turn: int, dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, turn, dim]).standard_normal((dim, 64))


def _keys(first: int, last: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        weights = np.uint64(1) << np.arange(64, dtype=np.uint64)[::-1]
        for batch in batches:
            nodes, vectors = batch.column(0), batch.column(1)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            sizes = np.diff(vectors.offsets.to_numpy())
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                x = flat[starts[rows][:, None] + np.arange(dim)]
                own = nodes.take(pa.array(rows))
                for p in range(first, last):
                    if (p, dim) not in planes:
                        planes[p, dim] = _planes(p, dim)
                    signs = (x @ planes[p, dim] > 0).astype(np.uint64)
                    key = (signs * weights).sum(axis=1, dtype=np.uint64) ^ np.uint64(1 << 63)
                    fixed = [pa.array(np.full(len(rows), v, np.int32)) for v in (p, dim)]
                    yield pa.RecordBatch.from_arrays([*fixed, pa.array(key.view(np.int64)), own], names=["pass", "dim", "key", "node"])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's number and each row's place in it."""
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.num_rows
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))],
            names=["pass", "dim", "key", "node", "part", "place"],
        )
        at += n


def hit_chance(unit: np.ndarray, planes: np.ndarray, signs: np.ndarray, threshold: float) -> np.ndarray:
    """Chance that a neighbour at the threshold, in a random direction, shares the first ``signs`` signs of each vector of length 1."""
    most = min(64, int(signs.max(initial=0)))
    planes = planes[:, :most]
    off = np.abs(unit @ planes)
    along = np.sqrt(np.maximum((planes * planes).sum(0) - off * off, 1e-18))
    z = threshold * off / along * math.sqrt(max(unit.shape[1] - 1, 1) / max(1 - threshold * threshold, 1e-12))
    t = 1 / (1 + 0.3275911 * np.abs(z) / math.sqrt(2))  # normal distribution, Abramowitz and Stegun 7.1.26
    tail = 0.5 * np.exp(-z * z / 2) * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    share = np.cumprod(np.where(z < 0, tail, 1 - tail), axis=1)
    # No key has more than 64 signs: a vector among too many of one key meets nobody surely.
    share = np.concatenate([np.ones((len(unit), 1)), share, np.zeros((len(unit), 1))], axis=1)
    return np.where(signs > 64, 0.0, share[np.arange(len(unit)), np.minimum(signs, most)])


def _missed(first: int, threshold: float):
    """Adds to ``log`` the logarithms of the chances that passes from ``first`` on miss a vector's neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            vectors, n = batch.column(1), batch.num_rows
            log = batch.column(2).to_numpy().copy()
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            signs = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            sizes = np.diff(vectors.offsets.to_numpy())
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                x = flat[starts[rows][:, None] + np.arange(dim)]
                x /= np.sqrt((x * x).sum(1))[:, None]
                for k in range(signs.shape[1]):
                    if (first + k, dim) not in planes:
                        planes[first + k, dim] = _planes(first + k, dim)
                    hit = hit_chance(x, planes[first + k, dim], signs[rows, k], threshold)
                    log[rows] += np.log(np.maximum(1 - hit, 1e-300))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors, pa.array(log)], names=["node", "vec", "log"])

    return run


class _Group:
    """Rows of one group: vectors scaled to length 1, by block."""

    def __init__(self, rows: pa.Table):
        self.node = rows["node"].to_numpy()
        self.copies = rows["copies"].to_numpy()
        self.block = rows["block"].to_numpy()
        vectors = rows["vec"].combine_chunks()
        self.size = np.diff(vectors.offsets.to_numpy())
        self.flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        self.start = np.cumsum(self.size) - self.size
        self.spots = self._table(rows["blocks"])
        #: How far the block of each pass has been compared before this round, and after it.
        self.before, self.after = (self._table(rows[c]) if c in rows.column_names else None for c in ("before", "after"))

    @staticmethod
    def _table(lists: pa.ChunkedArray) -> np.ndarray:
        """Lists as the rows of a table, filled with ABSENT."""
        lists = lists.combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        out = np.full((len(sizes), sizes.max(initial=0)), ABSENT, np.int64)
        out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        return out

    def met(self, a: np.ndarray, b: np.ndarray, turns: int | None = None) -> np.ndarray:
        """Whether a window of the first ``turns`` passes (all if not given) holds both rows."""
        x, y = self.spots[a, :turns], self.spots[b, :turns]
        return ((np.abs(x - y) <= REACH) & (x != ABSENT)).any(axis=1)

    def compared(self, a: np.ndarray, b: np.ndarray, turn: int) -> np.ndarray:
        """Whether an earlier round, or an earlier pass of this one, has compared both rows."""
        out = np.zeros(len(a), bool)
        turns = self.before.shape[1]
        for at in range(0, len(a), LOOKED_UP):
            x, y = a[at : at + LOOKED_UP], b[at : at + LOOKED_UP]
            s, t = self.spots[x], self.spots[y]
            out[at : at + LOOKED_UP] = ((s[:, turns:] == t[:, turns:]) & (s[:, turns:] != ABSENT)).any(axis=1)
            s, t = s[:, :turns], t[:, :turns]
            least = np.where((s <= t).T, x, y).T  # the row whose block comes first tells how far it has been compared
            reach = self.before[least, np.arange(turns)]
            reach[:, :turn] = self.after[least[:, :turn], np.arange(turn)]
            out[at : at + LOOKED_UP] |= ((np.abs(s - t) <= reach) & (s != ABSENT) & (t != ABSENT)).any(axis=1)
        return out

    def links(self, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers (of a, of b) of all pairs at the threshold."""
        found_a, found_b = [], []
        for dim in np.unique(self.size[a]).tolist():
            i, j = a[self.size[a] == dim], b[self.size[b] == dim]
            if len(i) and len(j):
                x, y = (self.flat[self.start[k][:, None] + np.arange(dim)] for k in (i, j))
                norm = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :]
                s, t = np.nonzero(x @ y.T / norm >= threshold)
                found_a.append(i[s])
                found_b.append(j[t])
        if not found_a:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_a), np.concatenate(found_b)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among n rows as stars: the least row of each component and each of its other rows."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]
    others = np.flatnonzero(label != np.arange(n))
    return label[others], others


class _Tally:
    """Degrees and links of a task, summed and joined over its groups."""

    def __init__(self):
        none = np.zeros(0, np.int64)
        self.degrees, self.edges, self.size = [(none, none)], [(none, none)], 0

    def add(self, g: _Group, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Count links of row numbers; yields what was gathered if that is much."""
        if not len(x):
            return
        degree = np.zeros(len(g.node), np.int64)
        np.add.at(degree, x, g.copies[y])
        np.add.at(degree, y, g.copies[x])
        some = np.flatnonzero(degree)
        s, t = _forest(x, y, len(g.node))
        self.degrees.append((g.node[some], degree[some]))
        self.edges.append((g.node[s], g.node[t]))
        self.size += len(some) + len(s)
        if self.size > GATHERED:
            self._merge()
            if self.size > GATHERED // 2:
                yield from self.results()

    def _merge(self) -> None:
        nodes, counts = (np.concatenate(c) for c in zip(*self.degrees, strict=True))
        own, at = np.unique(nodes, return_inverse=True)
        total = np.zeros(len(own), np.int64)
        np.add.at(total, at, counts)
        a, b = (np.concatenate(c) for c in zip(*self.edges, strict=True))
        ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        s, t = _forest(at[: len(a)], at[len(a) :], len(ends))
        self.degrees, self.edges, self.size = [(own, total)], [(ends[s], ends[t])], len(own) + len(s)

    def results(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        (nodes, counts), (a, b) = self.degrees[0], self.edges[0]
        self.__init__()
        yield _result("degree", nodes, nodes, counts)
        yield _result("edge", a, b, np.zeros(len(a), np.int64))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Tables of rows with equal keys, of sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            x = batch.column(k).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(s, e - s)
            key = tuple(part.column(k)[0].as_py() for k in keys)
            if held and key != last:  # noqa: F821
                yield last, pa.Table.from_batches(held)  # noqa: F821
                held = []
            held.append(part)
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


RESULT = "kind string, a long, b long, n long"


def _result(kind: str, a, b, n) -> pa.RecordBatch:
    size = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * size, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())],
        names=["kind", "a", "b", "n"],
    )


def _compare(threshold: float):
    """Windows of one pass and group: degrees, a forest of links, and blocks whose run goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for (turn, home), rows in _groups(batches, ["pass", "home"]):
            g, going = _Group(rows), []
            for block in range(home * HOME, home * HOME + HOME):
                a = np.flatnonzero(g.block == block)
                b = np.flatnonzero((g.block >= block) & (g.block <= block + REACH))
                if not len(a):
                    continue
                x, y = g.links(a, b, threshold)
                ahead = (g.block[y] > block) | (y > x)
                x, y = x[ahead], y[ahead]
                if (g.block[y] == block + REACH).any():
                    going.append(block)
                if turn and len(x):
                    before = g.met(x, y, turn)
                    x, y = x[~before], y[~before]
                yield from tally.add(g, x, y)
            yield _result("open", going, [turn] * len(going), [0] * len(going))
        yield from tally.results()

    return run


def _compare_far(threshold: float):
    """Two homes of one pass: blocks of the first whose run goes on, with the blocks of the second in their new reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for (turn, first, second), rows in _groups(batches, ["pass", "first", "second"]):
            g = _Group(rows)
            for block in range(first * HOME, first * HOME + HOME):
                a = np.flatnonzero(g.block == block)
                if not len(a):
                    continue
                low, high = block + g.before[a[0], turn], block + g.after[a[0], turn]
                b = np.flatnonzero((g.block > low) & (g.block <= high) & (g.block // HOME == second))
                if not len(b):
                    continue
                x, y = g.links(a, b, threshold)
                if len(x):
                    yield _result("open", [block], [turn], [int(g.block[y].max()) - block])
                    new = ~g.compared(x, y, turn)
                    yield from tally.add(g, x[new], y[new])
        yield from tally.results()

    return run


def _compare_all(threshold: float, turns: int):
    """Two squares of the vectors that are compared with each other: degrees and a forest of links that no pass holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for (first, second), rows in _groups(batches, ["first", "second"]):
            g = _Group(rows)
            a, b = np.flatnonzero(g.block == first), np.flatnonzero(g.block == second)
            for at in range(0, len(a), BLOCK):
                x, y = g.links(a[at : at + BLOCK], b, threshold)
                new = ~g.met(x, y, turns)
                if first == second:
                    new &= y > x
                yield from tally.add(g, x[new], y[new])
        yield from tally.results()

    return run


def _lead(column):
    """Leading signs that decide between a row's key and the key ``column``; none if that is of other vectors or missing."""
    apart = F.col("key").bitwiseXOR(column["key"])
    shared = F.when(apart == 0, 64).otherwise(64 - F.length(F.bin(apart)))
    return F.when(column["dim"] == F.col("dim"), 1 + shared).otherwise(0)


def _spots(vectors: DataFrame, first: int, last: int, stash: Stash) -> DataFrame:
    """node and s, the block of each pass with the number of leading signs which lead into its window."""
    keyed = vectors.select("node", "vec").mapInArrow(_keys(first, last), "pass int, dim int, key long, node long")
    order = ["pass", "dim", "key", "node"]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stash.put(placed.mapInArrow(_numbered, "pass int, dim int, key long, node long, part int, place long"), f"placed{first}")
    parts = placed.groupBy("pass", "part").agg(F.count(F.lit(1)).alias("rows"))
    earlier = W.partitionBy("pass").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("pass", "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("begin"))
    spot = F.floor((F.col("begin") + F.col("place")) / BLOCK).cast("int")
    placed = placed.join(parts, ["pass", "part"]).select("pass", "dim", "key", "node", spot.alias("block"))
    end = F.struct("dim", "key")
    ends = stash.put(placed.groupBy("pass", "block").agg(F.min(end).alias("low"), F.max(end).alias("high")), f"ends{first}")
    for side, step in (("low", -REACH - 1), ("high", REACH + 1)):
        placed = placed.join(ends.select("pass", (F.col("block") + step).alias("block"), side), ["pass", "block"], "left")
    signs = F.greatest(_lead(F.col("low")), _lead(F.col("high"))).cast("int")
    spots = placed.select("node", F.struct("pass", "block", signs.alias("signs")).alias("s"))
    return stash.put(spots.groupBy("node").agg(F.sort_array(F.collect_list("s")).alias("s")), f"spots{first}")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, passes: int | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    ship(spark)
    stash = Stash(spark)
    held = vectors.schema["embedding"].dataType
    kind = "array<float>" if held.elementType.typeName() in ("float", "byte", "short") else "array<double>"
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vec"))
    given = given.withColumn("ok", usable(F.col("vec")) & F.col("vec_id").isNotNull())
    given = given.withColumn("hash", F.xxhash64("vec"))  # sorts fast; vectors themselves are compared at ties only
    reps = given.filter("ok").groupBy("hash", "vec").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    classes = stash.put(reps.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbered once, then read
    reps = classes.select("node", "vec", "copies")
    count = reps.count()
    turns = passes or passes_for(count, threshold)

    # Further passes hold the vectors only whose neighbours the earlier ones would miss, so a vector takes part in
    # the first passes up to its last one.
    left = reps.select("node", "vec", F.lit(0.0).alias("log"))
    found, first, rest = [], 0, None
    while True:
        found.append(_spots(left, first, turns, stash))
        if passes:
            break
        left = left.join(found[-1].select("node", F.col("s.signs").alias("signs")), "node").select("node", "vec", "log", "signs")
        left = left.mapInArrow(_missed(first, threshold), f"node long, vec {kind}, log double").filter(F.col("log") > math.log(MISS))
        left = stash.put(left, f"left{turns}")
        count, log = left.agg(F.count(F.lit(1)), F.percentile_approx("log", 0.5)).first()
        if not count:
            break
        more = max(2, math.ceil(turns * (math.log(MISS) / min(log, -1e-9) - 1)))
        if count <= more * BLOCK * (2 * REACH + 1):
            rest = left.select("node", F.array(F.struct(F.lit(turns).alias("pass"), F.lit(0).alias("block"), F.lit(0).alias("signs"))).alias("s"))
            break
        first, turns = turns, turns + min(more, turns)
    spots = found[0]
    for more_spots in [*found[1:], *([] if rest is None else [rest])]:
        spots = spots.unionByName(more_spots)
    spots = spots.groupBy("node").agg(F.sort_array(F.flatten(F.collect_list("s"))).alias("s"))
    rows = stash.put(reps.join(spots.select("node", F.col("s.block").alias("blocks")), "node"), "rows")

    each = rows.select("node", "copies", "vec", "blocks", F.posexplode("blocks").alias("pass", "block")).filter(F.col("pass") < turns)
    own = F.floor(F.col("block") / HOME).cast("int")
    before = F.floor((F.col("block") - REACH) / HOME).cast("int")
    homes = F.when((before < own) & (before >= 0), F.array(own, before)).otherwise(F.array(own))
    grouped = each.withColumn("home", F.explode(homes)).repartition("pass", "home").sortWithinPartitions("pass", "home", "block", "node")
    result = stash.put(grouped.mapInArrow(_compare(threshold), RESULT), "windows")
    if rest is not None:
        # Squares of HOME blocks; fewer blocks each where the pairs of squares would not occupy all cores.
        n = max(1, -(-count // (BLOCK * HOME)), min(-(-count // BLOCK), math.isqrt(2 * spark.sparkContext.defaultParallelism)))
        own, other = F.col("block"), F.col("other")
        square = rows.filter(F.size("blocks") > turns).withColumn("block", F.pmod(F.xxhash64("node"), F.lit(n)).cast("int"))
        square = square.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        square = square.select("node", "copies", "vec", "blocks", "block", F.least(own, other).alias("first"), F.greatest(own, other).alias("second"))
        square = square.repartition("first", "second").sortWithinPartitions("first", "second", "block", "node")
        result = result.unionByName(stash.put(square.mapInArrow(_compare_all(threshold, turns), RESULT), "squares"))

    going = result.filter("kind = 'open'").select(F.col("b").cast("int").alias("pass"), F.col("a").cast("int").alias("block")).distinct()
    reach, turn, reaches = REACH, 0, None
    while not going.isEmpty():
        turn += 1
        now = going.withColumn("after", F.lit(2 * reach).cast("long"))
        if reaches is not None:
            now = reaches.join(now, ["pass", "block"], "full")
        before = F.coalesce("before", F.lit(REACH)) if reaches is not None else F.lit(REACH)
        table = now.select("pass", "block", before.cast("long").alias("before"), F.coalesce("after", before).cast("long").alias("after"))
        table = stash.put(table, f"reaches{turn}")
        reaches = table.select("pass", "block", F.col("after").alias("before"))
        result = result.unionByName(_further(each, table, reach, threshold, stash, turn))
        found_far = stash.get(f"far{turn}", result.schema).filter("kind = 'open'")
        # A run goes on where links were found in the farther half of this round's reach.
        last = found_far.filter(F.col("n") > reach + reach // 2)
        going = last.select(F.col("b").cast("int").alias("pass"), F.col("a").cast("int").alias("block")).distinct()
        reach *= 2

    degree = result.filter("kind = 'degree'").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    found = connected_components(result.filter("kind = 'edge'").select("a", "b"))
    linked = stash.put(classes.select("node", "id").join(found, "node"), "linked")
    least = stash.put(linked.groupBy("component").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    named = join_counted(linked, least, ["component"], linked.count()).select("node", "component_id")
    out = classes.join(degree, "node", "left").join(named, "node", "left")
    n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    out = stash.put(out.select("hash", "vec", "copies", n_links.alias("n_links"), F.coalesce("component_id", "id").alias("component_id")), "decided")
    stash.drop("rows", "windows", "squares", *[f"{x}{i}" for x in ("placed", "ends", "spots", "left", "reaches", "far") for i in range(max(turns, turn) + 1)])
    good = join_counted(given.filter("ok").drop("ok"), out, ["hash", "vec"], given.count(), "copies").select("vec_id", "n_links", "component_id")
    bad = given.filter("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _further(each: DataFrame, table: DataFrame, reach: int, threshold: float, stash: Stash, turn: int) -> DataFrame:
    """Results of comparing the blocks of table(pass, block, before, after) whose reach grows beyond ``reach``."""
    home = lambda c: F.floor(c / HOME).cast("int")
    block = F.col("block")
    ahead = F.explode(F.sequence(block + reach + 1, block + 2 * reach))
    pairs = table.filter("after > before").select("pass", block.alias("x"), ahead.alias("y"))
    members = pairs.select("pass", home(F.col("x")).alias("first"), home(F.col("y")).alias("second"), F.explode(F.array("x", "y")).alias("block")).distinct()
    far = each.join(members, ["pass", "block"])
    nodes = far.select("node").distinct()
    marks = each.select("node", "pass", "block").join(nodes, "node", "left_semi").join(table, ["pass", "block"], "left")
    mark = F.struct("pass", F.coalesce("before", F.lit(REACH)).cast("long").alias("before"), F.coalesce("after", F.lit(REACH)).cast("long").alias("after"))
    marks = marks.groupBy("node").agg(F.sort_array(F.collect_list(mark)).alias("m"))
    far = far.join(marks.select("node", F.col("m.before").alias("before"), F.col("m.after").alias("after")), "node")
    far = far.repartition("pass", "first", "second").sortWithinPartitions("pass", "first", "second", "block", "node")
    return stash.put(far.mapInArrow(_compare_far(threshold), RESULT), f"far{turn}")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
