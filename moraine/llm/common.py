"""What the operators of this package share: places for intermediate tables, joins that split hot keys, running
sums over range partitions, names for added columns, shipping of the package to executors, and the 64-bit
hash finaliser."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WHITESPACE = r"\x20\x09-\x0D"
WORD = rf"[^{WHITESPACE}]+"

_shipped: set[str] = set()
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A fresh path (not created) under the folder all executors share.

    The folder is the session's ``spark.checkpoint.dir`` or the context's checkpoint folder; only in
    local mode (tests), where neither is set, a temporary folder is taken.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _own_dirs.get(sc.applicationId) or "file://" + tempfile.mkdtemp(prefix="moraine-")
        _own_dirs[sc.applicationId] = base
    return f"{base.rstrip('/')}/moraine-{uuid.uuid4().hex}"


class Stash:
    """Intermediate tables of one operator call, each written once to the shared folder.

    Reading them back cuts the lineage, so a lost executor costs a reread and no recomputation.
    ``drop`` removes those that are no longer needed; ``Stash.release`` all that were made since a mark.
    """

    _made: list[Stash] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = shared_dir(spark)
        Stash._made.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.get(name, df.schema)

    def get(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        self._delete(*map(self.path, names))

    def _delete(self, *paths: str) -> None:
        for at in paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    @staticmethod
    def mark() -> int:
        return len(Stash._made)

    @staticmethod
    def release(mark: int) -> None:
        """Delete the tables of all calls since the mark, once what was built on them is written elsewhere."""
        for stash in Stash._made[mark:]:
            stash._delete(stash.root)
        del Stash._made[mark:]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="moraine-"), "moraine_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spread(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Deal rows over all cores if the scan has fewer partitions than the cluster has slots.

    A small table in one file would otherwise keep one core busy; larger ones are left alone.
    """
    slots = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)


def lower_ascii(column):
    """A-Z to a-z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: A key with at least 1/HEAVY_SHARE of all rows, and LEAST_HEAVY of them, is heavy: there are at most HEAVY_SHARE such keys.
HEAVY_SHARE, LEAST_HEAVY = 4000, 1000


def join_counted(many: DataFrame, one: DataFrame, keys: list[str], rows: int, n: str = "n", how: str = "inner") -> DataFrame:
    """Join (inner or left) of many with one, which has a row per key (without nulls) and in ``n`` how many rows of many have it.

    Rows of heavy keys find theirs by a broadcast of at most HEAVY_SHARE rows and stay where they are; the
    others by a sort-merge join, in which no key has more rows than that share. ``one`` is read twice: it should be written.
    """
    bound = max(LEAST_HEAVY, -(-rows // HEAVY_SHARE))
    heavy, light = one.filter(F.col(n) >= bound), one.filter(F.col(n) < bound)
    if heavy.isEmpty():
        return many.join(one.hint("merge"), keys, how)
    rest = many.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return many.join(F.broadcast(heavy), keys).unionByName(rest.join(light.hint("merge"), keys, how))


#: Slots that ids are dealt over to tell rows that are surely not concerned; a broadcast of them has so many rows at most.
SLOTS = 1 << 20


def without(docs: DataFrame, gone: DataFrame, row: dict[str, Column], slot_of: str) -> DataFrame:
    """docs without the rows that gone names: ``row`` gives the expressions on docs that equal gone's columns, null-safe.

    Rows whose slot (a hash of ``slot_of``) no lost row has pass without a shuffle; only the others meet the lost
    rows, by a sort-merge join.
    """
    columns = docs.columns
    at, names = fresh(columns, "_slot"), {c: (fresh(columns, f"_own_{c}"), fresh(columns, f"_gone_{c}")) for c in row}
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")
    slots = F.broadcast(gone.select(slot(F.col(slot_of)).alias(at)).distinct())
    own, same = docs.withColumn(at, slot(row[slot_of])), F.lit(True)
    concerned, named = own.join(slots, at, "left_semi"), gone.select(*[F.col(c).alias(names[c][1]) for c in row])
    for c, (mine, lost) in names.items():
        concerned = concerned.withColumn(mine, row[c])
        same = same & F.col(mine).eqNullSafe(F.col(lost))
    kept = concerned.join(named.hint("merge"), same, "left_anti")
    return own.join(slots, at, "left_anti").select(*columns).unionByName(kept.select(*columns))


def running(df: DataFrame, order: list, sums: dict[str, Column], stash: Stash, name: str) -> DataFrame:
    """df with the sums over all rows before each one in a total order.

    Two levels: rows are range-partitioned and written, totals of the partitions are summed, and a window runs inside
    one partition only, so no task holds all rows.
    """
    keys = [f"_order{i}" for i in range(len(order))]
    placed = df.select("*", *[c.alias(k) for c, k in zip(order, keys, strict=True)], *[c.alias(f"_sum_{k}") for k, c in sums.items()])
    placed = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    placed = stash.put(placed, name)
    parts = placed.groupBy("_part").agg(*[F.sum(f"_sum_{k}").alias(f"_all_{k}") for k in sums])
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    parts = parts.select("_part", *[F.coalesce(F.sum(f"_all_{k}").over(earlier), F.lit(0)).alias(f"_begin_{k}") for k in sums])
    inside = W.partitionBy("_part").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    both = placed.join(parts, "_part")
    own = [(F.col(f"_begin_{k}") + F.coalesce(F.sum(f"_sum_{k}").over(inside), F.lit(0))).alias(k) for k in sums]
    return both.select(*df.columns, *own)


def fresh(columns: list[str], name: str) -> str:
    """A name for an added column: ``name``, with as many underscores behind it as it takes to differ from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
