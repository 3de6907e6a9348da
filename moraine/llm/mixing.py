"""Mixing sources to target weights by weighted fair queueing.

Documents of each source stand in a shuffled order (a hash of id, text and number). Every document queues twice,
since a target may reach twice its source: once in the first pass over the source, once in the
second. A document's virtual finish time is the source's cumulative words, with half of its own, over
the source's target; half, so that the cut leaves each source within half a document of its target.
All are then range-sorted by that time, and the sequence is cut where its running total reaches the
budget, the sum of the targets.

All running sums are two-level. Within a source, documents fall into hash slices (as many as the row count and the
number of shuffle partitions ask for), slice totals are summed by source and a window runs inside one slice only, so
a source with a third of all rows is dealt over all tasks. Equal rows are counted first and numbered, and the
number is part of their hash, so neither null ids nor repeated rows pile up in one slice. The global sum goes over
the totals of the range partitions, and so do the sums over the sources, of which there may be many. Only ids, sizes and
hashes of texts are shuffled.

Defined cases: null text has size 0 and is taken 0 times; a null source is a source of its own,
ordered last; a null doc_id and repeated rows count as rows of their own, and equal ones share what is taken of
them; empty tables give empty results; further columns are ignored, by ``mixed_documents`` returned as they are,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SLOTS, WORD, Stash, fresh, join_counted, running

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, REPEATS = 1.5, 2
#: Rows that a slice of a source holds at most, about; equal rows that are numbered by one task at a time.
SLICE_ROWS, CHUNK = 20_000, 4096


def _cut(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _body(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def targets(sizes: DataFrame, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """sizes(source, source_size, ...) -> with target: shares by weight, water-filled under repeats * source_size.

    A source is full when the level (words per unit of weight) reaches its cap over its weight.
    Ordered by that ratio, a source is full exactly if the level it would set leaves enough for the
    rest, which a running sum over the sources tells.
    """
    stash = Stash(sizes.sparkSession)
    name = [F.col("source").isNull(), F.encode(F.coalesce("source", F.lit("")), "UTF-8")]
    weights = F.array(*map(F.lit, WEIGHTS))
    s = running(sizes, name, {"_place": F.lit(1)}, stash, "sources")
    s = s.withColumn("_weight", F.get(weights, F.pmod("_place", F.lit(len(WEIGHTS))).cast("int")))
    s = s.withColumn("_most", F.lit(float(repeats)) * F.col("source_size")).withColumn("_ratio", F.col("_most") / F.col("_weight"))
    s = running(s, [F.col("_ratio"), *name], {"_full": F.col("_most"), "_before": F.col("_weight")}, stash, "ratios")
    totals = s.agg((F.lit(share) * F.sum("source_size")).alias("_budget"), F.sum("_weight").alias("_weights"))
    s = s.crossJoin(totals)  # one row
    s = s.withColumn("_level", (F.col("_budget") - F.col("_full")) / (F.col("_weights") - F.col("_before")))
    s = stash.put(s.withColumn("_is_full", F.col("_ratio") <= F.col("_level")), "levels")
    # Past the first source that is not full the would-be levels only fall.
    level = s.agg(F.max(F.when(~F.col("_is_full"), F.col("_level"))).alias("_final"))
    s = s.crossJoin(level)  # one row
    target = F.when(F.col("_is_full"), F.col("_most")).otherwise(F.col("_weight") * F.col("_final"))
    return s.select(*sizes.columns, target.alias("target"))


def _numbered(sized: DataFrame) -> DataFrame:
    """sized(doc_id, source, size, body) with k, which numbers equal rows from 0."""
    groups = sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("_n"))
    single = groups.filter("_n = 1").drop("_n").withColumn("k", F.lit(0).cast("long"))
    chunks = groups.filter("_n > 1").withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / CHUNK))))
    chunks = chunks.repartition(*sized.columns, "_c")
    last = F.least((F.col("_c") + 1) * CHUNK, F.col("_n")) - 1
    several = chunks.select(*sized.columns, F.explode(F.sequence(F.col("_c") * CHUNK, last)).alias("k"))
    return single.unionByName(several)


def decide(docs: DataFrame, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """One row per document: doc_id, source, body (a hash of its text), k (a number among equal rows), size, source_size, target, times."""
    spark = docs.sparkSession
    stash = Stash(spark)
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", _cut(F.col("text")).alias("size"), _body(F.col("text")).alias("body"))
    sized = stash.put(sized, "sized")
    rows = sized.count()
    dealt = max(rows // SLICE_ROWS, int(spark.conf.get("spark.sql.shuffle.partitions")) - 1)
    slices = 1 << max(0, dealt.bit_length())
    same = ["doc_id", "source", "size", "body"]
    spot = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.coalesce("source", F.lit("")), "size", "body", "k")
    placed = _numbered(sized).withColumn("spot", spot).withColumn("slice", F.pmod(F.shiftright("spot", 20), F.lit(slices)).cast("int"))
    # Null sources have a name of their own from here on, so joins need not be null-safe.
    placed = placed.withColumn("from", F.concat(F.when(F.col("source").isNull(), "-").otherwise("+"), F.coalesce("source", F.lit(""))))
    placed = stash.put(placed, "placed")

    parts = stash.put(placed.groupBy("from", "slice").agg(F.sum("size").alias("slice_size"), F.count(F.lit(1)).alias("n")), "slices")
    earlier = W.partitionBy("from").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select("from", "slice", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)).alias("slice_start"), "n")
    sums = parts.groupBy("from").agg(F.sum("slice_size").alias("source_size"), F.count(F.lit(1)).alias("slices"))
    sums = sums.withColumn("source", F.when(F.col("from").startswith("+"), F.expr("substring(`from`, 2)")))
    goals = stash.put(targets(sums, share, repeats).drop("source"), "targets")
    starts = stash.put(join_counted(starts, goals, ["from"], parts.count(), "slices").drop("slices"), "starts")

    inside = W.partitionBy("from", "slice").orderBy("spot", *same, "k").rowsBetween(W.unboundedPreceding, W.currentRow)
    queued = placed.withColumn("upto", F.sum("size").over(inside)).join(starts.drop("n"), ["from", "slice"])
    served = F.col("slice_start") + F.col("upto") - F.col("size") / 2
    queued = queued.select(
        *same, "k", "spot", "source_size", "target",
        F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("turn"), served.alias("served"),
    )
    time = F.when(F.col("target") > 0, (F.col("served") + F.col("turn") * F.col("source_size")) / F.col("target")).otherwise(F.lit(0.0))
    order = ["finish", "spot", *same, "k", "turn"]
    line = queued.withColumn("finish", time).repartitionByRange(*order).sortWithinPartitions(*order)
    line = stash.put(line.withColumn("part", F.spark_partition_id()), "line")

    # Parts hold consecutive stretches of the global order. Only the one in which the budget is
    # reached is summed row by row; of the others, all or nothing is taken.
    totals = line.groupBy("part").agg(F.sum("size").alias("part_size"))
    begin = F.sum("part_size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # one row per partition
    totals = totals.withColumn("part_start", F.coalesce(begin, F.lit(0)))
    # The sum of the targets, from whole numbers, so that no order of adding fractions moves the cut.
    totals = totals.crossJoin(goals.agg((F.lit(float(min(share, repeats))) * F.sum("source_size")).alias("budget")))  # one row
    sums = F.sum("size").over(W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    cut = line.join(totals, "part").withColumn("running", F.col("part_start") + sums)
    cut = cut.withColumn("in", F.col("running") - F.col("size") / 2 <= F.col("budget"))
    turns = cut.groupBy(*same, "k").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum(F.col("in").cast("long")).alias("times")
    )
    stash.drop("sized", "placed", "slices", "starts")
    return turns


def mix(docs: DataFrame, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted), times, source."""
    return decide(docs, share, repeats).select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "times", "source")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns; documents without words are kept once.

    Rows equal in id, source and text share their turns evenly. They are found by slots of their ids, numbered in the
    partitions in which they lie, and dealt from there; all other rows meet their turns by a merge join.
    """
    stash = Stash(docs.sparkSession)
    names = {c: fresh(docs.columns, f"_{c}") for c in ("id", "from", "body", "slot", "part", "i", "before", "n", "times", "copy")}
    keys = [names[c] for c in ("id", "from", "body")]

    def keyed(body: Column) -> list[Column]:
        source = F.concat(F.when(F.col("source").isNull(), "-").otherwise("+"), F.coalesce("source", F.lit("")))
        id_ = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-"))
        return [c.alias(k) for c, k in zip((id_, source, body), keys, strict=True)]

    turns = decide(docs).select(*keyed(F.col("body")), F.when(F.col("size") == 0, 1).otherwise(F.col("times")).alias(names["times"]))
    turns = stash.put(turns.groupBy(*keys).agg(F.count(F.lit(1)).alias(names["n"]), F.sum(names["times"]).alias(names["times"])), "turns")
    given = docs.select("*", *keyed(_body(F.col("text"))))
    n, times = F.col(names["n"]), F.col(names["times"])
    single = given.join(turns.filter((n == 1) & (times > 0)).hint("merge"), keys)

    several = turns.filter(n > 1)
    slot = F.pmod(F.xxhash64(keys[0]), F.lit(SLOTS)).cast("int").alias(names["slot"])
    slots = F.broadcast(several.select(slot).distinct())
    rows = several.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    found = join_counted(given.select("*", slot).join(slots, names["slot"], "left_semi"), several, keys, rows, names["n"])
    found = stash.put(found.withColumn(names["part"], F.spark_partition_id()), "several")
    part = names["part"]
    before = F.sum(names["i"]).over(W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    starts = found.groupBy(*keys, part).agg(F.count(F.lit(1)).alias(names["i"]))
    starts = starts.select(*keys, part, F.coalesce(before, F.lit(0)).alias(names["before"]))
    inside = F.row_number().over(W.partitionBy(*keys, part).orderBy(part))
    found = found.withColumn(names["i"], inside).join(starts, [*keys, part])
    extra = F.when(F.col(names["before"]) + F.col(names["i"]) <= times % n, 1).otherwise(0)
    found = found.withColumn(names["times"], F.floor(times / n) + extra)

    both = single.select(*docs.columns, names["times"]).unionByName(found.select(*docs.columns, names["times"]))
    copies = F.explode(F.sequence(F.lit(1), F.col(names["times"]).cast("int"))).alias(names["copy"])
    return both.filter(F.col(names["times"]) > 0).select(*docs.columns, copies).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")
