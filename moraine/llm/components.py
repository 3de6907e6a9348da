"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is two aggregations and two joins on node ids; a hub with many links is pre-aggregated
before the shuffle, and its links meet their least node by a broadcast of the few heavy hubs. Rounds are written
to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, join_counted


def _with_least(edges: DataFrame, rows: int, stash: Stash, name: str) -> DataFrame:
    """edges with m, the least v of each u."""
    least = stash.put(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), name)
    return join_counted(edges, least, ["u"], rows)


def _large_star(edges: DataFrame, rows: int, stash: Stash, name: str) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * rows, stash, name).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, rows: int, stash: Stash, name: str) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = _with_least(down, rows, stash, name).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(stash.get(name, "u long, m long").select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> (node, component): the smallest node reachable from each node that has a link."""
    stash = Stash(links.sparkSession)
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    edges = stash.put(edges, "round0")
    seen, n = None, 0
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())
        if state == seen or not state[0]:
            break
        seen, n = state, n + 1
        large = stash.put(_large_star(edges, state[0], stash, f"one{n}"), f"large{n}")
        small = _small_star(large, state[0], stash, f"two{n}")
        edges = stash.put(small.filter("u != v").distinct(), f"round{n}")
        stash.drop(f"round{n - 1}", f"large{n}", f"one{n}", f"two{n}")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
