"""Connected components by alternating large-star and small-star steps on edges in the shared folder; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.runtime import durable

EDGES = 250_000  # in a file


def _large(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour (or itself)."""
    both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them. Edges have a > b."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).first())


def components(edges: DataFrame, most: int = 60, files: int = 8) -> DataFrame:
    """(node, component) for every node of edges (a, b), component being its smallest reachable node. Self-loops and repeated edges do nothing.

    files: how many the edges are written to at first; later their number sets it.
    """
    e = durable(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", files)
    state = _state(e)
    for _ in range(most if state[0] else 0):
        e = durable(_small(_large(e)), "stars", 1 + state[0] // EDGES)
        was, state = state, _state(e)
        if was == state:
            break
    else:
        if state[0]:
            raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
