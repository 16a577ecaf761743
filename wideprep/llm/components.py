"""Connected components of a link table by alternating large-star and small-star steps.

Each step gives every vertex the smallest neighbour it knows, writes the new links to the shared folder, and stops when a
whole round changes nothing. A vertex with very many links is only ever counted by a map-side minimum and met by joins
that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

MAX_ROUNDS = 60


def _minimums(pairs: DataFrame) -> DataFrame:
    """u and the smallest of u and its neighbours."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _signature(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: any order, repeats and loops allowed) to (vertex, root): root is the component's smallest vertex;
    vertices without a link to another have no row."""
    start = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = store(start, "links")  # u > v throughout
    before = None
    for _ in range(MAX_ROUNDS):
        now = _signature(edges)
        if now == before or now[0] == 0:
            return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
        before = now
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(store(_minimums(both), "large"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = store(large.distinct(), "star")
        # small star: every vertex's smaller neighbours, and the vertex itself, meet at the smallest
        small = edges.join(store(_minimums(edges), "small"), "u")
        out = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        edges = store(out.filter("u <> v").distinct(), "star")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
