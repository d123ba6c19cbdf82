"""Connected components over edge tables, and clusters of neighbouring curve segments."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perinuc.scale import apart, cut, cut_round


def _state(edges: DataFrame, keys: Sequence[str]) -> tuple:
    """Order-free fingerprint of an edge table."""
    mark = F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), mark).first())


def _ends(*pairs: tuple[str, str]) -> Column:
    """One row per pair of columns, as ``_e.u`` and ``_e.v``."""
    return F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])).alias("_e")


def components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest node of each node's component, within ``keys``.

    Alternates two kinds of star contraction, which needs a number of rounds that grows with the
    logarithm of the longest path.  Each round is aggregates and joins on the node, and is
    materialised to keep the lineage short.  ``nodes`` has ``node``, ``edges`` has ``u, v``.
    """
    keys = list(keys)
    stars = apart(
        cut(edges.filter("u <> v").select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    )
    before = None
    while (now := _state(stars, keys)) != before:
        before = now
        # every larger neighbour is hung under the smallest neighbour
        both = stars.select(*keys, _ends(("u", "v"), ("v", "u"))).select(*keys, "_e.*")
        low = both.groupBy(*keys, "u").agg(F.min("v").alias("_m")).withColumn("_m", F.least("_m", "u"))
        large = both.join(low, [*keys, "u"]).filter("v > u").select(*keys, F.col("v").alias("u"), F.col("_m").alias("v"))
        large = large.filter("u <> v").distinct()
        # every smaller neighbour, and the node itself, is hung under the smallest one
        least = large.groupBy(*keys, "u").agg(F.min("v").alias("_m"))
        small = large.join(least, [*keys, "u"]).select(*keys, _ends(("v", "_m"), ("u", "_m"))).select(*keys, "_e.*")
        stars = cut_round(small.filter("u <> v").distinct())
    found = stars.select(*keys, F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.select(*keys, "node").distinct().join(found, [*keys, "node"], "left").select(
        *keys, "node", F.coalesce("component", "node").alias("component")
    )


def near_segments(ends: DataFrame, keys: Sequence[str], limit: float) -> DataFrame:
    """Pairs of segments that have ends within ``limit`` of each other, both bounds included.

    Ends share a grid whose cells are small enough that all ends of one cell are neighbours, so a cell is
    represented by links to its first segment; distances are only checked between different cells.
    """
    keys = list(keys)
    side = limit / math.sqrt(2.0) * (1.0 - 1e-9)
    tips = ends.select(
        *keys,
        "segment",
        F.explode(
            F.array(
                F.struct(F.col("start_y").alias("y"), F.col("start_x").alias("x")),
                F.struct(F.col("end_y").alias("y"), F.col("end_x").alias("x")),
            )
        ).alias("_p"),
    ).select(*keys, "segment", "_p.y", "_p.x")

    def cell(c: str) -> Column:
        return F.floor(F.col(c) / F.lit(side)).cast("long")

    placed = apart(cut(tips.withColumn("_cy", cell("y")).withColumn("_cx", cell("x"))))
    head = placed.groupBy(*keys, "_cy", "_cx").agg(F.min("segment").alias("v"))
    same = placed.join(head, [*keys, "_cy", "_cx"]).select(*keys, F.col("segment").alias("u"), "v")
    # half of the cells within two steps; the other half is met from the other side
    steps = [(a, b) for a in range(0, 3) for b in range(-2, 3) if (a, b) > (0, 0)]
    # equal places of a cell are compared once
    spots = placed.groupBy(*keys, "_cy", "_cx", "y", "x").agg(F.min("segment").alias("u"))
    moved = spots.select(
        *keys, "u", "y", "x", F.explode(F.array(*[F.struct((F.col("_cy") + a).alias("_cy"), (F.col("_cx") + b).alias("_cx")) for a, b in steps])).alias("_to")
    ).select(*keys, "u", "y", "x", "_to.*")
    other = spots.select(*keys, "_cy", "_cx", F.col("u").alias("v"), F.col("y").alias("y2"), F.col("x").alias("x2"))
    gap = F.sqrt((F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2")) + (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")))
    across = moved.join(other, [*keys, "_cy", "_cx"]).filter(gap <= limit).select(*keys, "u", "v")
    return same.unionByName(across).filter("u <> v").distinct()


def segment_clusters(ends: DataFrame, keys: Sequence[str], limit: float) -> DataFrame:
    """Segments whose ends lie close, directly or through others; a cluster is named by its first segment."""
    nodes = ends.select(*keys, F.col("segment").alias("node"))
    found = components(nodes, near_segments(ends, keys, limit), keys)
    return found.select(*keys, F.col("node").alias("segment"), F.col("component").alias("cluster"))
