"""Matching nuclei of two channels by box or mask overlap.

Boxes are filed by size and place, so that candidate pairs come from an equi-join of boxes that nearly agree and never
from all pairs of a field.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perinuc.functions.scalars import box_iou, magnitude, pair_score
from perinuc.scale import apart, cut, cut_round, positions

SIDES = ["left", "top", "right", "bottom"]


def _sides(df: DataFrame, prefix: str) -> list[Column]:
    return [F.col(f"final_{s}").alias(f"{prefix}{s}") for s in SIDES]


def _classes(size: Column, ratio: float) -> Column:
    """Size class of a side: sides of one class differ by less than ``ratio``."""
    return F.floor(F.log(size) / F.lit(math.log(ratio))).cast("int")


def _near(a: DataFrame, b: DataFrame, min_iou: float) -> DataFrame:
    """Pairs of boxes that may overlap by ``min_iou`` or more, each met once.

    Such boxes agree in width and height up to a factor of ``min_iou``, and their corners lie within ``1 - min_iou`` of the
    larger side of each other.  So a box is filed under the class of its sides and a cell as wide as that distance, and asks
    the few classes and cells that can hold a partner.  Small boxes have small cells: a crowd of them is compared with
    neighbours that overlap, never with all that lie in one large cell.
    """
    if min_iou <= 0:
        raise ValueError("min_iou must be positive: boxes that do not meet are never compared")
    ratio, reach = max(1.0 / min_iou, 1.25), max(1.0 - min_iou, 0.05)
    hair = 1.0 + 1e-9
    axes = (("x", "left", "right"), ("y", "top", "bottom"))

    def side(p: str, low: str, high: str) -> Column:
        return (F.col(f"{p}{high}") - F.col(f"{p}{low}")).cast("double")

    def cell(c: Column) -> Column:
        return F.lit(2.0 * reach) * F.pow(F.lit(ratio), c + 1)

    real_a, real_b = (
        df.filter((side(p, "left", "right") > 0) & (side(p, "top", "bottom") > 0)) for df, p in ((a, "a_"), (b, "b_"))
    )
    asks, files = real_a, real_b
    for axis, low, high in axes:
        mine = _classes(side("b_", low, high), ratio)
        files = files.withColumn(f"_c{axis}", mine).withColumn(f"_g{axis}", F.floor(F.col(f"b_{low}") / cell(mine)).cast("long"))
        width, of = side("a_", low, high), F.col(f"_c{axis}")
        asks = asks.withColumn(
            f"_c{axis}",
            F.explode(F.sequence(_classes(width * (min_iou / hair), ratio), _classes(width * (hair / min_iou), ratio))),
        )
        far = F.lit(reach * hair) * F.greatest(width, F.pow(F.lit(ratio), of + 1))
        asks = asks.withColumn(
            f"_g{axis}",
            F.explode(
                F.sequence(
                    F.floor((F.col(f"a_{low}") - far) / cell(of)).cast("long"), F.floor((F.col(f"a_{low}") + far) / cell(of)).cast("long")
                )
            ),
        )
    place = ["_cx", "_gx", "_cy", "_gy"]
    return asks.join(files, ["fov_id", *place]).drop(*place)


def _overlapping(a: DataFrame, b: DataFrame, min_iou: float) -> DataFrame:
    """Pairs of boxes with an overlap of ``min_iou`` or more."""
    touch = (F.least("a_right", "b_right") >= F.greatest("a_left", "b_left")) & (
        F.least("a_bottom", "b_bottom") >= F.greatest("a_top", "b_top")
    )
    return _near(a, b, min_iou).filter(touch).withColumn("iou", box_iou("a_", "b_")).filter(F.col("iou") >= min_iou)


def iou_best_match(a: DataFrame, b: DataFrame, min_iou: float) -> DataFrame:
    """Best channel-2 box for each channel-1 box; the first of equals wins, and a box may be chosen twice.

    Equal boxes of a field are matched once and joined back, so copies cause no extra pairs.
    """
    a_side = a.select("fov_id", F.col("ne_label").alias("ch1_label"), *_sides(a, "a_"))
    a_keys = ["fov_id", *[f"a_{s}" for s in SIDES]]
    b_first = (
        b.select("fov_id", "ord", "ne_label", *_sides(b, "b_"))
        .groupBy("fov_id", *[f"b_{s}" for s in SIDES])
        .agg(F.min(F.struct("ord", "ne_label")).alias("_first"))
    )
    met = _overlapping(a_side.select(*a_keys).distinct(), b_first, min_iou)
    best = met.groupBy(*a_keys).agg(
        F.min(F.struct((-F.col("iou")).alias("neg"), F.col("_first.ord"), F.col("_first.ne_label"))).alias("_best")
    )
    return a_side.join(best, a_keys).select(
        "fov_id", "ch1_label", F.col("_best.ne_label").alias("ch2_label"), (-F.col("_best.neg")).alias("iou")
    )


# candidates of a field that one task walks; the pairs of a larger field are settled by all tasks together
WALK = 200_000

# the order in which candidates are looked at
ORDER = ["a_ord", "_worse", "b_ord", "ch1_label", "ch2_label"]


def _walked(candidates: DataFrame) -> DataFrame:
    """Fields of ordinary size, many to a task: ordered candidates are walked once, those with both ends free are kept."""
    out = ["fov_id", "ch1_label", "ch2_label"]
    dealt = candidates.repartition("fov_id").sortWithinPartitions("fov_id", *ORDER).select(*out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, ones, twos = None, set(), set()
        for batch in batches:
            kept = []
            for i, (fov, one, two) in enumerate(zip(*(column.to_pylist() for column in batch.columns))):
                if fov != field:
                    field, ones, twos = fov, set(), set()
                if one not in ones and two not in twos:
                    ones.add(one)
                    twos.add(two)
                    kept.append(i)
            if kept:
                yield batch.take(pa.array(kept, pa.int64()))

    return dealt.mapInArrow(run, dealt.schema)


STATE = "v long, val int, y long, yn int, z long, zn int"
LOOKED = ["y_val", "y_to", "y_n", "z_val", "z_to", "z_n"]


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rules with what their two values are known to be, one step further."""
    for batch in batches:
        v, y, yn, z, zn, y_val, y_to, y_n, z_val, z_to, z_n = (c.to_numpy() for c in batch.columns)
        y_val, z_val = (np.where(known >= 0, known ^ turned, -1) for known, turned in ((y_val, yn), (z_val, zn)))
        y, yn = np.where((y_val < 0) & (y_to >= 0), (y_to, yn ^ y_n), (y, yn))
        z, zn = np.where((z_val < 0) & (z_to >= 0), (z_to, zn ^ z_n), (z, zn))
        two = z >= 0
        same = two & (y == z)
        val = np.where(two, -1, y_val)
        val[two & ((y_val == 0) | (z_val == 1) | (same & (yn == zn)))] = 0
        val[two & (y_val == 1) & (z_val == 0)] = 1
        # y is true: the opposite of z; z is false, or the opposite of y: y itself
        by_z = two & (y_val == 1)
        alone = by_z | (two & (z_val == 0)) | (same & (yn != zn))
        y, yn = np.where(by_z, (z, 1 - zn), (y, yn))
        z = np.where(alone, -1, z)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((v, val, y, yn, z, zn), kinds)], ["v", "val", "y", "yn", "z", "zn"])


def _settled(state: DataFrame) -> DataFrame:
    """One step: every value that is still open looks up the values it rests on.

    ``val`` of ``v`` is known (0 or 1), or it is that of ``y`` (turned over if ``yn``), or, with a ``z``, that of ``y`` unless
    that of ``z`` (turned over if ``zn``) holds.  A looked-up value that itself rests on one other is replaced by that one,
    so a chain halves with every step.
    """

    def looked(c: str) -> DataFrame:
        one = (F.col("val") < 0) & (F.col("z") < 0)
        return state.select(
            F.col("v").alias(c), F.col("val").alias(f"{c}_val"), F.when(one, F.col("y")).otherwise(F.lit(-1)).alias(f"{c}_to"), F.col("yn").alias(f"{c}_n")
        )

    open_ = state.filter("val < 0").drop("val").join(looked("y"), "y", "left").join(looked("z"), "z", "left")
    rules = open_.select("v", "y", "yn", "z", "zn", *LOOKED).fillna(-1, LOOKED)
    return state.filter("val >= 0").unionByName(rules.mapInArrow(_followed, STATE))


def _settled_together(candidates: DataFrame) -> DataFrame:
    """Large fields: whether the two ends of each candidate are free when its turn comes, for all candidates at once.

    An end is free at a candidate if it was free at the end's candidate before, and the other end of that one was not (else
    it was taken).  These are rules from value to value; ``_settled`` follows them all in parallel, and the number of steps
    grows with the logarithm of a chain.  No group is ever brought together.
    """
    edges = apart(cut(candidates.withColumn("_e", F.monotonically_increasing_id())))
    order = [F.col(c) for c in ORDER]
    placed = edges
    for end, label in (("_ia", "ch1_label"), ("_ib", "ch2_label")):
        placed = positions(placed, ["fov_id", label], order, end)
    placed = apart(cut(placed))

    def before(end: str, label: str, name: str) -> DataFrame:
        return placed.select("fov_id", label, (F.col(end) + 1).alias(end), F.col("_e").alias(name))

    linked = placed.join(before("_ia", "ch1_label", "_pa"), ["fov_id", "ch1_label", "_ia"], "left").join(
        before("_ib", "ch2_label", "_pb"), ["fov_id", "ch2_label", "_ib"], "left"
    )

    def rule(v: Column, first: Column, y: Column, z: Column) -> Column:
        none, no = F.lit(-1).cast("long"), F.lit(0)
        free = F.when(first, F.lit(1)).otherwise(F.lit(-1))
        return F.struct(
            v.alias("v"), free.alias("val"), F.coalesce(y, none).alias("y"), no.alias("yn"), F.coalesce(z, none).alias("z"), no.alias("zn")
        )

    e, a, b = F.col("_e") * 2, F.col("_pa") * 2, F.col("_pb") * 2
    rules = F.array(rule(e, a.isNull(), a, a + 1), rule(e + 1, b.isNull(), b + 1, b))
    state = cut(linked.select(F.explode(rules).alias("_r")).select("_r.*"))
    while not state.filter("val < 0").isEmpty():
        # dealt anew each time: a union adds up the partitions of both its sides
        state = cut_round(_settled(state).repartition("v"))
    kept = state.groupBy(F.floor(F.col("v") / 2).alias("_e")).agg(F.min("val").alias("_free")).filter("_free = 1")
    return edges.join(kept, "_e", "left_semi").select("fov_id", "ch1_label", "ch2_label")


def settle_greedily(candidates: DataFrame, walk: int = WALK) -> DataFrame:
    """One-to-one pairs from scored candidates: channel-1 nuclei in order, each takes its best free partner.

    Candidates: ``fov_id, ch1_label, a_ord, ch2_label, b_ord, score``.  Fields of up to ``walk`` candidates are walked, many
    to a task; larger ones are settled in parallel with the same result.
    """
    scored = cut(candidates.filter("score > 0").withColumn("_worse", -F.col("score")))
    large = scored.groupBy("fov_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > walk).select("fov_id")
    large = apart(cut(large))
    if large.isEmpty():
        return _walked(scored)
    some = _settled_together(scored.join(large, "fov_id", "left_semi"))
    return _walked(scored.join(large, "fov_id", "left_anti")).unionByName(some)


def box_candidates(
    a: DataFrame, b: DataFrame, min_iou: float = 0.7, max_dist: float = 10.0
) -> DataFrame:
    """Scored box pairs that pass the overlap and the centroid limit; nuclei without a centroid take no part."""

    def side(df: DataFrame, p: str, label: str) -> DataFrame:
        return df.filter("cy IS NOT NULL").select(
            "fov_id",
            F.col("ne_label").alias(label),
            F.col("ord").alias(f"{p}ord"),
            *_sides(df, p),
            F.col("cy").alias(f"{p}cy"),
            F.col("cx").alias(f"{p}cx"),
        )

    met = _overlapping(side(a, "a_", "ch1_label"), side(b, "b_", "ch2_label"), min_iou)
    dist = magnitude(F.col("a_cy") - F.col("b_cy"), F.col("a_cx") - F.col("b_cx"))
    return (
        met.withColumn("dist", dist)
        .filter(F.col("dist") <= max_dist)
        .select("fov_id", "ch1_label", "a_ord", "ch2_label", "b_ord", "iou", "dist", pair_score("iou", "dist").alias("score"))
    )


def greedy_pair(a: DataFrame, b: DataFrame, min_iou: float = 0.7, max_dist: float = 10.0) -> DataFrame:
    """One-to-one pairing of boxes by overlap and centroid distance."""
    return settle_greedily(box_candidates(a, b, min_iou, max_dist))


def _lines(mask: DataFrame, p: str) -> DataFrame:
    """Pixels of a region as lines: up to 64 neighbours of a row are the bits of one number, with the sums for its centre.

    Regions that lie together are drawn together before the shuffle, so it carries lines, not pixels.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("x", F.lit(64)).cast("int"))
    drawn = mask.groupBy("fov_id", F.col("ne_label").alias(f"{p}label"), "y", F.floor(F.col("x") / 64).alias("_cell"))
    lines = drawn.agg(F.bit_or(bit).alias(f"{p}bits"), F.count("*").alias(f"{p}n"), F.sum("x").alias(f"{p}x"), F.count("x").alias(f"{p}nx"))
    return lines.withColumn(f"{p}y", F.col("y") * F.col(f"{p}n")).withColumn(f"{p}ny", F.when(F.col("y").isNotNull(), F.col(f"{p}n")).otherwise(F.lit(0)))


def mask_candidates(a: DataFrame, b: DataFrame, min_iou: float = 0.7, max_dist: float = 10.0) -> DataFrame:
    """Scored pairs of labelled regions by shared pixels and centroid distance."""

    lines_a, lines_b = apart(cut(_lines(a, "a_"))), apart(cut(_lines(b, "b_")))

    def regions(lines: DataFrame, p: str) -> DataFrame:
        mean = {c: (F.sum(f"{p}{c}") / F.nullif(F.sum(f"{p}n{c}"), F.lit(0))).alias(f"{p}c{c}") for c in ("y", "x")}
        return lines.groupBy("fov_id", f"{p}label").agg(F.sum(f"{p}n").alias(f"{p}area"), *mean.values())

    repeated = [lines.filter(F.col(f"{p}n") != F.bit_count(f"{p}bits")) for lines, p in ((lines_a, "a_"), (lines_b, "b_"))]
    if all(r.isEmpty() for r in repeated):
        both_lit = F.bit_count(F.col("a_bits").bitwiseAND(F.col("b_bits"))).cast("long")
        met = lines_a.join(lines_b, ["fov_id", "y", "_cell"]).select("fov_id", "a_label", "b_label", both_lit.alias("_n")).filter("_n > 0")
        shared = met.groupBy("fov_id", "a_label", "b_label").agg(F.sum("_n").alias("inter"))
    else:
        # a pixel that a region names twice counts twice, which a bit cannot say
        shared = (
            a.select("fov_id", "y", "x", F.col("ne_label").alias("a_label"))
            .join(b.select("fov_id", "y", "x", F.col("ne_label").alias("b_label")), ["fov_id", "y", "x"])
            .groupBy("fov_id", "a_label", "b_label")
            .agg(F.count("*").alias("inter"))
        )
    both = shared.join(regions(lines_a, "a_"), ["fov_id", "a_label"]).join(regions(lines_b, "b_"), ["fov_id", "b_label"])
    iou = F.col("inter") / (F.col("a_area") + F.col("b_area") - F.col("inter"))
    dist = magnitude(F.col("a_cy") - F.col("b_cy"), F.col("a_cx") - F.col("b_cx"))
    return (
        both.select("fov_id", "a_label", "b_label", iou.alias("iou"), dist.alias("dist"))
        .filter((F.col("iou") >= min_iou) & (F.col("dist") <= max_dist))
        .select(
            "fov_id",
            F.col("a_label").cast("string").alias("ch1_label"),
            F.col("a_label").alias("a_ord"),
            F.col("b_label").cast("string").alias("ch2_label"),
            F.col("b_label").alias("b_ord"),
            "iou",
            "dist",
            pair_score("iou", "dist").alias("score"),
        )
    )


def mask_pair(a: DataFrame, b: DataFrame, min_iou: float = 0.7, max_dist: float = 10.0) -> DataFrame:
    """One-to-one pairing of labelled regions."""
    return settle_greedily(mask_candidates(a, b, min_iou, max_dist))


def filter_by_pairs(ch1: DataFrame, ch2: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of both channels that the pair map names, in fields that both channels have."""
    fields = ch1.select("fov_id").distinct().join(ch2.select("fov_id").distinct(), "fov_id", "left_semi")
    known = pairs.join(fields, "fov_id", "left_semi")
    keep1 = ch1.join(known.select("fov_id", F.col("ch1_label").alias("ne_label")), ["fov_id", "ne_label"], "left_semi")
    keep2 = ch2.join(known.select("fov_id", F.col("ch2_label").alias("ne_label")), ["fov_id", "ne_label"], "left_semi")
    return keep1.withColumn("channel", F.lit("ch1")).unionByName(keep2.withColumn("channel", F.lit("ch2")))
