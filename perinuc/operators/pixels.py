"""Pixel tables: means, slices, calibration, labels, boxes, crops, shifts between images.

Stacks are dense, one row per ``frame, y, x``; masks hold labelled pixels only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perinuc.operators.curves import islands
from perinuc.operators.raster import starts
from perinuc.operators.regions import label_regions  # noqa: F401
from perinuc.scale import cut, join_nulls, running_sum, with_key

PIXEL = ["y", "x"]


def frame_mean(stack: DataFrame, by: Sequence[str], start: int = 0, end: int | None = None) -> DataFrame:
    """Mean image over the frames of a half-open range."""
    f = F.col("frame")
    used = stack.filter((f >= start) & (f < end)) if end is not None else stack.filter(f >= start)
    return used.groupBy(*by, *PIXEL).agg(F.avg("value").alias("value"))


def relative_mean(image: DataFrame, by: Sequence[str]) -> DataFrame:
    """Image divided by its largest value."""
    top = image.groupBy(*by).agg(F.max("value").alias("_max"))
    return image.join(top, list(by)).select(*by, *PIXEL, (F.col("value") / F.col("_max")).alias("value"))


def slice_means(stack: DataFrame, by: Sequence[str], start: int, end: int, k: int) -> DataFrame:
    """Mean image of every ``k`` frames, named ``slice_1``, ``slice_2``, ..."""
    f = F.col("frame")
    number = F.floor((f - start) / k) + 1
    used = stack.filter((f >= start) & (f < end))
    return used.groupBy(*by, F.concat(F.lit("slice_"), number.cast("string")).alias("slice_id"), *PIXEL).agg(
        F.avg("value").alias("value")
    )


def threshold_mask(pixels: DataFrame, limit: float) -> DataFrame:
    """Pixels at or above the limit."""
    return pixels.filter(F.col("value") >= limit)


def camera_gain(calibration: DataFrame, by: Sequence[str] = (), bins: int = 100) -> DataFrame:
    """Gain, offset and dark noise from a bright and a dark stack.

    Frames are scaled to the first one, then the variance of each pixel is set against its mean in equal bins,
    and a line is fitted through the bin means with weights applied to the residuals.
    """
    given = list(by)
    stack, by = with_key(calibration, by)
    dark = stack.groupBy(*by).agg(F.avg("dark").alias("offset"), F.var_pop("dark").alias("_dark_var"))
    levels = stack.join(dark, by).withColumn("_v", F.col("bright") - F.col("offset"))
    frames = levels.groupBy(*by, "frame").agg(F.avg("_v").alias("_mean"))
    first = frames.groupBy(*by).agg(F.min_by("_mean", "frame").alias("_first"))
    factor = frames.join(first, by).select(*by, "frame", (F.col("_first") / F.col("_mean")).alias("_factor"))
    steady = levels.join(factor, [*by, "frame"]).withColumn("_v", F.col("_v") * F.col("_factor"))
    points = steady.groupBy(*by, *PIXEL).agg(F.avg("_v").alias("m"), F.var_pop("_v").alias("v"))
    span = points.groupBy(*by).agg(F.min("m").alias("_lo"), F.max("m").alias("_hi"), F.count("*").alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    bin_id = F.least(F.floor((F.col("m") - F.col("_lo")) / width), F.lit(bins - 1))
    binned = points.join(span, by).groupBy(*by, "_lo", "_n", width.alias("_w"), bin_id.alias("_bin")).agg(
        F.avg("v").alias("_y"), F.count("*").alias("_c")
    )
    w = F.pow(F.col("_c") / F.col("_n"), F.lit(2))
    x = F.col("_lo") + (F.col("_bin") + 0.5) * F.col("_w")
    s = binned.groupBy(*by).agg(
        F.sum(w).alias("s0"), F.sum(w * x).alias("s1"), F.sum(w * x * x).alias("s2"),
        F.sum(w * F.col("_y")).alias("t0"), F.sum(w * x * F.col("_y")).alias("t1"), F.count("*").alias("n_bins"),
    )
    slope = (F.col("s0") * F.col("t1") - F.col("s1") * F.col("t0")) / (F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1"))
    line = s.select(*by, "n_bins", slope.alias("slope"), ((F.col("t0") - slope * F.col("s1")) / F.col("s0")).alias("intercept"))
    gain = F.lit(1.0) / F.col("slope")
    return line.join(dark, by).select(
        *given, "n_bins", "slope", "intercept", gain.alias("gain"), "offset", (gain * F.sqrt("_dark_var")).alias("dk_noise")
    )


# ---- labels -------------------------------------------------------------------------------

MASK = ["fov_id", "channel"]


def qc_labels(mask: DataFrame, by: Sequence[str] = MASK, least: int = 75) -> DataFrame:
    """Labels other than background with enough pixels."""
    sizes = mask.filter("ne_label <> 0").groupBy(*by, "ne_label").agg(F.count("*").alias("n_pixels"))
    return sizes.filter(F.col("n_pixels") >= least)


def crop_boxes(mask: DataFrame, by: Sequence[str], width: int, height: int, img_width: int, img_height: int) -> DataFrame:
    """Box of fixed size around the middle of each label, rounded up and clipped to the image."""
    ends = mask.groupBy(*by, "ne_label").agg(
        F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.min("x").alias("_x0"), F.max("x").alias("_x1")
    )

    def edge(lo: str, hi: str, half: float, dim: int) -> Column:
        at = F.ceil((F.col(lo) + F.col(hi)) / 2.0 + half)
        return F.least(F.greatest(at, F.lit(0)), F.lit(dim)).cast("long")

    top, bottom = edge("_y0", "_y1", -height / 2, img_height), edge("_y0", "_y1", height / 2, img_height)
    left, right = edge("_x0", "_x1", -width / 2, img_width), edge("_x0", "_x1", width / 2, img_width)
    return ends.select(
        *by, "ne_label", F.lit(height).alias("height"), F.lit(width).alias("width"), top.alias("final_top"), left.alias("final_left"),
        F.greatest(top, bottom).alias("final_bottom"), F.greatest(left, right).alias("final_right"),
    )


def centroids(mask: DataFrame, by: Sequence[str] = MASK) -> DataFrame:
    """Mean position of each label."""
    return mask.groupBy(*by, "ne_label").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))


# pixels of a row that one number holds, a bit each
BITS = 32


def _marks(at: Column) -> Column:
    """A pixel and its two neighbours in a row as ``part, bits``: one row, or two where they lie in two parts."""
    part, place = F.floor(at / BITS).cast("long"), F.pmod(at, F.lit(BITS)).cast("int")
    # one bit below and one above the part's own
    wide = F.call_function("shiftleft", F.lit(7).cast("long"), place)
    own = F.shiftright(wide, 1).bitwiseAND(F.lit((1 << BITS) - 1))

    def mark(p: Column, bits: Column) -> Column:
        return F.struct(p.alias("part"), bits.alias("bits"))

    low = F.when(place == 0, mark(part - 1, F.lit(1 << (BITS - 1)).cast("long")))
    high = F.when(place == BITS - 1, mark(part + 1, F.lit(1).cast("long")))
    return F.explode(F.array_compact(F.array(mark(part, own), low, high)))


def dilate3x3(mask: DataFrame, by: Sequence[str], height: int, width: int) -> DataFrame:
    """Grow labels by one pixel in all eight directions, inside the image.

    Rows of pixels are held as bits: first each row grows to both sides, then into the rows beside it, so a label's rows are
    shuffled and not nine copies of its pixels.
    """
    keys = [*by, "ne_label"]
    kinds = dict(mask.dtypes)
    place = mask.filter("y IS NOT NULL AND x IS NOT NULL").select(*keys, F.col("y").cast("long").alias("y"), _marks(F.col("x")).alias("_m"))
    rows = place.groupBy(*keys, "y", F.col("_m.part").alias("_part")).agg(F.bit_or("_m.bits").alias("_bits"))
    beside = rows.select(*keys, "_part", "_bits", F.explode(F.array(*[F.col("y") + a for a in (-1, 0, 1)])).alias("y"))
    grown = beside.filter(F.col("y").between(0, height - 1)).groupBy(*keys, "y", "_part").agg(F.bit_or("_bits").alias("_bits"))
    each = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit("_bits", i) == 1)
    dots = grown.select(*keys, "y", "_part", F.explode(each).alias("_i")).withColumn("x", F.col("_part") * BITS + F.col("_i"))
    return dots.filter(F.col("x").between(0, width - 1)).select(*keys, *[F.col(c).cast(kinds[c]).alias(c) for c in PIXEL])


def clear_border(regions: DataFrame, by: Sequence[str], height: int, width: int) -> DataFrame:
    """Drop the regions that touch an edge of the image."""
    edge = (F.col("y") <= 0) | (F.col("x") <= 0) | (F.col("y") >= height - 1) | (F.col("x") >= width - 1)
    # labels are compared with labels, so that only one row of each takes part
    inside = regions.groupBy(*by, "ne_label").agg(F.max(edge).alias("_edge")).filter("NOT _edge").drop("_edge")
    # a task holds the labels of its partition, so that pixels need no sort; a label is one row, however many pixels it has
    return regions.hint("shuffle_hash").join(inside.hint("shuffle_hash"), [*by, "ne_label"], "left_semi")


def masked_intensity(mask: DataFrame, image: DataFrame, by: Sequence[str]) -> DataFrame:
    """Image values under the mask; 0 where the image has none."""
    return mask.join(image.select(*by, *PIXEL, "value"), [*by, *PIXEL], "left").select(
        *mask.columns, F.coalesce("value", F.lit(0.0)).alias("value")
    )


def on_mask_segments(
    points: DataFrame, mask: DataFrame, keys: Sequence[str], image: Sequence[str], height: int, width: int, least: int = 4
) -> DataFrame:
    """Runs of curve points that lie on the mask, numbered in order; short runs keep their number but are dropped."""

    def cell(c: str, dim: int) -> Column:
        return F.least(F.greatest(F.rint(c), F.lit(0.0)), F.lit(float(dim - 1))).cast("long")

    placed = points.select(*keys, "idx", cell("y", height).alias("_y"), cell("x", width).alias("_x"))
    covered = mask.select(*image, F.col("y").alias("_y"), F.col("x").alias("_x"), F.lit(True).alias("_on")).distinct()
    flags = placed.join(covered, [*image, "_y", "_x"], "left").select(*keys, "idx", F.coalesce("_on", F.lit(False)).alias("flag"))
    runs = islands(flags, keys)
    name = F.concat(F.lit("segment_"), F.format_string("%02d", F.col("run") - 1))
    long_enough = F.col("stop") - F.col("start") + 1 >= least
    return runs.filter(long_enough).select(*keys, name.alias("segment"), "start", "stop")


# ---- crops --------------------------------------------------------------------------------


def crop(
    pixels: DataFrame, boxes: DataFrame, by: Sequence[str], extra: Sequence[str] = (), cell: int = 75, lists: bool = False
) -> DataFrame:
    """Pixels inside each half-open box in the box's own coordinates; box and pixel meet in a grid cell.

    With ``lists`` a row per box and strip of the image with its pixels in a list, see ``_crop_lists``.
    """
    if lists:
        return _crop_lists(pixels, boxes, by)

    def cells(lo: str, hi: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(lo) / cell).cast("long"), F.floor((F.col(hi) - 1) / cell).cast("long")))

    real = boxes.filter((F.col("final_bottom") > F.col("final_top")) & (F.col("final_right") > F.col("final_left")))
    spread = real.withColumn("_cy", cells("final_top", "final_bottom")).withColumn("_cx", cells("final_left", "final_right"))
    placed = pixels.withColumn("_cy", F.floor(F.col("y") / cell).cast("long")).withColumn("_cx", F.floor(F.col("x") / cell).cast("long"))
    inside = (
        (F.col("y") >= F.col("final_top")) & (F.col("y") < F.col("final_bottom"))
        & (F.col("x") >= F.col("final_left")) & (F.col("x") < F.col("final_right"))
    )
    met = placed.join(spread, [*by, "_cy", "_cx"]).filter(inside)
    return met.select(
        *by, "ne_label", *extra, (F.col("y") - F.col("final_top")).alias("y"), (F.col("x") - F.col("final_left")).alias("x"), "value"
    )


EDGES = ["final_top", "final_left", "final_bottom", "final_right"]
# rows of an image that make a strip, and boxes that meet one copy of a strip
STRIP, CROWD = 128, 100_000


def _crop_lists(pixels: DataFrame, boxes: DataFrame, by: Sequence[str]) -> DataFrame:
    """A row per box and strip of image rows that it touches, one at least: its edges and its pixels as lists ``y``, ``x``, ``value``.

    A strip holds its rows over the whole width, so a line of a crop lies in one strip and is complete there: an image is
    shuffled once, and what its boxes copy from it is not.  A task reads a strip's pixels first and then its boxes.

    Boxes of one name hold the pixels of all of them.  ``first`` and ``last`` are the rows of the box that a strip decides on,
    without an end where no strip is before or behind; both are null where a name has boxes at several places, whose strips
    are to be brought together by ``copy`` first.
    """
    names, whole = [*by, "ne_label"], dict(pixels.dtypes)["value"] in WHOLE
    kind = "long" if whole else "double"

    def strip(at: Column) -> Column:
        return F.floor(at / STRIP).cast("long")

    # names with a null meet no pixels and none of each other
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names])
    rows = boxes.select(*names, *[F.col(c).cast("long").alias(c) for c in EDGES]).withColumn("_apart", F.when(~known, F.xxhash64(*EDGES)))
    same = rows.repartition(*names, "_apart").groupBy(*names, "_apart", *EDGES).agg(F.count("*").alias("_n"))
    named = same.groupBy(*names, "_apart").agg(F.collect_list(F.struct(*EDGES, "_n")).alias("_boxes"))
    real = F.filter(
        F.when(known, F.col("_boxes")).otherwise(F.array()),
        lambda b: (b["final_bottom"] > b["final_top"]) & (b["final_right"] > b["final_left"]),
    )
    each = named.withColumn("_real", real).withColumn("_box", F.explode("_boxes")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "_box._n")))
    each = each.select(*names, "_box", "copy", (F.size("_real") <= 1).alias("_alone"), F.explode_outer("_real").alias("_of"))
    top, bottom = F.col("_of.final_top"), F.col("_of.final_bottom")
    spread = each.withColumn("_strip", F.explode_outer(F.sequence(strip(top), strip(bottom - 1))))
    start = F.col("_strip") * STRIP - top
    first = F.when(F.coalesce(start <= 0, F.lit(True)), F.lit(-NO_END)).otherwise(start)
    last = F.when(F.coalesce(start + STRIP >= bottom - top, F.lit(True)), F.lit(NO_END)).otherwise(start + STRIP)
    nowhere = F.xxhash64(*names, "copy", *[f"_box.{c}" for c in EDGES])
    two = spread.select(
        *by, F.coalesce("_strip", nowhere).alias("_strip"), "ne_label",
        F.struct(
            *[F.col(f"_box.{c}").alias(c) for c in EDGES], "copy", F.when(F.col("_alone"), first).alias("first"), F.when(F.col("_alone"), last).alias("last"),
            *[F.coalesce(F.col(f"_of.{c}"), F.lit(0)).cast("long").alias(f"_{c}") for c in [*EDGES, "_n"]],
        ).alias("_box"),
    )
    nothing, label = F.lit(None), dict(boxes.dtypes)["ne_label"]
    one = pixels.dropna(subset=[*by, *PIXEL]).select(
        *by, strip(F.col("y")).alias("_strip"), nothing.cast(label).alias("ne_label"), nothing.cast(two.schema["_box"].dataType).alias("_box"),
        *[F.col(c).cast("double" if dict(pixels.dtypes)[c] in ("float", "double") else "long").alias(c) for c in PIXEL],
        F.coalesce("value", F.lit(0)).cast(kind).alias("value"),
    )
    # a strip with very many boxes is copied, so that they spread over tasks
    at, placed = [*by, "_strip"], F.count_if(F.col("_box.first").isNull())
    crowded = two.groupBy(*at).agg(F.count("*").alias("_many"), placed.alias("_placed")).filter((F.col("_many") > CROWD) | (F.col("_placed") > 0))
    odd = cut(crowded.select(*at, F.ceil(F.col("_many") / CROWD).cast("int").alias("_copies"), "_placed"))
    any_crowded, any_placed = odd.agg(F.max(F.col("_copies") > 1), F.max(F.col("_placed") > 0)).first()
    copies = odd.filter("_copies > 1").drop("_placed")
    if not any_crowded:
        one, two = one.withColumn("_copy", F.lit(0)), two.withColumn("_copy", F.lit(0))
    else:
        many = F.coalesce("_copies", F.lit(1))
        one = one.join(copies, at, "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), many - 1))).drop("_copies")
        two = two.join(copies, at, "left").withColumn("_copy", F.pmod(F.xxhash64("ne_label", "_box"), many).cast("int")).drop("_copies")
    group = [*at, "_copy"]
    dealt = one.unionByName(two, allowMissingColumns=True).select(*group, "ne_label", "_box", *PIXEL, "value")
    # pixels first
    dealt = dealt.repartition(*group).sortWithinPartitions(*group, F.col("_box").isNotNull())

    def cropped(dots: list[np.ndarray], part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Pixels of boxes out of those of the strip, which are in the order of ``x``."""
        y, x, value = dots
        box = dict(zip([f.name for f in part.schema.field("_box").type], part.column("_box").flatten()))
        top, left, bottom, right, n = (box[f"_{c}"].to_numpy() for c in [*EDGES, "_n"])
        low, high = np.searchsorted(x, left), np.searchsorted(x, right)
        seen = np.maximum(high - low, 0)
        at = 0
        while at < part.num_rows:
            step = max(1, int(np.searchsorted(np.cumsum(seen[at:]), PADDED, side="right")))
            some = slice(at, at + step)
            of = np.repeat(np.arange(at, min(at + step, part.num_rows)), seen[some])
            dot = np.arange(len(of)) - np.repeat(np.cumsum(seen[some]) - seen[some] - low[some], seen[some])
            inside = (y[dot] >= top[of]) & (y[dot] < bottom[of])
            of, dot = of[inside], dot[inside]
            cuts = pa.array(np.searchsorted(of, np.arange(at, min(at + step, part.num_rows) + 1)).astype(np.int32))
            lists = [(y[dot] - top[of]).astype(np.int64), (x[dot] - left[of]).astype(np.int64), value[dot] * n[of]]
            keys = part.slice(at, step).select(names).columns
            kept = [box[c].slice(at, step) for c in [*EDGES, "copy", "first", "last"]]
            yield pa.RecordBatch.from_arrays([*keys, *kept, *[pa.ListArray.from_arrays(cuts, pa.array(v)) for v in lists]], made)
            at += step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, dots, ordered = None, [], False
        for batch in batches:
            opens = np.flatnonzero(starts(batch, group))
            boxed = batch.column("_box").is_valid().to_numpy(zero_copy_only=False)
            columns = [batch.column(c) for c in (*PIXEL, "value")]
            for a, b in zip(opens.tolist(), [*opens[1:].tolist(), batch.num_rows]):
                name = tuple(batch.column(c)[a].as_py() for c in group)
                if name != held:
                    held, ordered = name, False
                    dots = [[np.zeros(0, np.int64 if c.type == pa.int64() else np.float64)] for c in columns]
                split = a + int(np.searchsorted(boxed[a:b], True))
                if split > a:
                    for c, kept in zip(columns, dots):
                        kept.append(c.slice(a, split - a).to_numpy())
                if split < b:
                    if not ordered:
                        dots = [np.concatenate(c) for c in dots]
                        order, ordered = np.argsort(dots[1], kind="stable"), True
                        dots = [c[order] for c in dots]
                    yield from cropped(dots, batch.slice(split, b - split))

    kinds = dict(boxes.dtypes)
    made = [*names, *EDGES, "copy", "first", "last", *PIXEL, "value"]
    # a plan without names at several places needs no second pass for them
    longs = ", ".join([*[f"{c} long" for c in [*EDGES, "copy"]], *[f"{c} long{'' if any_placed else ' NOT NULL'}" for c in ("first", "last")]])
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in names], longs, f"y array<long>, x array<long>, value array<{kind}>"])
    return dealt.mapInArrow(run, schema)


# kinds of whole numbers, and a row beyond every image
WHOLE, NO_END = ("tinyint", "smallint", "int", "bigint"), 1 << 40


def _sizes(height: int, width: int) -> list[Column]:
    """Of a box: the border before its crop and the size of its padded image."""
    have_h, have_w = F.col("final_bottom") - F.col("final_top"), F.col("final_right") - F.col("final_left")

    def before(want: int, have: Column) -> Column:
        return F.floor(F.greatest(F.lit(want) - have, F.lit(0)) / 2).cast("long")

    def full(want: int, have: Column) -> Column:
        return F.greatest(F.lit(want), have).cast("long")

    return [before(height, have_h).alias("_py"), before(width, have_w).alias("_px"), full(height, have_h).alias("_h"), full(width, have_w).alias("_w")]


def _padded_boxes(crops: DataFrame, boxes: DataFrame, by: Sequence[str], height: int, width: int) -> DataFrame:
    """A row per box: size of its padded image, width of the border before its crop, and the pixels it has."""
    # a box is one row until its image is unfolded: what it has, and 0 at every other place
    held = crops.filter("y IS NOT NULL AND x IS NOT NULL").groupBy(*by, "ne_label").agg(
        F.collect_list(F.struct(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "value")).alias("_have")
    )
    return boxes.select(*by, "ne_label", *_sizes(height, width)).join(held, [*by, "ne_label"], "left")


def _padded_lists(lists: DataFrame, by: Sequence[str], height: int, width: int) -> DataFrame:
    """``_padded_boxes`` from the lists of ``crop``, a row per box and strip with the lines it has from ``_from`` to ``_to``."""
    names, box, dots = [*by, "ne_label"], ["_py", "_px", "_h", "_w"], [*PIXEL, "value"]
    alone = lists.filter("first IS NOT NULL").select(*names, *_sizes(height, width), "first", "last", *dots)
    low, high = F.greatest(F.col("first") + F.col("_py"), F.lit(0)), F.least(F.col("last") + F.col("_py"), F.col("_h"))
    alone = alone.select(*names, *box, low.alias("_from"), high.alias("_to"), *dots).filter("_from < _to")
    joined = lists.filter("first IS NULL").groupBy(*names, *EDGES, "copy").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in dots])
    shared = joined.select(*names, *_sizes(height, width), F.lit(0).cast("long").alias("_from"), *dots).withColumn("_to", F.col("_h"))
    return alone.unionByName(shared)


# pixels of padded images that a task holds at a time, one image at least
PADDED = 1_000_000


def _joined(values: np.ndarray, cuts: np.ndarray, sep: str) -> pa.Array:
    """A text for each stretch of whole numbers between two cuts.

    Zeros and separators take turns, in two bytes a number; only longer numbers and the ends of texts move what follows.
    """
    full = np.flatnonzero(values != 0)
    spelled = pc.cast(pa.array(values[full]), pa.string())
    ends = np.frombuffer(spelled.buffers()[1], np.int32, len(full) + 1).astype(np.int64)
    digits = np.frombuffer(spelled.buffers()[2] or b"", np.uint8)[: ends[-1]]
    lengths = np.diff(ends)
    ended = np.zeros(len(values), bool)
    ended[cuts[1:][np.diff(cuts) > 0] - 1] = True
    more = -ended.astype(np.int8)
    more[full] += (lengths - 1).astype(np.int8)
    odd = np.flatnonzero(more != 0)
    moved = np.append(0, np.cumsum(more[odd], dtype=np.int64))

    def start(at: np.ndarray) -> np.ndarray:
        return 2 * at + moved[np.searchsorted(odd, at)]

    bounds = start(cuts.astype(np.int64))
    size = int(bounds[-1])
    text = np.repeat((moved & 1).astype(np.uint8), np.diff(np.concatenate([[0], 2 * odd + 2 + moved[1:], [size]])))
    text[1::2] ^= 1
    # 0 and 1 become the characters, in place
    text *= np.uint8((ord(sep) - ord("0")) % 256)
    text += np.uint8(ord("0"))
    at = start(full)
    text[np.repeat(at - ends[:-1], lengths) + np.arange(len(digits))] = digits
    text[(at + lengths)[~ended[full]]] = ord(sep)
    return pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(text))


def pad_lines(crops: DataFrame, boxes: DataFrame, by: Sequence[str], height: int, width: int, sep: str | None = None) -> DataFrame:
    """Full images as by ``pad_crops``, a row per line of an image with all its ``values`` from left to right.

    Values are whole numbers or doubles; several values of one pixel are added up, as shares of the same place are.
    ``crops`` are rows or lists of ``crop``; lists hold the boxes too, and are drawn where they are.  With ``sep``, one
    character, the values of a line are a text of whole numbers.
    """
    names, kinds = [*by, "ne_label"], dict(crops.dtypes)
    whole = kinds["value"].removeprefix("array<").removesuffix(">") in WHOLE
    if sep is not None and not whole:
        raise ValueError("only whole numbers are joined to texts")
    if kinds["value"].startswith("array"):
        held = _padded_lists(crops, by, height, width)
    else:
        held = _padded_boxes(crops.withColumn("value", F.col("value").cast("long" if whole else "double")), boxes, by, height, width)
        held = held.select(*names, "_py", "_px", "_h", "_w", *[F.col(f"_have.{c}").alias(c) for c in (*PIXEL, "value")])
        held = held.withColumn("_from", F.lit(0).cast("long")).withColumn("_to", F.col("_h"))
    kind = np.int64 if whole else np.float64

    def drawn(part: pa.RecordBatch) -> pa.RecordBatch:
        py, px, w, low, high = (part.column(c).to_numpy() for c in ("_py", "_px", "_w", "_from", "_to"))
        h, box = high - low, pc.list_parent_indices(part.column("y")).to_numpy()
        y, x = (part.column(c).flatten().to_numpy() + shift[box] for c, shift in (("y", py - low), ("x", px)))
        value = pc.fill_null(part.column("value").flatten(), 0).to_numpy()
        inside = (y >= 0) & (y < h[box]) & (x >= 0) & (x < w[box])
        first = np.cumsum(h * w) - h * w
        images = np.zeros(int((h * w).sum()), kind)
        np.add.at(images, (first[box] + y * w[box] + x)[inside], value[inside].astype(kind))
        of = np.repeat(np.arange(len(h)), h)
        line = np.arange(len(of)) - np.repeat(np.cumsum(h) - h - low, h)
        cuts = np.r_[0, np.cumsum(w[of])].astype(np.int32)
        rows = part.select(names).take(pa.array(of))
        values = pa.ListArray.from_arrays(pa.array(cuts), pa.array(images)) if sep is None else _joined(images, cuts, sep)
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(line), values], [*names, "y", "values"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            area = (batch.column("_to").to_numpy() - batch.column("_from").to_numpy()) * batch.column("_w").to_numpy()
            at = 0
            while at < batch.num_rows:
                n = max(1, int(np.searchsorted(np.cumsum(area[at:]), PADDED, side="right")))
                yield drawn(batch.slice(at, n))
                at += n

    values = "string" if sep is not None else f"array<{'long' if whole else 'double'}>"
    schema = ", ".join([*[f"`{k}` {dict(held.dtypes)[k]}" for k in names], "y long", f"values {values}"])
    return held.mapInArrow(run, schema)


def pad_crops(crops: DataFrame, boxes: DataFrame, by: Sequence[str], height: int, width: int) -> DataFrame:
    """Full images of the wanted size: the crop in the middle (half of the missing rows first), 0 around it."""
    kind = dict(crops.dtypes)["value"]
    sized = _padded_boxes(crops, boxes, by, height, width)

    def pixel(at: Column, value: Column) -> Column:
        return F.struct(at.alias("at"), value.cast(kind).alias("value"))

    empty = F.array().cast(f"array<struct<y:bigint,x:bigint,value:{kind}>>")
    inside = F.filter(
        F.coalesce("_have", empty),
        lambda p: p["y"].between(-F.col("_py"), F.col("_h") - F.col("_py") - 1) & p["x"].between(-F.col("_px"), F.col("_w") - F.col("_px") - 1),
    )
    moved = F.transform(
        inside, lambda p: pixel((p["y"] + F.col("_py")) * F.col("_w") + p["x"] + F.col("_px"), F.coalesce(p["value"], F.lit(0)))
    )
    rest = F.array_except(F.sequence(F.lit(0).cast("long"), F.col("_h") * F.col("_w") - 1), F.transform("_have", lambda p: p["at"]))
    whole = F.concat("_have", F.transform(rest, lambda at: pixel(at, F.lit(0))))
    each = sized.withColumn("_have", moved).select(*by, "ne_label", "_w", F.explode(whole).alias("_p"))
    return each.select(
        *by, "ne_label", F.floor(F.col("_p.at") / F.col("_w")).alias("y"), F.pmod("_p.at", "_w").alias("x"), "_p.value"
    )


# ---- shifts -------------------------------------------------------------------------------


# Side of the square tiles in which two images are compared.
SHIFT_TILE = 64


def _tile_products(pixels: pa.Table, keys: list[str], reach: int) -> pa.Table:
    """Product sums of one tile of the first image with the second one at every shift, by one pair of transforms.

    The second image has a border as wide as the reach, so no shift within it wraps around.  The same transforms of where
    there are pixels tell the shifts at which any two meet.
    """
    top, left = (pixels.column(c)[0].as_py() * SHIFT_TILE for c in ("_ty", "_tx"))
    side, y, x, value = (pixels.column(c).to_numpy() for c in ("_side", "y", "x", "value"))
    wide = SHIFT_TILE + 2 * reach
    images = np.zeros((2, 2, wide, wide))  # first and second image; values and where there is a pixel
    for number, border in ((0, 0), (1, reach)):
        at = side == number
        place = y[at] - top + border, x[at] - left + border
        images[(number, 0, *place)] = value[at]
        images[(number, 1, *place)] = 1.0
    turned = np.fft.rfft2(images)
    # entry (i, j): the second image moved by reach - i rows and reach - j columns
    score, shared = np.fft.irfft2(np.conj(turned[0]) * turned[1], s=(wide, wide))[:, : 2 * reach + 1, : 2 * reach + 1]
    i, j = np.nonzero(shared > 0.5)
    out = pixels.select(keys).take(pa.array(np.zeros(len(i), np.int64)))
    for name, kind, values in zip(("dy", "dx", "score"), (pa.int64(), pa.int64(), pa.float64()), (reach - i, reach - j, score[i, j])):
        out = out.append_column(name, pa.array(values, kind))
    return out


def shift_scores(a: DataFrame, b: DataFrame, keys: Sequence[str], reach: int = 5) -> DataFrame:
    """Normalised product sum of two images for every shift of the second, means removed.

    The images are cut into tiles, the second one with a border as wide as the reach, so little more than the pixels
    themselves is shuffled; all shifts of a tile come out of one pair of Fourier transforms, whatever the reach.
    """
    keys = list(keys)

    def centred(image: DataFrame, side: int) -> DataFrame:
        level = image.groupBy(*keys).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"), F.count("*").alias("_n"))
        norm = (F.col("value") - F.col("_m")) / (F.col("_s") * F.sqrt("_n"))
        place = [F.col(c).cast("long").alias(c) for c in PIXEL]
        return image.join(level, keys).filter("_s > 0").select(*keys, *place, norm.alias("value"), F.lit(side).alias("_side"))

    def tile(c: str, border: int) -> Column:
        low, high = F.floor((F.col(c) - border) / SHIFT_TILE), F.floor((F.col(c) + border) / SHIFT_TILE)
        return F.explode(F.sequence(low.cast("long"), high.cast("long")))

    one = centred(a, 0).withColumn("_ty", tile("y", 0)).withColumn("_tx", tile("x", 0))
    two = centred(b, 1).withColumn("_ty", tile("y", reach)).withColumn("_tx", tile("x", reach))
    kinds = dict(a.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "dy long", "dx long", "score double"])
    parts = one.unionByName(two).groupBy(*keys, "_ty", "_tx").applyInArrow(lambda rows: _tile_products(rows, keys, reach), schema)
    return parts.groupBy(*keys, "dy", "dx").agg(F.sum("score").alias("score"))


def shift_by_correlation(a: DataFrame, b: DataFrame, keys: Sequence[str], reach: int = 5) -> DataFrame:
    """Shift of the second image that fits the first best, refined by a parabola through its neighbours.

    Equal scores go to the shorter shift, then to the smaller row and column.
    """
    scores = shift_scores(a, b, keys, reach)
    size = F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")
    best = scores.groupBy(*keys).agg(
        F.max(F.struct(F.round("score", 9).alias("score"), (-size).alias("near"), (-F.col("dy")).alias("ny"), (-F.col("dx")).alias("nx"))).alias("_top")
    ).select(*keys, F.col("_top.score").alias("best_score"), (-F.col("_top.ny")).alias("by"), (-F.col("_top.nx")).alias("bx"))
    near = scores.join(best, list(keys)).filter(F.abs(F.col("dy") - F.col("by")) + F.abs(F.col("dx") - F.col("bx")) <= 1)

    def at(oy: int, ox: int) -> Column:
        return F.max(F.when((F.col("dy") == F.col("by") + oy) & (F.col("dx") == F.col("bx") + ox), F.col("score")))

    around = near.groupBy(*keys, "by", "bx", "best_score").agg(
        at(0, 0).alias("c"), at(-1, 0).alias("u"), at(1, 0).alias("d"), at(0, -1).alias("l"), at(0, 1).alias("r")
    )

    def peak(lo: str, hi: str) -> Column:
        bend = F.col(lo) - 2.0 * F.col("c") + F.col(hi)
        return F.when(bend < 0, 0.5 * (F.col(lo) - F.col(hi)) / bend).otherwise(F.lit(0.0))

    return around.select(
        *keys, "best_score",
        (F.col("by") + F.coalesce(peak("u", "d"), F.lit(0.0))).alias("shift_y"),
        (F.col("bx") + F.coalesce(peak("l", "r"), F.lit(0.0))).alias("shift_x"),
    )


def bin_images(stack: DataFrame, by: Sequence[str], bins: int) -> DataFrame:
    """Mean image of each of ``bins`` stretches of frames, and the centre of the stretch."""
    size = stack.groupBy(*by).agg((F.max("frame") + 1).alias("size"))
    sized = stack.join(size, list(by))
    # the stretch that holds a frame, in whole numbers
    number = F.floor(((F.col("frame") + 1) * bins + F.col("size") - 1) / F.col("size")).cast("long") - 1
    width = F.col("size") / F.lit(float(bins))
    return sized.groupBy(*by, number.alias("bin"), ((number + 0.5) * width).alias("center"), *PIXEL).agg(F.avg("value").alias("value"))


def bin_drift(stack: DataFrame, by: Sequence[str], bins: int, reach: int = 5) -> DataFrame:
    """Shift of each stretch against the one before it, summed up from the start."""
    images = bin_images(stack, by, bins)
    before = images.select(*by, (F.col("bin") + 1).alias("bin"), *PIXEL, "value")
    steps = shift_by_correlation(before, images.select(*by, "bin", *PIXEL, "value"), [*by, "bin"], reach)
    every = images.select(*by, F.col("bin").alias("idx"), "center").distinct()
    stepped = join_nulls(every, steps.withColumnRenamed("bin", "idx"), [*by, "idx"], "left").fillna(0.0, ["shift_y", "shift_x"])
    summed = running_sum(running_sum(stepped, by, "idx", "shift_y", "dy"), by, "idx", "shift_x", "dx")
    return summed.select(*by, "idx", "center", "dy", "dx")


def drift_halves(stack: DataFrame, by: Sequence[str], bins: int, reach: int = 5) -> DataFrame:
    """Drift of the even and of the odd frames, whose difference shows the precision."""
    half = F.when(F.col("frame") % 2 == 0, "even").otherwise("odd")
    split = stack.withColumn("half", half).withColumn("frame", F.floor(F.col("frame") / 2).cast("long"))
    return bin_drift(split, [*by, "half"], bins, reach)
