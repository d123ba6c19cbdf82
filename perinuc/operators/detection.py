"""Spots: sliding regions, likelihood ratios, false discovery rate, mask of hits."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perinuc.functions.special import harmonic, two_sided_p
from perinuc.scale import join_nulls, positions, with_key

# Fixed value: a background that varies less than this is replaced by its mean.
FLAT_BACKGROUND_SD = 4.0


# Region starts of one tile: frames, and rows or columns (at least the region's size).
TILE_FRAMES, TILE_SIDE = 4, 16


def _cut_regions(pixels: pa.Table, keys: list[str], t: int, size: int, side: int) -> pa.Table:
    """Regions that start in one tile, from its pixels and those of its border."""
    home = {c: pixels.column(c)[0].as_py() for c in ("_tf", "_ty", "_tx", "_f", "_h", "_w")}
    first = home["_tf"] * TILE_FRAMES, home["_ty"] * side, home["_tx"] * side
    # starts that lie in the tile and leave room for a whole region
    starts = [
        max(0, min(span, home[dim] - reach + 1 - at))
        for at, span, dim, reach in zip(first, (TILE_FRAMES, side, side), ("_f", "_h", "_w"), (t, size, size))
    ]
    kind = pixels.schema.field("value").type
    whole = np.zeros([n + reach - 1 for n, reach in zip((TILE_FRAMES, side, side), (t, size, size))], kind.to_pandas_dtype())
    stored = np.zeros(whole.shape, bool)
    at = tuple(pixels.column(c).to_numpy() - lo for c, lo in zip(("frame", "y", "x"), first))
    whole[at], stored[at] = pixels.column("value").to_numpy(), True
    cut = tuple(slice(0, n) for n in starts)
    regions = sliding_window_view(whole, (t, size, size))[cut]
    known = sliding_window_view(stored, (t, size, size))[cut].any(axis=(3, 4, 5))
    f0, y0, x0 = np.nonzero(known)
    counts = regions[f0, y0, x0].reshape(len(f0), t * size * size)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(f0) + 1, dtype=np.int32) * (t * size * size)), pa.array(counts.ravel(), kind))
    key = pixels.select(keys).take(pa.array(np.zeros(len(f0), np.int64)))
    for name, offset, lo in (("frame", f0, first[0]), ("y0", y0, first[1]), ("x0", x0, first[2])):
        key = key.append_column(name, pa.array(offset.astype(np.int64) + lo))
    return key.append_column("counts", lists)


def sliding_rois(stack: DataFrame, by: Sequence[str], t: int, size: int) -> DataFrame:
    """Every full region of ``t`` frames by ``size`` x ``size`` pixels with its values in frame, row, column order.

    Pixels are gathered once into tiles of region starts with the border that their regions reach into, a few copies
    per pixel whatever the region's size, and regions are cut out of the tile.  A region without any stored pixel is
    left out, absent pixels of others are 0.
    """
    by = list(by)
    dims = stack.groupBy(*by).agg(
        (F.max("frame") + 1).cast("long").alias("_f"), (F.max("y") + 1).cast("long").alias("_h"), (F.max("x") + 1).cast("long").alias("_w")
    )
    side = max(TILE_SIDE, size)

    def tiles_of(c: str, span: int, reach: int) -> Column:
        low = F.greatest(F.col(c) - (reach - 1), F.lit(0).cast("long"))
        return F.explode(F.sequence(F.floor(low / span).cast("long"), F.floor(F.col(c) / span).cast("long")))

    pixels = stack.select(*by, *[F.col(c).cast("long").alias(c) for c in ("frame", "y", "x")], "value").filter("value IS NOT NULL")
    placed = (
        pixels.join(dims, by)
        .withColumn("_tf", tiles_of("frame", TILE_FRAMES, t))
        .withColumn("_ty", tiles_of("y", side, size))
        .withColumn("_tx", tiles_of("x", side, size))
        .filter((F.col("_f") >= t) & (F.col("_h") >= size) & (F.col("_w") >= size))
    )
    kinds = dict(stack.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in by], "frame long", "y0 long", "x0 long", f"counts array<{kinds['value']}>"])
    return placed.groupBy(*by, "_tf", "_ty", "_tx").applyInArrow(lambda rows: _cut_regions(rows, by, t, size, side), schema)


def spot_weights(size: int, sigma: float) -> list[float]:
    """Share of a centred spot per pixel; inside the error function the width counts as 2 sigma^2."""
    at, width = size / 2.0 - 0.5, 2.0 * sigma * sigma
    axis = [0.5 * (math.erf((i - at + 0.5) / width) - math.erf((i - at - 0.5) / width)) for i in range(size)]
    return [a * b for a in axis for b in axis]


def _fit_regions(counts: np.ndarray, background: np.ndarray, spot: np.ndarray, iters: int, flat_sd: float) -> list[np.ndarray]:
    """Photons, background level and likelihood ratio of many regions at once, one row each."""
    flat = background.std(axis=1, ddof=1) < flat_sd
    shape = np.where(flat[:, None], 1.0, background / background.max(axis=1, keepdims=True))
    total, weight = counts.sum(axis=1), shape.sum(axis=1)
    photons, level = total / 2.0, total / (2.0 * weight)
    for _ in range(iters):
        ratio = counts / np.maximum(photons[:, None] * spot + level[:, None] * shape, 1e-12)
        photons, level = photons * (ratio @ spot) / spot.sum(), level * (ratio * shape).sum(axis=1) / weight

    def loglik(mean: np.ndarray) -> np.ndarray:
        return (counts * np.log(np.maximum(mean, 1e-12)) - mean).sum(axis=1)

    with_spot = loglik(photons[:, None] * spot + level[:, None] * shape)
    return [photons, level, 2.0 * (with_spot - loglik((total / weight)[:, None] * shape))]


def roi_llr(
    rois: DataFrame, t: int, size: int, sigma: float, iters: int = 30, flat_sd: float = FLAT_BACKGROUND_SD
) -> DataFrame:
    """Likelihood ratio of spot plus background against background alone, for the middle frame.

    Photons and background level follow a fixed number of multiplicative updates for Poisson counts, over a batch of
    regions at a time.  ``rois`` has ``counts`` and ``background`` (one value per pixel).
    """
    n = size * size
    spot = np.array(spot_weights(size, sigma))
    keep = [c for c in rois.columns if c not in ("counts", "background")]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                middle, back = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(float) for c in ("_n", "background"))
                with np.errstate(all="ignore"):
                    found = _fit_regions(middle.reshape(-1, n), back.reshape(-1, n), spot, iters, flat_sd)
                # a background without any light has no fit
                arrays = [part.column(c) for c in keep] + [pa.array(f, pa.float64(), from_pandas=True) for f in found]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, "photons", "level", "lr"])

    middle = F.slice("counts", (t // 2) * n + 1, n).alias("_n")
    kinds = dict(rois.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "photons double", "level double", "lr double"])
    return rois.select(*keep, middle, "background").mapInArrow(fit, schema)


def fdr(tests: DataFrame, by: Sequence[str], alpha: float, ids: Sequence[str], lr: str = "lr", step_up: bool = False) -> DataFrame:
    """p-values, ranks and significance within each batch of tests.

    Tests are ranked by falling ratio, then by id.  By default each p is held against the threshold of its own rank; ``step_up`` accepts everything up to the
    last rank that passes.  Ranks come from a range shuffle, so a large batch is not sorted in one task.
    """
    given = list(by)
    tests, by = with_key(tests, by)
    # the p-value falls strictly with the ratio above zero, and is not rounded to zero in it
    strength = F.greatest(F.col(lr), F.lit(0.0)).desc_nulls_last()
    ranked = positions(tests.withColumn("p", two_sided_p(lr)), by, [strength, *ids], "_pos")
    ranked = ranked.withColumn("rank", F.col("_pos") + 1).drop("_pos")
    sizes = ranked.groupBy(*by).agg(F.count("*").alias("m"))
    threshold = F.col("rank") / (F.col("m") * harmonic("m")) * alpha
    judged = join_nulls(ranked, sizes, by).withColumn("threshold", threshold)
    own = F.col("p") <= F.col("threshold")
    if not step_up:
        return judged.withColumn("significant", own).drop(*[b for b in by if b not in given])
    last = judged.filter(own).groupBy(*by).agg(F.max("rank").alias("_last"))
    passed = F.coalesce(F.col("rank") <= F.col("_last"), F.lit(False))
    return join_nulls(judged, last, by, "left").withColumn("significant", passed).drop("_last", *[b for b in by if b not in given])


def mask_from_rois(hits: DataFrame, by: Sequence[str], size: int, height: int, width: int) -> DataFrame:
    """Centre pixel of every significant region, held inside the image."""

    def centre(c: str, dim: int) -> Column:
        return F.least(F.greatest(F.col(c) + size // 2, F.lit(0)), F.lit(dim - 1)).cast("long")

    return hits.select(*by, "frame", centre("y0", height).alias("y"), centre("x0", width).alias("x")).distinct()
