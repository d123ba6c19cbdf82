"""Intensity along curve normals: sampling, screening, edge position, fit quality.

Profiles carry key columns, a sample number ``k``, ``dist`` along the line and ``intensity``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perinuc.functions.scalars import eval_model
from perinuc.operators.raster import ENDS, sample_lines, starts
from perinuc.scale import apart, stored

# Screening limits and fit-quality rules.
FLAT_SD = 1e-3
MIN_RANGE = 10.0
BOUNDS_SLACK = 0.1
AIC_GAIN = 10.0
OUTLIER_SIGMAS = 5.0
OUTLIER_SHARE = 0.05


def sample_along_normals(
    pixels: DataFrame, normals: DataFrame, keys: Sequence[str], n: int, height: int, width: int, image: Sequence[str] = ("fov_id",),
    gain: float = 1.0,
) -> DataFrame:
    """``n`` bilinear samples per normal line with the distance walked; lines that leave the image are invalid.

    The values of a pixel are added up, over frames for one, and divided by ``gain``.

    ``normals`` has ``y0, x0, y1, x1``; pixels that are absent count as 0; lines without an image are left out.
    """

    def inside(c: str, dim: int) -> Column:
        return (F.rint(c) >= 0) & (F.rint(c) < dim - 2)

    ok = inside("x0", width) & inside("y0", height) & inside("x1", width) & inside("y1", height)
    known = normals.join(pixels.select(*image).distinct(), list(image), "left_semi")
    # valid and lost lines come from one pass over the curves
    known = stored(known.select(*dict.fromkeys([*image, *keys]), *ENDS, ok.alias("valid")))
    sampled = sample_lines(pixels, known.filter("valid"), image, keys, n, height, width, gain=gain)
    lost = known.filter("NOT valid").select(*keys, F.lit(None).cast("long").alias("k"), F.lit(None).cast("double").alias("dist"),
                                            F.lit(None).cast("double").alias("intensity"), "valid")
    return sampled.withColumn("valid", F.lit(True)).unionByName(lost)


def profile_screen(profiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Why a profile is not worth fitting, in fixed order, with its intensity statistics.

    A profile whose samples are NULL was out of bounds.
    """
    v = F.col("intensity")
    stats = profiles.groupBy(*keys).agg(
        F.max(v).alias("intensity_max"),
        F.min(v).alias("intensity_min"),
        F.avg(v).alias("intensity_mean"),
        F.stddev_pop(v).alias("intensity_std"),
        (F.max(v) - F.min(v)).alias("intensity_range"),
    )
    status = (
        F.when(F.col("intensity_max").isNull(), "skip:out_of_bounds")
        .when(F.col("intensity_std") < FLAT_SD, "skip:degenerate")
        .when(F.round("intensity_range", 9) < MIN_RANGE, "skip:low_contrast")
        .otherwise("unprocessed")
    )
    return stats.withColumn("status", status)


def guess_gaussian_linear(profiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Start values: line through both ends, and the largest rise above it."""
    ends = profiles.groupBy(*keys).agg(
        F.min_by(F.struct("dist", "intensity"), "k").alias("_a"), F.max_by(F.struct("dist", "intensity"), "k").alias("_z")
    )
    slope = (F.col("_z.intensity") - F.col("_a.intensity")) / (F.col("_z.dist") - F.col("_a.dist"))
    lines = ends.withColumn("slope", slope).select(
        *keys, "slope", (F.col("_a.intensity") - F.col("slope") * F.col("_a.dist")).alias("intercept")
    )
    rise = F.col("intensity") - (F.col("slope") * F.col("dist") + F.col("intercept"))
    top = F.max(F.struct(F.round(rise, 9).alias("rise"), (-F.col("k")).alias("first"), F.col("dist")))
    peaks = profiles.join(apart(lines), list(keys)).groupBy(*keys, "slope", "intercept").agg(top.alias("_top"))
    return peaks.select(
        *keys, "slope", "intercept", F.col("_top.dist").alias("mu"), F.lit(1.0).alias("sigma"),
        F.greatest("_top.rise", F.lit(1.0)).alias("amplitude"),
    )


def guess_richards_gaussian(profiles: DataFrame, keys: Sequence[str], length: float, shape: Sequence[float]) -> DataFrame:
    """Start values of the eleven-parameter model; ``shape`` holds B, C, nu, Q and the offset."""
    b, c, nu, q, offset = (F.lit(float(s)) for s in shape)
    lo, hi = F.min("intensity"), F.max("intensity")
    half = F.lit(length / 2.0)
    return profiles.groupBy(*keys).agg(lo.alias("lower"), hi.alias("upper")).select(
        *keys, "lower", "upper", b.alias("rate"), c.alias("c"), nu.alias("nu"), q.alias("q"), half.alias("middle"), half.alias("mu"),
        F.lit(1.0).alias("sigma"), F.greatest(F.col("upper") - F.col("lower"), F.lit(1.0)).alias("amplitude"), offset.alias("offset"),
    )


def predict(profiles: DataFrame, params: DataFrame, keys: Sequence[str], model: str) -> DataFrame:
    """Model value at every sample; ``params`` holds the parameters after the keys, in model order."""
    theta = [c for c in params.columns if c not in keys]
    return profiles.join(apart(params), list(keys)).select(
        *keys, "k", "dist", "intensity", eval_model(model, "dist", theta).alias("predicted")
    )


# Samples of the line that meet the grid at once.
BATCH = 10_000


class _GridSums:
    """Sums over the samples of profiles that follow each other, for each cell of a grid of centres and widths.

    Intensities are taken from the mean of a profile's first samples; ``fits`` moves the sums to the mean of them all.
    """

    def __init__(
        self, t: np.ndarray, y: np.ndarray, has_t: np.ndarray, has_y: np.ndarray, first: np.ndarray, centre: np.ndarray,
        mus: np.ndarray, sigmas: np.ndarray,
    ):
        self.centre, t = centre, np.where(has_t, t, 0.0)
        y = np.where(has_y, y - np.repeat(centre, np.diff([*first, len(y)])), 0.0)
        d = t[:, None] - mus
        g = np.where(has_t[:, None], np.exp(-(d * d) / (2.0 * sigmas * sigmas)), 0.0)
        ones = np.ones(len(t))
        plain = [ones, has_y * ones, t, t * t, y, t * y, y * y, has_y * t]
        self.plain = [np.add.reduceat(c, first)[:, None] for c in plain]
        self.bumps = [np.add.reduceat(c, first, axis=0) for c in (g, g * t[:, None], g * g, g * y[:, None], g * has_y[:, None])]

    def part(self, rows: slice) -> _GridSums:
        out = object.__new__(_GridSums)
        out.centre, out.plain, out.bumps = self.centre[rows], [c[rows] for c in self.plain], [c[rows] for c in self.bumps]
        return out

    def add_first(self, other: _GridSums) -> None:
        """Add the earlier samples of the first profile, taken from the same centre."""
        for mine, theirs in zip([*self.plain, *self.bumps], [*other.plain, *other.bumps]):
            mine[0] += theirs[0]

    def fits(self, mus: np.ndarray, sigmas: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Best cell of each profile: rows that have one; mu, sigma, slope, intercept, amplitude, error; which lack intensities."""
        n, n_y, st, stt, sy, sty, syy, st_y = self.plain
        sg, sgt, sgg, sgy, sg_y = self.bumps
        with np.errstate(all="ignore"):
            off = np.where(n_y > 0, sy / n_y, 0.0)
            sty, sgy, syy = sty - off * st_y, sgy - off * sg_y, syy - off * sy
            sy = sy - off * n_y
            m = [[stt, st, sgt], [st, n, sg], [sgt, sg, sgg]]
            rhs = [sty, sy, sgy]
            d = _det(m)
            slope, level, amplitude = (_det([[rhs[r] if k == i else m[r][k] for k in range(3)] for r in range(3)]) / d for i in range(3))
            sse = syy - slope * sty - level * sy - amplitude * sgy
            # cells are compared by their error relative to the profile's own spread, so its scale does not matter
            share = np.where(syy > 0, sse / syy, np.where(np.isnan(syy), np.nan, 0.0))
            share = np.copysign(np.floor(np.abs(share) * 1e9 + 0.5) / 1e9, share)
        known = d != 0
        order = np.where(known, np.where(np.isnan(share), np.inf, share), np.inf)
        best = np.argmin(order, axis=1)
        rows = np.arange(len(best))
        best = np.where(known[rows, best], best, np.argmax(known, axis=1))
        found = np.flatnonzero(known[rows, best])
        cell = (found, best[found])
        mean = self.centre[found] + off[found, 0]
        values = [mus[cell[1]], sigmas[cell[1]], slope[cell], level[cell] + mean, amplitude[cell], sse[cell]]
        return found, values, n_y[found, 0] == 0


def _det(m: list[list[np.ndarray]]) -> np.ndarray:
    return (
        m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1])
        - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
        + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    )


def _grid_search(
    batches: Iterator[pa.RecordBatch], keys: list[str], mus: np.ndarray, sigmas: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Best cell per profile; rows come in order of their keys, and only the last profile of a batch is carried on."""
    held, kept, named = None, None, None

    def fitted(sums: _GridSums, names: pa.RecordBatch) -> pa.RecordBatch:
        found, values, blind = sums.fits(mus, sigmas)
        out = [pa.array(v, mask=blind if i >= 2 else None) for i, v in enumerate(values)]
        return pa.RecordBatch.from_arrays([*names.take(pa.array(found)).columns, *out], [*keys, *FITTED])

    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            first = np.flatnonzero(starts(batch, keys))
            t, y = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("dist", "intensity"))
            has_t, has_y = (batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in ("dist", "intensity"))
            names = batch.select(keys).take(pa.array(first))
            goes_on = held is not None and tuple(c[0].as_py() for c in names.columns) == held
            counts = np.add.reduceat(has_y.astype(float), first)
            centre = np.add.reduceat(np.where(has_y, y, 0.0), first) / np.maximum(counts, 1.0)
            if goes_on:
                centre[0] = kept.centre[0]
            sums = _GridSums(t, y, has_t, has_y, first, centre, mus, sigmas)
            if goes_on:
                sums.add_first(kept)
            elif held is not None:
                yield fitted(kept, named)
            last = len(first) - 1
            if last:
                yield fitted(sums.part(slice(0, last)), names.slice(0, last))
            kept, named = sums.part(slice(last, last + 1)), names.slice(last, 1)
            held = tuple(c[0].as_py() for c in named.columns)
    if held is not None:
        yield fitted(kept, named)


FITTED = ["mu", "sigma", "slope", "intercept", "amplitude", "sse"]


def profile_edge(
    profiles: DataFrame, keys: Sequence[str], length: float, mus: Sequence[float], sigmas: Sequence[float]
) -> DataFrame:
    """Edge position by grid search: for every centre and width, slope, offset and height by least squares.

    Profiles are spread by key and pass a task one after the other; a task holds the grid of a batch of samples, however
    many profiles it gets.  A centre outside the line is ``fail:bounds``.
    """
    keys = list(keys)
    cells = sorted({(float(m), float(s)) for m in mus for s in sigmas})
    grid = np.array(cells)
    samples = profiles.dropna(subset=keys).select(*keys, F.col("dist").cast("double").alias("dist"), F.col("intensity").cast("double").alias("intensity"))
    kinds = dict(samples.dtypes)
    made = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], *[f"{c} double" for c in FITTED]])
    sorted_ = samples.repartition(*keys).sortWithinPartitions(*keys)
    best = sorted_.mapInArrow(lambda batches: _grid_search(batches, keys, grid[:, 0], grid[:, 1]), made)
    held = F.least(F.greatest("mu", F.lit(0.0)), F.lit(length))
    out = F.abs(F.col("mu") - held) > BOUNDS_SLACK
    return best.select(
        *keys,
        "slope",
        "intercept",
        F.when(out, F.lit(length / 2.0)).otherwise(held).alias("mu"),
        "sigma",
        "amplitude",
        F.greatest("sse", F.lit(0.0)).alias("sse"),
        F.when(out, "fail:bounds").otherwise("success").alias("status"),
    )


def nrmse(predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Root mean square error over the data range; infinite for a flat profile."""
    r = F.col("predicted") - F.col("intensity")
    span = F.max("intensity") - F.min("intensity")
    value = F.when(span < 1e-6, F.lit(float("inf"))).otherwise(F.sqrt(F.avg(r * r)) / span)
    return predicted.groupBy(*keys).agg(value.alias("nrmse"))


def delta_aic(predicted: DataFrame, keys: Sequence[str], gain: float = 1.0, k: int = 11, limit: float = AIC_GAIN) -> DataFrame:
    """Gain in information criterion of the fit over a constant, for Poisson counts.

    The constant's likelihood needs only the sum of the counts, so one pass over the samples is enough.
    """
    o = F.greatest(F.col("intensity") * gain, F.lit(0.0))
    p = F.greatest(F.col("predicted") * gain, F.lit(1e-3))
    sums = predicted.groupBy(*keys).agg(
        F.sum(o * F.log(p) - p).alias("_fit"), F.sum(o).alias("_o"), F.count("*").alias("_n")
    )
    level = F.greatest(F.col("_o") / F.col("_n"), F.lit(1e-3))
    null = F.col("_o") * F.log(level) - F.col("_n") * level
    value = (F.lit(2.0) - 2.0 * null) - (F.lit(2.0 * k) - 2.0 * F.col("_fit"))
    return sums.select(*keys, value.alias("delta_aic")).withColumn("good_fit", F.round("delta_aic", 9) > limit)


def poisson_outliers(
    predicted: DataFrame, keys: Sequence[str], gain: float = 1.0, sigmas: float = OUTLIER_SIGMAS, share: float = OUTLIER_SHARE
) -> DataFrame:
    """Share of samples farther off than ``sigmas`` expected deviations."""
    expected = F.sqrt(F.greatest("predicted", F.lit(1.0)) / F.lit(gain))
    far = F.round(F.abs(F.col("intensity") - F.col("predicted")), 9) > F.round(F.lit(sigmas) * expected, 9)
    return predicted.groupBy(*keys).agg((F.count_if(far) / F.count("*")).alias("outlier_fraction")).withColumn(
        "is_consistent", F.col("outlier_fraction") < share
    )
