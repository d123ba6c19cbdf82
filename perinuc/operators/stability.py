"""Registration noise, drift between the two modes, and which nuclei or fields pass.

Registration tables are long: ``mode, fov_id[, ne_label[, slice_id]], scale, angle, shift_y, shift_x``.
Both modes sit in one table, so a comparison is one grouped pass instead of a self-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perinuc.functions.scalars import RADIUS_PX, exceeds, fixed, magnitude, rss

NUCLEUS = ["fov_id", "ne_label"]
PARTS = ["scale", "angle", "shift_y", "shift_x"]

# Noise floor when there are too few slices, its mode-2 stand-in, and the failure factor.
DEFAULT_SIGMA = 0.5
MISSING_FACTOR = 1.414
FAIL_FACTOR = 2.0


def _sd(c: str, when: Column | None = None) -> Column:
    return F.stddev_pop(F.when(when, F.col(c)) if when is not None else F.col(c))


def _sigma(n: Column, sd: dict[str, Column], radius: float) -> Column:
    noise = rss(sd["shift_y"], sd["shift_x"], sd["angle"], sd["scale"], radius)
    return F.when(n < 2, F.lit(DEFAULT_SIGMA)).otherwise(noise)


def slice_sigma(slices: DataFrame, by: Sequence[str] = ("mode", *NUCLEUS), radius: float = RADIUS_PX) -> DataFrame:
    """Own noise of each nucleus: spread of its slices, 0.5 with fewer than two."""
    spread = slices.groupBy(*by).agg(F.count("*").alias("n"), *[_sd(c).alias(c) for c in PARTS])
    return spread.select(*by, "n", _sigma(F.col("n"), {c: F.col(c) for c in PARTS}, radius).alias("sigma"))


def slice_sigma_shift_only(slices: DataFrame, fovs: DataFrame) -> DataFrame:
    """Spread of the slice shifts alone; the field's own precision when there are fewer than two slices."""
    spread = slices.groupBy("mode", *NUCLEUS).agg(
        F.count("*").alias("n"), magnitude(_sd("shift_y"), _sd("shift_x")).alias("own")
    )
    precision = fovs.select("mode", "fov_id", "ch_reg_prec")
    sigma = F.when(F.col("n") > 1, F.col("own")).otherwise(F.col("ch_reg_prec"))
    return spread.join(precision, ["mode", "fov_id"], "left").select(
        "mode", *NUCLEUS, "n", sigma.alias("sigma_reg")
    )


def signal(labels: DataFrame, radius: float = RADIUS_PX) -> DataFrame:
    """Absolute offset between the channels."""
    size = rss("shift_y", "shift_x", "angle", F.col("scale") - 1.0, radius)
    return labels.select("mode", *NUCLEUS, size.alias("signal"))


def _both_modes(reg: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per key with the columns of mode 1 and mode 2 side by side, in one shuffle."""
    return reg.groupBy(*by).agg(
        *[F.max(F.when(F.col("mode") == m, F.lit(True))).alias(f"in_m{m}") for m in (1, 2)],
        *[F.max(F.when(F.col("mode") == m, F.col(c))).alias(f"{c}_m{m}") for m in (1, 2) for c in PARTS],
    )


def _drift(wide: DataFrame, by: Sequence[str], radius: float) -> DataFrame:
    d = {c: F.col(f"{c}_m2") - F.col(f"{c}_m1") for c in PARTS}
    return wide.select(
        *by,
        rss(d["shift_y"], d["shift_x"], d["angle"], d["scale"], radius).alias("drift"),
        d["shift_y"].alias("dy"),
        d["shift_x"].alias("dx"),
        d["angle"].alias("da"),
        d["scale"].alias("ds"),
    )


def drift_map(labels: DataFrame, radius: float = RADIUS_PX) -> DataFrame:
    """Mode 2 minus mode 1 for every mode-1 nucleus; NULL when mode 2 lacks it."""
    return _drift(_both_modes(labels, NUCLEUS).filter("in_m1"), NUCLEUS, radius)


def fov_drift(fovs: DataFrame, radius: float = RADIUS_PX) -> DataFrame:
    """Mode 2 minus mode 1 for the fields that occur in both modes."""
    return _drift(_both_modes(fovs, ["fov_id"]).filter("in_m1 AND in_m2"), ["fov_id"], radius)


def ne_stability(
    labels: DataFrame, slices: DataFrame, pairs: DataFrame, radius: float = RADIUS_PX
) -> DataFrame:
    """Pass or fail per mode-1 nucleus: drift against twice its combined noise.

    Slices, labels and pairs are each shuffled once by (field, label) and then joined in place.
    """
    modes = {m: F.col("mode") == m for m in (1, 2)}
    noise = slices.groupBy(*NUCLEUS).agg(
        *[F.count_if(modes[m]).alias(f"n_m{m}") for m in modes],
        *[_sd(c, modes[m]).alias(f"{c}_s{m}") for m in modes for c in PARTS],
    )
    sigma = {
        m: _sigma(
            F.coalesce(F.col(f"n_m{m}"), F.lit(0)), {c: F.col(f"{c}_s{m}") for c in PARTS}, radius
        )
        for m in modes
    }
    drift = drift_map(labels, radius)
    both = (
        drift.join(noise, NUCLEUS, "left")
        .withColumn("missing", F.col("drift").isNull())
        .withColumn("sigma_m1", sigma[1])
        .withColumn(
            "sigma_combined",
            F.when(F.col("missing"), F.col("sigma_m1") * MISSING_FACTOR).otherwise(
                F.sqrt(F.col("sigma_m1") * F.col("sigma_m1") + sigma[2] * sigma[2])
            ),
        )
        .withColumn("threshold", F.col("sigma_combined") * FAIL_FACTOR)
    )
    unstable = exceeds(F.col("drift"), F.col("threshold"))
    reason = F.when(F.col("missing"), F.lit("missing_in_mode2")).when(
        unstable, F.format_string("Unstable_Drift (%s > %s)", fixed("drift"), fixed("threshold"))
    )
    partner = pairs.select("fov_id", F.col("ch1_label").alias("ne_label"), "ch2_label")
    return both.join(partner, NUCLEUS, "left").select(
        *NUCLEUS,
        "ch2_label",
        F.col("ch2_label").isNotNull().alias("is_paired"),
        F.when(F.col("missing") | unstable, F.lit("failed")).otherwise(F.lit("passed")).alias("status"),
        reason.alias("fail_reason"),
        F.coalesce("drift", F.lit(-1.0)).alias("drift"),
        F.coalesce("dx", F.lit(0.0)).alias("drift_dx"),
        F.coalesce("dy", F.lit(0.0)).alias("drift_dy"),
        "sigma_m1",
        "sigma_combined",
        "threshold",
    )


def population_sigma(drifts: DataFrame) -> DataFrame:
    """One row: root mean square of the field drifts, 0.5 when there are none."""
    return drifts.agg(
        F.coalesce(F.sqrt(F.avg(F.col("drift") * F.col("drift"))), F.lit(DEFAULT_SIGMA)).alias("global_sigma")
    )


def fov_stability(fovs: DataFrame, radius: float = RADIUS_PX) -> DataFrame:
    """Pass or fail per field: drift against twice the spread over all fields."""
    drifts = fov_drift(fovs, radius).withColumn("_all", F.lit(0))
    limit = population_sigma(drifts).select(
        F.lit(0).alias("_all"), (F.col("global_sigma") * FAIL_FACTOR).alias("threshold")
    )
    # the limit is a single row by construction, so broadcasting it is bounded
    judged = drifts.join(F.broadcast(limit), "_all")
    far = exceeds(F.col("drift"), F.col("threshold"))
    return judged.select(
        "fov_id",
        "drift",
        F.col("dx").alias("drift_dx"),
        F.col("dy").alias("drift_dy"),
        "threshold",
        F.when(far, F.lit("failed")).otherwise(F.lit("passed")).alias("status"),
        F.when(far, F.format_string("FoV_Drift (%s > %s)", fixed("drift"), fixed("threshold"))).alias("reason"),
    )


def expand_to_nuclei(fov_report: DataFrame, labels: DataFrame) -> DataFrame:
    """Every mode-1 nucleus inherits the verdict of its field."""
    nuclei = labels.filter("mode = 1").select(*NUCLEUS)
    return nuclei.join(fov_report, "fov_id").select(
        *NUCLEUS, "status", "reason", "drift", "drift_dx", "drift_dy"
    )


def compare_stability(fov_report: DataFrame, fov_nuclei: DataFrame, ne_report: DataFrame) -> DataFrame:
    """Detected and pruned counts of both methods per field, with the experiment total as the row of NULL field."""
    a = fov_nuclei.select(*NUCLEUS, F.col("status").alias("by_fov"))
    b = ne_report.select(*NUCLEUS, F.col("status").alias("by_ne"))
    both = a.join(b, NUCLEUS, "full")
    seen = both.groupBy("fov_id").agg(
        F.count("*").alias("detected"),
        F.count_if(F.col("by_ne") == "failed").alias("pruned_ne_method"),
        F.count_if(F.col("by_fov") == F.col("by_ne")).alias("method_agreement"),
    )
    verdict = fov_report.select("fov_id", (F.col("status") == "failed").alias("dropped"))
    per_fov = seen.join(verdict, "fov_id", "full").select(
        "fov_id",
        F.coalesce("detected", F.lit(0)).alias("detected"),
        F.when(F.col("dropped"), F.coalesce("detected", F.lit(0))).otherwise(F.lit(0)).alias("pruned_fov_method"),
        F.coalesce("pruned_ne_method", F.lit(0)).alias("pruned_ne_method"),
        F.coalesce("method_agreement", F.lit(0)).alias("method_agreement"),
    )
    counts = ["detected", "pruned_fov_method", "pruned_ne_method", "method_agreement"]
    return (
        per_fov.rollup("fov_id")
        .agg(*[F.sum(c).alias(c) for c in counts])
        .withColumn("diff", F.col("pruned_fov_method") - F.col("pruned_ne_method"))
    )


def pooled_stability(labels: DataFrame, slices: DataFrame, radius: float = RADIUS_PX) -> DataFrame:
    """Variant: drift (mode 1 minus mode 2) against the pooled mode-1 noise of the field."""
    first = labels.filter("mode = 1").select(*NUCLEUS)
    own = slice_sigma(slices.filter("mode = 1"), NUCLEUS, radius)
    noise = first.join(own, NUCLEUS, "left").withColumn("sigma", F.coalesce("sigma", F.lit(DEFAULT_SIGMA)))
    pooled = noise.groupBy("fov_id").agg(F.sqrt(F.avg(F.col("sigma") * F.col("sigma"))).alias("sigma_fov"))
    judged = drift_map(labels, radius).join(pooled, "fov_id").withColumn(
        "threshold", F.col("sigma_fov") * FAIL_FACTOR
    )
    far = exceeds(F.col("drift"), F.col("threshold"))
    missing = F.col("drift").isNull()
    return judged.select(
        *NUCLEUS,
        F.when(missing | far, F.lit("failed")).otherwise(F.lit("passed")).alias("status"),
        F.coalesce("drift", F.lit(-1.0)).alias("drift"),
        "sigma_fov",
        "threshold",
        F.when(missing, F.lit("missing_in_mode2"))
        .when(far, F.format_string("unstable (%s > %s)", fixed("drift"), fixed("threshold")))
        .alias("reason"),
    )


def mode_delta(reg: DataFrame, by: Sequence[str]) -> DataFrame:
    """After minus before for keys present in both modes, with the length of the shift change."""
    wide = _both_modes(reg, by).filter("in_m1 AND in_m2")
    dy, dx = F.col("shift_y_m2") - F.col("shift_y_m1"), F.col("shift_x_m2") - F.col("shift_x_m1")
    return wide.select(
        *by,
        (F.col("angle_m2") - F.col("angle_m1")).alias("angle_delta"),
        (F.col("scale_m2") - F.col("scale_m1")).alias("scale_delta"),
        dy.alias("rdif_y"),
        dx.alias("rdif_x"),
        magnitude(dy, dx).alias("rdif"),
    )


def delta_stats(deltas: DataFrame, level: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, combined shift spread, means and population spreads of the mode differences."""
    named = {"angle": "angle_delta", "scale": "scale_delta", "rdif_y": "rdif_y", "rdif_x": "rdif_x"}
    return deltas.groupBy(*by).agg(
        F.lit(level).alias("level"),
        F.count("*").alias("n"),
        magnitude(F.stddev_pop("rdif_y"), F.stddev_pop("rdif_x")).alias("sigma_reg"),
        *[F.avg(c).alias(f"{n}_mean") for n, c in named.items()],
        *[F.stddev_pop(c).alias(f"{n}_std") for n, c in named.items()],
    )


def effective_registration(
    ch2_nuclei: DataFrame, pairs: DataFrame, label_reg: DataFrame, fov_reg: DataFrame
) -> DataFrame:
    """Transform to use for each channel-2 nucleus: that of its channel-1 partner, else its field's, else identity.

    Unpaired nuclei keep identity.  Registration rows are those of one mode.
    """
    partner = pairs.select("fov_id", F.col("ch2_label").alias("ne_label"), "ch1_label")
    own = label_reg.select("fov_id", F.col("ne_label").alias("ch1_label"), *[F.col(c).alias(f"own_{c}") for c in PARTS])
    field = fov_reg.select("fov_id", *[F.col(c).alias(f"fov_{c}") for c in PARTS])
    joined = (
        ch2_nuclei.select(*NUCLEUS)
        .join(partner, NUCLEUS, "left")
        .join(own, ["fov_id", "ch1_label"], "left")
        .join(field, "fov_id", "left")
    )
    paired = F.col("ch1_label").isNotNull()
    identity = {"scale": 1.0, "angle": 0.0, "shift_y": 0.0, "shift_x": 0.0}
    source = (
        F.when(~paired, F.lit("identity"))
        .when(F.col("own_scale").isNotNull(), F.lit("label"))
        .when(F.col("fov_scale").isNotNull(), F.lit("fov"))
        .otherwise(F.lit("identity"))
    )
    chosen = [
        F.when(source == "label", F.col(f"own_{c}"))
        .when(source == "fov", F.col(f"fov_{c}"))
        .otherwise(F.lit(identity[c]))
        .alias(c)
        for c in PARTS
    ]
    return joined.select("fov_id", "ne_label", "ch1_label", source.alias("source"), *chosen)


def prune_nuclei(pairs: DataFrame, ne_report: DataFrame) -> DataFrame:
    """Pairs without the nuclei that failed."""
    failed = ne_report.filter("status = 'failed'").select("fov_id", F.col("ne_label").alias("ch1_label"))
    return pairs.join(failed, ["fov_id", "ch1_label"], "left_anti")


def prune_fovs(pairs: DataFrame, fov_report: DataFrame) -> DataFrame:
    """Pairs without the fields that failed."""
    return pairs.join(fov_report.filter("status = 'failed'").select("fov_id"), "fov_id", "left_anti")


def pruned_counts(pairs: DataFrame, ne_report: DataFrame, fov_report: DataFrame) -> DataFrame:
    """How much each filter removes: all failed nuclei, and failed fields that still had pairs."""
    by_ne = ne_report.filter("status = 'failed'").agg(F.count("*").alias("pruned"))
    gone = fov_report.filter("status = 'failed'").select("fov_id").join(
        pairs.select("fov_id").distinct(), "fov_id", "left_semi"
    )
    by_fov = gone.agg(F.count("*").alias("pruned"))
    return by_ne.select(F.lit("ne").alias("method"), "pruned").unionByName(
        by_fov.select(F.lit("fov").alias("method"), "pruned")
    )
