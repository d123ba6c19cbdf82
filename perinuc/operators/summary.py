"""Grouped statistics, joins onto the experiment key, histograms and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perinuc.functions.scalars import col
from perinuc.functions.special import student_p
from perinuc.scale import join_nulls, positions, quantile_columns, quantiles, stored, with_key


def summary_stats(df: DataFrame, by: Sequence[str], cols: Sequence[str], na: str = "propagate") -> DataFrame:
    """Count, mean, sample sd, median and interquartile range per column.

    With ``na='propagate'`` a missing value blanks mean, sd and median, while the
    interquartile range always ignores missing values; ``na='skip'`` ignores them throughout.
    """
    moments = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"{c}_mean") for c in cols],
        *[F.stddev_samp(c).alias(f"{c}_sd") for c in cols],
        *[F.count(c).alias(f"_seen_{c}") for c in cols],
    )
    ranks = quantile_columns(df, by, cols, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    wide = join_nulls(moments, ranks, by, "left")

    def kept(c: str, stat: str) -> Column:
        value = F.col(f"{c}_{stat}")
        whole = F.col(f"_seen_{c}") == F.col("n")
        return (F.when(whole, value) if na == "propagate" else value).alias(f"{c}_{stat}")

    return wide.select(
        *by,
        "n",
        *[kept(c, s) for c in cols for s in ("mean", "sd", "median")],
        *[(F.col(f"{c}_q3") - F.col(f"{c}_q1")).alias(f"{c}_IQR") for c in cols],
    )


def unit_counts(df: DataFrame, by: Sequence[str], name: str = "FoV_count") -> DataFrame:
    """Rows with the size of their group."""
    return join_nulls(df, df.groupBy(*by).agg(F.count("*").alias(name)), by)


def nest_ids(df: DataFrame, by: Sequence[str], id_col: str, page: int = 10_000) -> DataFrame:
    """Sorted id lists per group; a group of more than ``page`` ids continues on further rows."""
    placed = positions(df.select(*by, id_col), by, [id_col], "_at")
    paged = placed.withColumn("page", F.floor(F.col("_at") / page).cast("long"))
    return paged.groupBy(*by, "page").agg(F.sort_array(F.collect_list(id_col)).alias("ids"))


def join_key(key: DataFrame, results: DataFrame, on: Sequence[str] = ("strain", "fov_id")) -> DataFrame:
    """Results on the experiment key: left, many to many, without the results' own free text."""
    return key.join(results.drop("addl_info"), list(on), "left")


def load_results(
    results: DataFrame, strains: Sequence[str], key: DataFrame, on: Sequence[str] = ("strain", "fov_id")
) -> DataFrame:
    """Keep the wanted strains, then join onto the key."""
    return join_key(key, member_filter(results, "strain", strains), on)


def member_filter(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose value is listed; an empty list keeps everything."""
    return df.filter(F.col(column).isin(list(values))) if values else df


def rejoin_summary(
    df: DataFrame, by: Sequence[str], cols: Sequence[str], title_cols: Sequence[str]
) -> DataFrame:
    """Group statistics back on every row, with a joined title."""
    stats = summary_stats(df, by, cols).withColumnRenamed("n", "ne_count")
    return join_nulls(df, stats, by, "left").withColumn(
        "exper", F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in title_cols])
    )


def mode_diff(reg: DataFrame, keys: Sequence[str] = ("strain", "date", "fov_id")) -> DataFrame:
    """Mode 1 minus mode 2 for every mode-1 row; NULL where mode 2 has no partner.

    The default keys leave the batch text out, so several batches of one day pair up with each other.
    """
    parts = ["scale", "angle", "shift_y", "shift_x"]
    first = reg.filter("mode = 'mode1'").select(*keys, *[F.col(c).alias(f"{c}_1") for c in parts])
    second = reg.filter("mode = 'mode2'").select(*keys, *[F.col(c).alias(f"{c}_2") for c in parts])
    return join_nulls(first, second, keys, "left").select(
        *keys, *[(F.col(f"{c}_1") - F.col(f"{c}_2")).alias(f"{c}_diff") for c in parts]
    )


def registration_precision(diff: DataFrame, by: Sequence[str]) -> DataFrame:
    """Combined sample spread of both shift differences."""
    y, x = F.stddev_samp("shift_y_diff"), F.stddev_samp("shift_x_diff")
    return diff.groupBy(*by).agg(
        F.count("*").alias("n"),
        y.alias("shift_y_diff_sd"),
        x.alias("shift_x_diff_sd"),
        F.sqrt(y * y + x * x).alias("reg_prec"),
    )


def sigma_filter(df: DataFrame, column: str, by: Sequence[str], k: float = 2.0) -> DataFrame:
    """Rows within k sample standard deviations of their group's mean, both ends included."""
    stats = df.groupBy(*by).agg(F.avg(column).alias("_mean"), F.stddev_samp(column).alias("_sd"))
    near = F.round(F.abs(F.col(column) - F.col("_mean")), 9) <= F.round(F.lit(k) * F.col("_sd"), 9)
    return join_nulls(df, stats, by).filter(near).drop("_mean", "_sd")


def _scott(column: Column | str, n: Column) -> Column:
    # Fixed value: factor of the bin-width rule.
    return F.lit(3.49) * F.stddev_samp(column) * F.pow(n.cast("double"), F.lit(-1.0 / 3.0))


def scott_width(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Bin width 3.49 sd n^(-1/3); missing values count in n but not in sd."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), _scott(column, F.count("*")).alias("width"))


def histogram_by_width(
    df: DataFrame, column: str, by: Sequence[str], limits: str = "minmax", own_width: bool = False
) -> DataFrame:
    """Counts per group in right-closed bins that start at 0, of one common width or of each group's own.

    Carries the axis limits of all groups (range, or mean +- 3 sd) and the largest count.
    """
    v = F.col(column)
    frame = df.agg(
        _scott(column, F.count("*")).alias("width"),
        F.min(v).alias("_lo"),
        F.max(v).alias("_hi"),
        F.avg(v).alias("_mean"),
        F.stddev_samp(v).alias("_sd"),
    )
    lo, hi = (
        (F.col("_mean") - 3.0 * F.col("_sd"), F.col("_mean") + 3.0 * F.col("_sd"))
        if limits == "3sd"
        else (F.col("_lo"), F.col("_hi"))
    )
    # a single row of global limits
    frame = frame.select(F.lit(0).alias("_all"), "width", "_lo", lo.alias("x_min"), hi.alias("x_max"))
    rows = df.filter(v.isNotNull()).withColumn("_all", F.lit(0)).join(F.broadcast(frame), "_all")
    if own_width:
        group = df.groupBy(*by).agg(_scott(column, F.count("*")).alias("width"), F.min(v).alias("_lo"))
        rows = join_nulls(rows.drop("width", "_lo"), group, by)
    raw = F.ceil(v / F.col("width")) - 1
    first = F.floor(F.col("_lo") / F.col("width"))
    counts = rows.groupBy(
        *by, F.greatest(raw, first).cast("long").alias("bin"), "width", "x_min", "x_max"
    ).agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n").alias("y_max")).withColumn("_all", F.lit(0))
    return (
        counts.withColumn("_all", F.lit(0))
        .join(F.broadcast(top), "_all")
        .select(
            *by,
            "bin",
            (F.col("bin") * F.col("width")).alias("lower"),
            ((F.col("bin") + 1) * F.col("width")).alias("upper"),
            "n",
            "x_min",
            "x_max",
            "y_max",
        )
    )


def histogram_n(df: DataFrame, column: str, bins: int, density: bool = False) -> DataFrame:
    """Equal bins between smallest and largest value, the last one closed."""
    v = F.col(column).cast("double")
    rows = df.filter(v.isNotNull() & ~F.isnan(v)).select(v.alias("_v"), F.lit(0).alias("_all"))
    frame = rows.groupBy("_all").agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_total")
    )
    w = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    bin_id = F.least(F.floor((F.col("_v") - F.col("_lo")) / w), F.lit(bins - 1)).cast("long")
    out = (
        rows.join(F.broadcast(frame), "_all")
        .groupBy(bin_id.alias("bin"), "_lo", w.alias("_w"), "_total")
        .agg(F.count("*").alias("n"))
    )
    extra = [(F.col("n") / (F.col("_total") * F.col("_w"))).alias("density")] if density else []
    return out.select(
        "bin",
        (F.col("_lo") + F.col("bin") * F.col("_w")).alias("lower"),
        (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("upper"),
        "n",
        *extra,
    )


def normal_fit_and_box(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Fitted mean and population sd plus a box of plain statistics; needs two finite values."""
    v = F.col(column).cast("double")
    finite = df.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    finite, key = with_key(finite, by)
    box = finite.groupBy(*key).agg(
        F.count("*").alias("n"),
        F.avg(v).alias("mu"),
        F.stddev_pop(v).alias("sigma"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    ).filter("n >= 2")
    mid = quantile_columns(finite, key, [column], {"median": 0.5}).withColumnRenamed(f"{column}_median", "median")
    return join_nulls(box, mid, key).drop("_all")


def plausible(df: DataFrame, mean: str = "mean_distance", limit: float = 500.0, near: float = 200.0) -> DataFrame:
    """Pairs with a believable mean distance, and their colour class."""
    return df.filter(F.abs(F.col(mean)) < limit).withColumn(
        "color", F.when(F.abs(F.col(mean)) < near, F.lit("green")).otherwise(F.lit("orange"))
    )


PAIR = ["fov_id", "ch1_label", "ch2_label"]
PAIR_TYPES = ["data_data", "bridge_bridge", "data_bridge", "bridge_data"]


def distance_stats(distances: DataFrame, by: Sequence[str] = PAIR, px_nm: float = 128.0) -> DataFrame:
    """Per pair: overall statistics (population sd) and mean, sd and count per kind of point."""
    d = F.col("dist_nm")

    def kind(t: str) -> list[Column]:
        only = F.when(F.col("pair_type") == t, d)
        n = F.count(only)
        return [
            F.avg(only).alias(f"{t}_mean"),
            F.when(n > 1, F.stddev_pop(only)).alias(f"{t}_std"),
            n.alias(f"n_{t}_points"),
        ]

    stats = distances.groupBy(*by).agg(
        F.avg(d).alias("mean_distance"),
        F.stddev_pop(d).alias("std_distance"),
        F.min(d).alias("min_distance"),
        F.max(d).alias("max_distance"),
        F.count("*").alias("n_points"),
        F.lit(px_nm).alias("pixel_size_nm"),
        *[c for t in PAIR_TYPES for c in kind(t)],
    )
    mid = quantile_columns(distances, by, ["dist_nm"], {"median": 0.5})
    return stats.join(mid.withColumnRenamed("dist_nm_median", "median_distance"), list(by), "left")


def distance_summary(stats: DataFrame, distances: DataFrame, limit: float = 500.0) -> DataFrame:
    """One row over the measurements of all believable pairs."""
    good = stats.filter(F.abs("mean_distance") < limit).select(*PAIR)
    points = distances.join(good, PAIR, "left_semi").withColumn("_all", F.lit(0))
    d = F.col("dist_nm")
    overall = points.groupBy("_all").agg(
        F.count("*").alias("n_total_measurements"),
        F.avg(d).alias("overall_mean_nm"),
        F.stddev_pop(d).alias("overall_std_nm"),
        F.min(d).alias("min_nm"),
        F.max(d).alias("max_nm"),
    )
    pairs = good.agg(F.count("*").alias("n_valid_pairs")).withColumn("_all", F.lit(0))
    mid = quantile_columns(points, ["_all"], ["dist_nm"], {"median": 0.5})
    return (
        overall.join(pairs, "_all")
        .join(mid.withColumnRenamed("dist_nm_median", "overall_median_nm"), "_all")
        .drop("_all")
    )


def sorted_pairs(stats: DataFrame, column: str = "mean_distance", n: int | None = None) -> DataFrame:
    """Pairs in order of their mean, ties by key; optionally only the first n."""
    ordered = stats.orderBy(column, *PAIR)
    return ordered.limit(n) if n is not None else ordered


def row_index(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """0-based index within each group."""
    return positions(df, by, order, "dist_idx")


def distance_log(stats: DataFrame) -> DataFrame:
    """Log rows per pair; the success rate is the share of points with data on both curves."""
    rate = F.when(F.col("n_points") > 0, F.col("n_data_data_points") / F.col("n_points")).otherwise(F.lit(0.0))
    return stats.select(
        "fov_id",
        F.col("ch1_label").alias("ne_ch1"),
        F.col("ch2_label").alias("ne_ch2"),
        "mean_distance",
        "median_distance",
        "std_distance",
        "min_distance",
        "max_distance",
        F.col("n_points").alias("n_points_sampled"),
        rate.alias("ch1_success_rate"),
        rate.alias("ch2_success_rate"),
    )


def distance_log_stats(log: DataFrame) -> DataFrame:
    """Per field: number of pairs, spread and range of their means."""
    m = F.col("mean_distance")
    return log.groupBy("fov_id").agg(
        F.count("*").alias("n_pairs_calculated"),
        F.avg(m).alias("overall_mean_distance"),
        F.stddev_samp(m).alias("overall_std_distance"),
        F.min(m).alias("distance_min"),
        F.max(m).alias("distance_max"),
    )


def quality_log_stats(quality: DataFrame) -> DataFrame:
    """Per field and channel: mean rates over segments and summed profile counts."""
    return quality.groupBy("fov_id", "channel").agg(
        F.avg("success_rate").alias("overall_success_rate"),
        F.avg("curvature_fail_rate").alias("curvature_fail_rate"),
        *[
            F.sum(c).alias(c)
            for c in ("n_total", "n_success", "n_curvature_fail", "n_likelihood_fail", "n_optimization_fail")
        ],
    )


def segment_quality(log: DataFrame) -> DataFrame:
    """Profile outcomes per segment, with rates that are 0 for an empty segment."""
    status = F.col("status")
    counted = log.groupBy("fov_id", "channel", "ne_label", "seg_label").agg(
        F.count("*").alias("n_total"),
        F.count_if(status == "success").alias("n_success"),
        F.count_if(status == "fail:likelihood_ratio").alias("n_likelihood_fail"),
        F.count_if(status == "fail:all_step_sizes").alias("n_optimization_fail"),
        F.count_if(F.coalesce("was_reverted", F.lit(False))).alias("n_curvature_fail"),
    )

    def rate(c: str) -> Column:
        return F.when(F.col("n_total") > 0, F.col(c) / F.col("n_total")).otherwise(F.lit(0.0))

    return counted.select(
        "*", rate("n_success").alias("success_rate"), rate("n_curvature_fail").alias("curvature_fail_rate")
    )


def status_summary(log: DataFrame, by: Sequence[str] = ("fov_id", "channel")) -> DataFrame:
    """Per status: count, share of all profiles, failure flag and intensity means."""
    per = log.groupBy(*by, "status").agg(
        F.count("*").alias("n"),
        F.avg("intensity_mean").alias("intensity_mean"),
        F.avg("intensity_std").alias("intensity_std"),
        F.avg("intensity_range").alias("intensity_range"),
    )
    totals = per.groupBy(*by).agg(F.sum("n").alias("total_profiles"))
    return join_nulls(per, totals, by).select(
        *by,
        "status",
        "n",
        "total_profiles",
        (F.lit(100.0) * F.col("n") / F.col("total_profiles")).alias("pct"),
        (F.col("status") != "success").alias("in_breakdown"),
        F.col("status").startswith("fail").alias("is_failure"),
        "intensity_mean",
        "intensity_std",
        "intensity_range",
    )


def label_success(log: DataFrame, by: Sequence[str] = ("fov_id", "channel", "ne_label")) -> DataFrame:
    """Success rate per nucleus."""
    good = F.count_if(F.col("status") == "success")
    return log.groupBy(*by).agg(
        F.count("*").alias("total"), good.alias("success"), (good / F.count("*")).alias("success_rate")
    )


def filter_impact(labelled: DataFrame, label: str = "filtering") -> DataFrame:
    """Pair means with and without filters: counts, spread and inner precision per label."""
    m = F.col("mean_distance")
    moments = labelled.groupBy(label).agg(
        F.count("*").alias("n"),
        F.avg(m).alias("mean"),
        F.stddev_samp(m).alias("sd"),
        F.min(m).alias("min"),
        F.max(m).alias("max"),
        F.avg("std_distance").alias("mean_inner_sd"),
    )
    mid = quantile_columns(labelled, [label], ["mean_distance"], {"median": 0.5})
    return join_nulls(moments, mid.withColumnRenamed("mean_distance_median", "median"), [label])


def two_sample_t(labelled: DataFrame, column: str, label: str, first: str, second: str) -> DataFrame:
    """Equal-variance t-test of two labelled samples from their moments, as one row."""

    def side(name: str, tag: str) -> list[Column]:
        only = F.when(F.col(label) == name, F.col(column))
        return [
            F.count(only).alias(f"n{tag}"),
            F.avg(only).alias(f"m{tag}"),
            F.var_samp(only).alias(f"v{tag}"),
        ]

    s = labelled.agg(*side(first, "1"), *side(second, "2"))
    df = F.col("n1") + F.col("n2") - 2
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / df
    t = (F.col("m1") - F.col("m2")) / F.sqrt(pooled * (1.0 / F.col("n1") + 1.0 / F.col("n2")))
    tested = s.select(t.alias("t_stat"), df.cast("long").alias("df"))
    return tested.select("t_stat", "df", student_p("t_stat", "df").alias("p_value")).withColumn(
        "significant", F.col("p_value") < 0.05
    )


def compare_qc(results: DataFrame) -> DataFrame:
    """Success rates and summed profiles per method, and per method and channel (NULL channel = all)."""
    r = F.col("success_rate")
    return (
        results.groupingSets([["method"], ["method", "channel"]], "method", "channel")
        .agg(
            F.avg(r).alias("mean_rate"),
            F.stddev_samp(r).alias("sd_rate"),
            F.min(r).alias("min_rate"),
            F.max(r).alias("max_rate"),
            F.sum("total_profiles").alias("total_profiles"),
            F.sum("n_success").alias("n_success"),
        )
        .withColumn("failure", F.col("total_profiles") - F.col("n_success"))
    )


def kept_vs_filtered(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean, sample sd, median and n per metric for all, kept and filtered slices.

    A slice is one row with a column for each metric; its part decides which columns of the three parts hold a value.
    """
    rows = stored(df.select(F.coalesce("kept", F.lit(False)).alias("kept"), *[F.col(m).cast("double").alias(m) for m in metrics]))
    parts = {"all": F.lit(True), "kept": F.col("kept"), "filtered": ~F.col("kept")}
    value = {(p, m): f"{p}/{m}" for p in parts for m in metrics}
    wide = rows.select(*[F.when(parts[p], F.col(m)).alias(c) for (p, m), c in value.items()])
    numbers = [f(c).alias(f"{n}/{c}") for c in value.values() for n, f in (("mean", F.avg), ("sd", F.stddev_samp), ("n", F.count))]
    each = [
        F.struct(F.lit(p).alias("part"), F.lit(m).alias("metric"), *[F.col(f"{n}/{c}").alias(n) for n in ("mean", "sd", "n")])
        for (p, m), c in value.items()
    ]
    stats = wide.agg(*numbers).select(F.explode(F.array(*each)).alias("_s")).select("_s.*").filter("n > 0")
    mid = quantiles(wide, [], list(value.values()), [0.5])
    name = F.split("metric", "/")
    mid = mid.select(name[0].alias("part"), F.array_join(F.slice(name, 2, 2**31 - 1), "/").alias("metric"), F.col("q").alias("median"))
    return stats.join(mid, ["part", "metric"])


def filtered_share(df: DataFrame) -> DataFrame:
    """Per field: slices in total, kept, filtered, and the filtered percentage."""
    kept = F.count_if(F.col("kept"))
    return df.groupBy("fov_id").agg(
        F.count("*").alias("total"),
        kept.alias("kept"),
        (F.count("*") - kept).alias("filtered"),
        ((F.count("*") - kept) * 100.0 / F.count("*")).alias("pct_filtered"),
    )
