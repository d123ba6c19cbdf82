"""Queries on grouped statistics, the experiment key, histograms and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from perinuc.functions import scalars as sc
from perinuc.operators import summary as sm
from perinuc.plans.registry import query

PARTS = ["scale", "angle", "shift_x", "shift_y"]


def _stats(cols, propagate=True) -> str:
    out = ["count(*) AS n"]
    for c in cols:
        for name, expr in (
            ("mean", f"avg({c})"),
            ("sd", f"stddev_samp({c})"),
            ("median", f"quantile_cont({c}, 5e-1)"),
        ):
            whole = f"CASE WHEN count({c}) = count(*) THEN {expr} END" if propagate else expr
            out.append(f"R({whole}) AS {c}_{name}")
        out.append(f"R(quantile_cont({c}, 75e-2) - quantile_cont({c}, 25e-2)) AS {c}_IQR")
    return ", ".join(out)


@query(
    "a1_summary_stats",
    f"""SELECT strain, date, mode, addl_info, {_stats(PARTS)} FROM {{label_results}} r
        GROUP BY strain, date, mode, addl_info""",
)
def _(v):
    return sm.summary_stats(v("label_results"), ["strain", "date", "mode", "addl_info"], PARTS)


@query(
    "a1_summary_stats_skip",
    f"""SELECT strain, fov_id, mode, {_stats(["angle", "shift_y"], False)} FROM {{label_results}} r
        GROUP BY strain, fov_id, mode""",
)
def _(v):
    return sm.summary_stats(v("label_results"), ["strain", "fov_id", "mode"], ["angle", "shift_y"], na="skip")


@query(
    "a2_unit_counts",
    """SELECT k.*, n.FoV_count FROM {experiment_key} k JOIN
       (SELECT strain, date, addl_info, count(*) AS FoV_count FROM {experiment_key} q GROUP BY ALL) n
       ON k.strain = n.strain AND k.date = n.date AND k.addl_info IS NOT DISTINCT FROM n.addl_info""",
)
def _(v):
    return sm.unit_counts(v("experiment_key"), ["strain", "date", "addl_info"])


@query(
    "a3_nest_ids",
    """SELECT strain, date, addl_info, I(0) AS page, string_agg(fov_id, ',' ORDER BY fov_id) AS ids
       FROM {experiment_key} k GROUP BY strain, date, addl_info""",
)
def _(v):
    nested = sm.nest_ids(v("experiment_key"), ["strain", "date", "addl_info"], "fov_id")
    return nested.withColumn("ids", F.concat_ws(",", "ids"))


@query(
    "a3_experiment_count",
    "SELECT count(*) AS experiments FROM (SELECT DISTINCT strain, date, addl_info FROM {experiment_key} k) t",
)
def _(v):
    key = v("experiment_key")
    return key.select("strain", "date", "addl_info").distinct().agg(F.count("*").alias("experiments"))


@query(
    "j1_join_key",
    """SELECT k.strain, k.date, k.addl_info, k.fov_id, r.mode, R(r.scale) AS scale, R(r.angle) AS angle,
              R(r.shift_y) AS shift_y, R(r.shift_x) AS shift_x
       FROM {experiment_key} k LEFT JOIN {fov_results} r ON k.strain = r.strain AND k.fov_id = r.fov_id""",
)
def _(v):
    return sm.join_key(v("experiment_key"), v("fov_results"))


STRAINS = ["BMY1401", "BMY1403", "BMY1405"]


@query(
    "p4_member_filter",
    """SELECT strain, date, addl_info, fov_id FROM {experiment_key} k
       WHERE strain IN ('BMY1401', 'BMY1403', 'BMY1405')""",
)
def _(v):
    return sm.member_filter(v("experiment_key"), "strain", STRAINS)


@query(
    "s14_load_results",
    """SELECT k.strain, k.date, k.addl_info, k.fov_id, r.mode, R(r.scale) AS scale, R(r.angle) AS angle,
              R(r.shift_y) AS shift_y, R(r.shift_x) AS shift_x
       FROM {experiment_key} k LEFT JOIN (SELECT * FROM {fov_results} x
            WHERE strain IN ('BMY1401', 'BMY1403', 'BMY1405')) r ON k.strain = r.strain AND k.fov_id = r.fov_id""",
)
def _(v):
    return sm.load_results(v("fov_results"), STRAINS, v("experiment_key"))


BY = ["strain", "date", "mode", "addl_info"]


@query(
    "j2_rejoin_summary",
    """WITH r AS (SELECT * FROM {label_results} x),
       s AS (SELECT strain, date, mode, addl_info, count(*) AS ne_count, avg(scale) AS scale_mean,
                    stddev_samp(scale) AS scale_sd, quantile_cont(scale, 5e-1) AS scale_median,
                    quantile_cont(scale, 75e-2) - quantile_cont(scale, 25e-2) AS scale_IQR
             FROM r GROUP BY ALL)
       SELECT r.strain, r.date, r.addl_info, r.mode, r.fov_id, r.ne_label, R(r.scale) AS scale, R(r.angle) AS angle,
              R(r.shift_y) AS shift_y, R(r.shift_x) AS shift_x, s.ne_count, R(s.scale_mean) AS scale_mean,
              R(s.scale_sd) AS scale_sd, R(s.scale_median) AS scale_median, R(s.scale_IQR) AS scale_IQR,
              r.strain || ' | ' || r.date || ' | ' || coalesce(r.addl_info, 'NA') AS exper
       FROM r LEFT JOIN s ON r.strain = s.strain AND r.date = s.date AND r.mode = s.mode
            AND r.addl_info IS NOT DISTINCT FROM s.addl_info""",
)
def _(v):
    return sm.rejoin_summary(v("label_results"), BY, ["scale"], ["strain", "date", "addl_info"])


DIFF = """d AS (SELECT a.strain, a.date, a.fov_id, a.scale - b.scale AS scale_diff, a.angle - b.angle AS angle_diff,
                       a.shift_y - b.shift_y AS shift_y_diff, a.shift_x - b.shift_x AS shift_x_diff
                FROM (SELECT k.*, r.mode, r.scale, r.angle, r.shift_y, r.shift_x FROM {experiment_key} k
                      JOIN {fov_results} r ON k.fov_id = r.fov_id WHERE r.mode = 'mode1') a
                LEFT JOIN (SELECT k.*, r.mode, r.scale, r.angle, r.shift_y, r.shift_x FROM {experiment_key} k
                      JOIN {fov_results} r ON k.fov_id = r.fov_id WHERE r.mode = 'mode2') b
                ON a.strain = b.strain AND a.date = b.date AND a.fov_id = b.fov_id)"""


def _keyed(v):
    return sm.join_key(v("experiment_key"), v("fov_results"))


@query(
    "j3_mode_diff",
    f"""WITH {DIFF} SELECT strain, date, fov_id, R(scale_diff) AS scale_diff, R(angle_diff) AS angle_diff,
        R(shift_y_diff) AS shift_y_diff, R(shift_x_diff) AS shift_x_diff FROM d""",
)
def _(v):
    return sm.mode_diff(_keyed(v))


@query(
    "a13_registration_precision",
    f"""WITH {DIFF} SELECT strain, date, count(*) AS n, R(stddev_samp(shift_y_diff)) AS shift_y_diff_sd,
        R(stddev_samp(shift_x_diff)) AS shift_x_diff_sd,
        R(sqrt(pow(stddev_samp(shift_y_diff), 2) + pow(stddev_samp(shift_x_diff), 2))) AS reg_prec
        FROM d GROUP BY strain, date""",
)
def _(v):
    return sm.registration_precision(sm.mode_diff(_keyed(v)), ["strain", "date"])


@query(
    "a14_scott_width",
    """SELECT strain, mode, count(*) AS n, R(349e-2 * stddev_samp(shift_y) * pow(count(*), -1e0 / 3)) AS width
       FROM {label_results} r GROUP BY strain, mode""",
)
def _(v):
    return sm.scott_width(v("label_results"), "shift_y", ["strain", "mode"])


@query(
    "a14_scott_width_global",
    """SELECT count(*) AS n, R(349e-2 * stddev_samp(shift_y) * pow(count(*), -1e0 / 3)) AS width
       FROM {label_results} r""",
)
def _(v):
    return sm.scott_width(v("label_results"), "shift_y")


def _by_width(lo: str, hi: str) -> str:
    return f"""WITH f AS (SELECT 349e-2 * stddev_samp(dist_nm) * pow(count(*), -1e0 / 3) AS width, min(dist_nm) AS lo,
                    {lo} AS x_min, {hi} AS x_max FROM {{distances}} d),
       c AS (SELECT pair_type, I(greatest(ceil(dist_nm / width) - 1, floor(lo / width))) AS bin, width, x_min, x_max,
                    count(*) AS n FROM {{distances}} d, f GROUP BY ALL)
       SELECT pair_type, bin, R(bin * width) AS lower, R((bin + 1) * width) AS upper, n, R(x_min) AS x_min,
              R(x_max) AS x_max, (SELECT max(n) FROM c) AS y_max FROM c"""


@query("a15_histogram_by_width", _by_width("min(dist_nm)", "max(dist_nm)"))
def _(v):
    return sm.histogram_by_width(v("distances"), "dist_nm", ["pair_type"])


@query(
    "a15_histogram_3sd",
    _by_width("avg(dist_nm) - 3 * stddev_samp(dist_nm)", "avg(dist_nm) + 3 * stddev_samp(dist_nm)"),
)
def _(v):
    return sm.histogram_by_width(v("distances"), "dist_nm", ["pair_type"], limits="3sd")


@query(
    "a15_histogram_own_width",
    """WITH g AS (SELECT pair_type, 349e-2 * stddev_samp(dist_nm) * pow(count(*), -1e0 / 3) AS width, min(dist_nm) AS lo
                  FROM {distances} d GROUP BY pair_type),
       f AS (SELECT min(dist_nm) AS x_min, max(dist_nm) AS x_max FROM {distances} d),
       c AS (SELECT pair_type, I(greatest(ceil(dist_nm / width) - 1, floor(lo / width))) AS bin, width, x_min, x_max,
                    count(*) AS n FROM {distances} d JOIN g USING (pair_type), f GROUP BY ALL)
       SELECT pair_type, bin, R(bin * width) AS lower, R((bin + 1) * width) AS upper, n, R(x_min) AS x_min,
              R(x_max) AS x_max, (SELECT max(n) FROM c) AS y_max FROM c""",
)
def _(v):
    return sm.histogram_by_width(v("distances"), "dist_nm", ["pair_type"], own_width=True)


@query(
    "a16_histogram_n",
    """WITH f AS (SELECT min(dist_nm) AS lo, (max(dist_nm) - min(dist_nm)) / 5e1 AS w, count(*) AS t FROM {distances} d)
       SELECT I(least(floor((dist_nm - lo) / w), 49)) AS bin, R(lo + bin * w) AS lower, R(lo + (bin + 1) * w) AS upper,
              count(*) AS n, R(count(*) / (t * w)) AS density
       FROM {distances} d, f GROUP BY 1, lo, w, t""",
)
def _(v):
    return sm.histogram_n(v("distances"), "dist_nm", 50, density=True)


@query(
    "a17_normal_fit_and_box",
    """SELECT pair_type, count(*) AS n, R(avg(dist_nm)) AS mu, R(stddev_pop(dist_nm)) AS sigma, R(avg(dist_nm)) AS mean,
              R(stddev_samp(dist_nm)) AS sd, R(min(dist_nm)) AS min, R(max(dist_nm)) AS max,
              R(quantile_cont(dist_nm, 5e-1)) AS median
       FROM {distances} d GROUP BY pair_type HAVING count(*) >= 2""",
)
def _(v):
    return sm.normal_fit_and_box(v("distances"), "dist_nm", ["pair_type"])


@query(
    "a17_normal_fit_all",
    """SELECT count(*) AS n, R(avg(dist_nm)) AS mu, R(stddev_pop(dist_nm)) AS sigma, R(avg(dist_nm)) AS mean,
              R(stddev_samp(dist_nm)) AS sd, R(min(dist_nm)) AS min, R(max(dist_nm)) AS max,
              R(quantile_cont(dist_nm, 5e-1)) AS median FROM {distances} d""",
)
def _(v):
    return sm.normal_fit_and_box(v("distances"), "dist_nm")


def _kinds() -> str:
    out = []
    for t in sm.PAIR_TYPES:
        f = f"FILTER (pair_type = '{t}')"
        out.append(f"avg(dist_nm) {f} AS {t}_mean")
        out.append(f"CASE WHEN count(*) {f} > 1 THEN stddev_pop(dist_nm) {f} END AS {t}_std")
        out.append(f"count(*) {f} AS n_{t}_points")
    return ", ".join(out)


STATS = f"""st AS (SELECT fov_id, ch1_label, ch2_label, avg(dist_nm) AS mean_distance, stddev_pop(dist_nm) AS std_distance,
               min(dist_nm) AS min_distance, max(dist_nm) AS max_distance, count(*) AS n_points, 128e0 AS pixel_size_nm,
               {_kinds()}, quantile_cont(dist_nm, 5e-1) AS median_distance FROM {{distances}} d GROUP BY ALL)"""
STAT_COLS = ["mean_distance", "std_distance", "min_distance", "max_distance", "pixel_size_nm", "median_distance"] + [
    f"{t}_{k}" for t in sm.PAIR_TYPES for k in ("mean", "std")
]
STAT_SELECT = ", ".join(
    ["fov_id", "ch1_label", "ch2_label", "n_points"]
    + [f"n_{t}_points" for t in sm.PAIR_TYPES]
    + [f"R({c}) AS {c}" for c in STAT_COLS]
)


@query("a18_distance_stats", f"WITH {STATS} SELECT {STAT_SELECT} FROM st")
def _(v):
    return sm.distance_stats(v("distances"))


@query(
    "p6_plausible",
    f"""WITH {STATS} SELECT {STAT_SELECT}, CASE WHEN abs(mean_distance) < 200 THEN 'green' ELSE 'orange' END AS color
        FROM st WHERE abs(mean_distance) < 500""",
)
def _(v):
    return sm.plausible(sm.distance_stats(v("distances")))


@query(
    "a19_distance_summary",
    f"""WITH {STATS}, g AS (SELECT fov_id, ch1_label, ch2_label FROM st WHERE abs(mean_distance) < 500)
        SELECT (SELECT count(*) FROM g) AS n_valid_pairs, count(*) AS n_total_measurements,
               R(avg(dist_nm)) AS overall_mean_nm, R(stddev_pop(dist_nm)) AS overall_std_nm,
               R(quantile_cont(dist_nm, 5e-1)) AS overall_median_nm, R(min(dist_nm)) AS min_nm, R(max(dist_nm)) AS max_nm
        FROM {{distances}} d JOIN g USING (fov_id, ch1_label, ch2_label)""",
)
def _(v):
    d = v("distances")
    return sm.distance_summary(sm.distance_stats(d), d)


@query(
    "a19_pair_details",
    f"""WITH {STATS} SELECT fov_id, ch1_label || '_vs_' || ch2_label AS pair, R(mean_distance) AS mean,
        R(std_distance) AS std, R(median_distance) AS median, n_points, R(data_data_mean) AS data_data_mean
        FROM st WHERE abs(mean_distance) < 500""",
)
def _(v):
    good = sm.plausible(sm.distance_stats(v("distances")))
    return sm.sorted_pairs(good).select(
        "fov_id",
        F.concat_ws("_vs_", "ch1_label", "ch2_label").alias("pair"),
        F.col("mean_distance").alias("mean"),
        F.col("std_distance").alias("std"),
        F.col("median_distance").alias("median"),
        "n_points",
        "data_data_mean",
    )


@query(
    "w15_first_pair",
    f"""WITH {STATS} SELECT fov_id, ch1_label, ch2_label, R(mean_distance) AS mean_distance FROM st
        WHERE abs(mean_distance) < 500 ORDER BY st.mean_distance, fov_id, ch1_label, ch2_label LIMIT 1""",
)
def _(v):
    good = sm.plausible(sm.distance_stats(v("distances")))
    return sm.sorted_pairs(good, n=1).select(*sm.PAIR, "mean_distance")


@query(
    "w1_row_index",
    """SELECT fov_id, ch1_label, ch2_label, okey, lnum, pkey, R(dist_nm) AS dist_nm,
              row_number() OVER (PARTITION BY fov_id, ch1_label, ch2_label ORDER BY okey, lnum, pkey, d.dist_nm) - 1 AS dist_idx
       FROM {distances} d""",
)
def _(v):
    indexed = sm.row_index(v("distances"), sm.PAIR, ["okey", "lnum", "pkey", "dist_nm"])
    return indexed.drop("pair_type")


LOG = f"""{STATS}, lg AS (SELECT fov_id, ch1_label AS ne_ch1, ch2_label AS ne_ch2, mean_distance, median_distance,
          std_distance, min_distance, max_distance, n_points AS n_points_sampled,
          n_data_data_points / n_points AS rate FROM st)"""


@query(
    "a20_distance_log",
    f"""WITH {LOG} SELECT fov_id, ne_ch1, ne_ch2, R(mean_distance) AS mean_distance, R(median_distance) AS median_distance,
        R(std_distance) AS std_distance, R(min_distance) AS min_distance, R(max_distance) AS max_distance,
        n_points_sampled, R(rate) AS ch1_success_rate, R(rate) AS ch2_success_rate FROM lg""",
)
def _(v):
    return sm.distance_log(sm.distance_stats(v("distances")))


@query(
    "a20_distance_log_stats",
    f"""WITH {LOG} SELECT fov_id, count(*) AS n_pairs_calculated, R(avg(mean_distance)) AS overall_mean_distance,
        R(stddev_samp(mean_distance)) AS overall_std_distance, R(min(mean_distance)) AS distance_min,
        R(max(mean_distance)) AS distance_max FROM lg GROUP BY fov_id""",
)
def _(v):
    return sm.distance_log_stats(sm.distance_log(sm.distance_stats(v("distances"))))


QUALITY = """q AS (SELECT fov_id, channel, ne_label, seg_label, count(*) AS n_total,
    count(*) FILTER (status = 'success') AS n_success, count(*) FILTER (status = 'fail:likelihood_ratio') AS n_likelihood_fail,
    count(*) FILTER (status = 'fail:all_step_sizes') AS n_optimization_fail, count(*) FILTER (was_reverted) AS n_curvature_fail
    FROM {profile_log} p GROUP BY ALL)"""


@query(
    "a21_segment_quality",
    f"""WITH {QUALITY} SELECT *, R(n_success / n_total) AS success_rate, R(n_curvature_fail / n_total) AS curvature_fail_rate
        FROM q""",
)
def _(v):
    return sm.segment_quality(v("profile_log"))


@query(
    "a20_quality_log_stats",
    f"""WITH {QUALITY} SELECT fov_id, channel, R(avg(n_success / n_total)) AS overall_success_rate,
        R(avg(n_curvature_fail / n_total)) AS curvature_fail_rate, I(sum(n_total)) AS n_total,
        I(sum(n_success)) AS n_success, I(sum(n_curvature_fail)) AS n_curvature_fail,
        I(sum(n_likelihood_fail)) AS n_likelihood_fail, I(sum(n_optimization_fail)) AS n_optimization_fail
        FROM q GROUP BY fov_id, channel""",
)
def _(v):
    return sm.quality_log_stats(sm.segment_quality(v("profile_log")))


@query(
    "a22_status_summary",
    """SELECT fov_id, channel, status, count(*) AS n, I(sum(count(*)) OVER (PARTITION BY fov_id, channel)) AS total_profiles,
              R(100e0 * count(*) / sum(count(*)) OVER (PARTITION BY fov_id, channel)) AS pct,
              status <> 'success' AS in_breakdown, status LIKE 'fail%' AS is_failure,
              R(avg(intensity_mean)) AS intensity_mean, R(avg(intensity_std)) AS intensity_std,
              R(avg(intensity_range)) AS intensity_range
       FROM {profile_log} p GROUP BY fov_id, channel, status""",
)
def _(v):
    return sm.status_summary(v("profile_log"))


@query(
    "a22_label_success",
    """SELECT fov_id, channel, ne_label, count(*) AS total, count(*) FILTER (status = 'success') AS success,
              R(count(*) FILTER (status = 'success') / count(*)) AS success_rate
       FROM {profile_log} p GROUP BY fov_id, channel, ne_label""",
)
def _(v):
    return sm.label_success(v("profile_log"))


LABELLED = """lab AS (SELECT CASE WHEN pair_type = 'data_data' THEN 'With Filters' ELSE 'Without Filters' END AS filtering,
    fov_id, ch1_label, avg(dist_nm) AS mean_distance, stddev_pop(dist_nm) AS std_distance FROM {distances} d GROUP BY ALL)"""


def _labelled(v):
    label = F.when(F.col("pair_type") == "data_data", "With Filters").otherwise("Without Filters")
    return (
        v("distances")
        .groupBy(label.alias("filtering"), "fov_id", "ch1_label")
        .agg(F.avg("dist_nm").alias("mean_distance"), F.stddev_pop("dist_nm").alias("std_distance"))
    )


@query(
    "a23_filter_impact",
    f"""WITH {LABELLED} SELECT filtering, count(*) AS n, R(avg(mean_distance)) AS mean, R(stddev_samp(mean_distance)) AS sd,
        R(min(mean_distance)) AS min, R(max(mean_distance)) AS max, R(avg(std_distance)) AS mean_inner_sd,
        R(quantile_cont(mean_distance, 5e-1)) AS median FROM lab GROUP BY filtering""",
)
def _(v):
    return sm.filter_impact(_labelled(v))


T_STAT = f"""{LABELLED}, m AS (SELECT count(*) FILTER (filtering LIKE 'With F%') AS n1, count(*) FILTER (filtering LIKE 'Without%') AS n2,
          avg(mean_distance) FILTER (filtering LIKE 'With F%') AS m1, avg(mean_distance) FILTER (filtering LIKE 'Without%') AS m2,
          var_samp(mean_distance) FILTER (filtering LIKE 'With F%') AS v1, var_samp(mean_distance) FILTER (filtering LIKE 'Without%') AS v2 FROM lab),
    ts AS (SELECT (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1e0 / n1 + 1e0 / n2)) AS t_stat, n1 + n2 - 2 AS df FROM m)"""


@query("a23_t_statistic", f"WITH {T_STAT} SELECT R(t_stat) AS t_stat, df FROM ts")
def _(v):
    tested = sm.two_sample_t(_labelled(v), "mean_distance", "filtering", "With Filters", "Without Filters")
    return tested.select("t_stat", "df")


# the density of t from 0 to |t| by Simpson's rule
@query(
    "a23_t_test",
    f"""WITH {T_STAT}, pv AS (SELECT t_stat, df, 1 - 2 * exp(lgamma((df + 1) / 2e0) - lgamma(df / 2e0)) / sqrt(df * pi()) * abs(t_stat) / 6000
            * list_sum(list_transform(range(2001), lambda k: (CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)
                * pow(1 + pow(k * t_stat / 2000, 2) / df, -(df + 1) / 2e0))) AS p FROM ts)
        SELECT R(t_stat) AS t_stat, df, R(p) AS p_value, p < 5e-2 AS significant FROM pv""",
)
def _(v):
    return sm.two_sample_t(_labelled(v), "mean_distance", "filtering", "With Filters", "Without Filters")


RUNS = """runs AS (SELECT CASE WHEN was_reverted THEN 'Poisson Outlier' ELSE 'Likelihood Ratio' END AS method, channel, fov_id,
    count(*) AS total_profiles, count(*) FILTER (status = 'success') AS n_success,
    count(*) FILTER (status = 'success') / count(*) AS success_rate FROM {profile_log} p GROUP BY ALL)"""


@query(
    "a24_compare_qc",
    f"""WITH {RUNS} SELECT method, channel, R(avg(success_rate)) AS mean_rate, R(stddev_samp(success_rate)) AS sd_rate,
        R(min(success_rate)) AS min_rate, R(max(success_rate)) AS max_rate, I(sum(total_profiles)) AS total_profiles,
        I(sum(n_success)) AS n_success, I(sum(total_profiles) - sum(n_success)) AS failure
        FROM runs GROUP BY GROUPING SETS ((method), (method, channel))""",
)
def _(v):
    method = F.when(F.col("was_reverted"), "Poisson Outlier").otherwise("Likelihood Ratio")
    good = F.count_if(F.col("status") == "success")
    runs = (
        v("profile_log")
        .groupBy(method.alias("method"), "channel", "fov_id")
        .agg(F.count("*").alias("total_profiles"), good.alias("n_success"), (good / F.count("*")).alias("success_rate"))
    )
    return sm.compare_qc(runs)


METRICS = ["angle_delta", "scale_delta", "rdif_y", "rdif_x"]
SLICES = """k AS (SELECT fov_id, ne_label, slice_id, angle * 57 AS angle_delta, scale - 1 AS scale_delta, shift_y AS rdif_y,
    shift_x AS rdif_x, abs(shift_y) <= 2e-1 AS kept FROM {reg_slice} s)"""


def _slices(v):
    return v("reg_slice").select(
        "mode",
        "fov_id",
        "ne_label",
        "slice_id",
        (F.col("angle") * 57).alias("angle_delta"),
        (F.col("scale") - 1).alias("scale_delta"),
        F.col("shift_y").alias("rdif_y"),
        F.col("shift_x").alias("rdif_x"),
        (F.abs("shift_y") <= 0.2).alias("kept"),
    )


@query(
    "a25_kept_vs_filtered",
    f"""WITH {SLICES}, t AS (UNPIVOT (SELECT kept, angle_delta, scale_delta, rdif_y, rdif_x FROM k)
            ON angle_delta, scale_delta, rdif_y, rdif_x INTO NAME metric VALUE v),
        p AS (SELECT 'all' AS part, metric, v FROM t UNION ALL
              SELECT CASE WHEN kept THEN 'kept' ELSE 'filtered' END, metric, v FROM t)
        SELECT part, metric, R(avg(v)) AS mean, R(stddev_samp(v)) AS sd, count(*) AS n,
               R(quantile_cont(v, 5e-1)) AS median FROM p GROUP BY part, metric""",
)
def _(v):
    return sm.kept_vs_filtered(_slices(v), METRICS)


@query(
    "a25_filtered_share",
    f"""WITH {SLICES} SELECT fov_id, count(*) AS total, count(*) FILTER (kept) AS kept,
        count(*) FILTER (NOT kept) AS filtered, R(100e0 * (count(*) FILTER (NOT kept)) / count(*)) AS pct_filtered
        FROM k GROUP BY fov_id""",
)
def _(v):
    return sm.filtered_share(_slices(v))


@query(
    "p5_sigma_filter",
    """SELECT strain, date, addl_info, mode, fov_id, ne_label, R(scale) AS scale, R(angle) AS angle, R(shift_y) AS shift_y,
              R(shift_x) AS shift_x
       FROM (SELECT *, avg(shift_y) OVER w AS m, stddev_samp(shift_y) OVER w AS s FROM {label_results} r
             WINDOW w AS (PARTITION BY strain, date, mode, addl_info)) t
       WHERE round(abs(t.shift_y - m), 9) <= round(2 * s, 9)""",
)
def _(v):
    return sm.sigma_filter(v("label_results"), "shift_y", BY)


@query(
    "p7_units",
    """SELECT mode, fov_id, ne_label, R(shift_y * 128) AS shift_y_nm, R(shift_x * 128) AS shift_x_nm,
              R(degrees(angle)) AS angle_deg, R(sqrt(l.shift_y * l.shift_y + l.shift_x * l.shift_x)) AS shift_mag_px
       FROM {reg_label} l""",
)
def _(v):
    return v("reg_label").select(
        "mode",
        "fov_id",
        "ne_label",
        sc.to_nm("shift_y").alias("shift_y_nm"),
        sc.to_nm("shift_x").alias("shift_x_nm"),
        F.degrees("angle").alias("angle_deg"),
        sc.magnitude("shift_y", "shift_x").alias("shift_mag_px"),
    )
