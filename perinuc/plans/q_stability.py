"""Queries on registration noise, drift and pass or fail."""

from __future__ import annotations

from pyspark.sql import functions as F

from perinuc.functions.scalars import rss
from perinuc.operators import stability as st
from perinuc.plans.registry import query

RSS = "sqrt({y} * {y} + {x} * {x} + ({a} * 375e-1) * ({a} * 375e-1) + ({s} * 375e-1) * ({s} * 375e-1))"


def _rss(y: str, x: str, a: str, s: str) -> str:
    return RSS.replace("{y}", y).replace("{x}", x).replace("{a}", a).replace("{s}", s)


SPREAD = _rss("stddev_pop(shift_y)", "stddev_pop(shift_x)", "stddev_pop(angle)", "stddev_pop(scale)")
SIGMA = f"CASE WHEN count(*) < 2 THEN 5e-1 ELSE {SPREAD} END"
DRIFT = _rss("(b.shift_y - a.shift_y)", "(b.shift_x - a.shift_x)", "(b.angle - a.angle)", "(b.scale - a.scale)")

NE_REPORT = f"""
sig AS (SELECT mode, fov_id, ne_label, {SIGMA} AS sigma FROM {{reg_slice}} x GROUP BY ALL),
dr AS (SELECT a.fov_id, a.ne_label, {DRIFT} AS drift, b.shift_x - a.shift_x AS dx, b.shift_y - a.shift_y AS dy,
              b.fov_id IS NULL AS missing
       FROM {{reg_label}} a LEFT JOIN {{reg_label}} b ON a.fov_id = b.fov_id AND a.ne_label = b.ne_label AND b.mode = 2
       WHERE a.mode = 1),
sc AS (SELECT dr.*, s1.sigma AS sigma_m1,
              CASE WHEN missing THEN s1.sigma * 1414e-3 ELSE sqrt(s1.sigma * s1.sigma + s2.sigma * s2.sigma) END AS sigma_combined
       FROM dr JOIN sig s1 ON s1.mode = 1 AND s1.fov_id = dr.fov_id AND s1.ne_label = dr.ne_label
       LEFT JOIN sig s2 ON s2.mode = 2 AND s2.fov_id = dr.fov_id AND s2.ne_label = dr.ne_label),
ne AS (SELECT sc.fov_id, sc.ne_label, p.ch2_label, p.ch2_label IS NOT NULL AS is_paired,
              CASE WHEN missing OR round(drift, 9) > round(2 * sigma_combined, 9) THEN 'failed' ELSE 'passed' END AS status,
              CASE WHEN missing THEN 'missing_in_mode2' WHEN round(drift, 9) > round(2 * sigma_combined, 9)
                   THEN printf('Unstable_Drift (%.3f > %.3f)', drift, 2 * sigma_combined) END AS fail_reason,
              coalesce(drift, -1e0) AS drift, coalesce(dx, 0e0) AS drift_dx, coalesce(dy, 0e0) AS drift_dy,
              sigma_m1, sigma_combined, 2 * sigma_combined AS threshold
       FROM sc LEFT JOIN {{reg_pairs}} p ON p.fov_id = sc.fov_id AND p.ch1_label = sc.ne_label)
"""

FOV_REPORT = f"""
fd AS (SELECT a.fov_id, {DRIFT} AS drift, b.shift_x - a.shift_x AS drift_dx, b.shift_y - a.shift_y AS drift_dy
       FROM {{reg_fov}} a JOIN {{reg_fov}} b ON a.fov_id = b.fov_id AND a.mode = 1 AND b.mode = 2),
lim AS (SELECT 2 * coalesce(sqrt(avg(drift * drift)), 5e-1) AS threshold FROM fd),
fr AS (SELECT fd.*, threshold,
              CASE WHEN round(drift, 9) > round(threshold, 9) THEN 'failed' ELSE 'passed' END AS status,
              CASE WHEN round(drift, 9) > round(threshold, 9)
                   THEN printf('FoV_Drift (%.3f > %.3f)', drift, threshold) END AS reason
       FROM fd, lim),
fe AS (SELECT l.fov_id, l.ne_label, fr.status, fr.reason, fr.drift, fr.drift_dx, fr.drift_dy
       FROM {{reg_label}} l JOIN fr ON l.fov_id = fr.fov_id WHERE l.mode = 1)
"""


def ne_report(v):
    return st.ne_stability(v("reg_label"), v("reg_slice"), v("reg_pairs"))


def fov_report(v):
    return st.fov_stability(v("reg_fov"))


@query(
    "a7_ne_stability",
    f"""WITH {NE_REPORT} SELECT fov_id, ne_label, ch2_label, is_paired, status, fail_reason, R(drift) AS drift,
        R(drift_dx) AS drift_dx, R(drift_dy) AS drift_dy, R(sigma_m1) AS sigma_m1,
        R(sigma_combined) AS sigma_combined, R(threshold) AS threshold FROM ne""",
)
def _(v):
    return ne_report(v)


@query(
    "a8_fov_stability",
    f"""WITH {FOV_REPORT} SELECT fov_id, R(drift) AS drift, R(drift_dx) AS drift_dx, R(drift_dy) AS drift_dy,
        R(threshold) AS threshold, status, reason FROM fr""",
)
def _(v):
    return fov_report(v)


@query(
    "a8_fov_expansion",
    f"""WITH {FOV_REPORT} SELECT fov_id, ne_label, status, reason, R(drift) AS drift, R(drift_dx) AS drift_dx,
        R(drift_dy) AS drift_dy FROM fe""",
)
def _(v):
    return st.expand_to_nuclei(fov_report(v), v("reg_label"))


@query(
    "a10_compare_stability",
    f"""WITH {NE_REPORT.strip()}, {FOV_REPORT.strip()},
        b AS (SELECT coalesce(ne.fov_id, fe.fov_id) AS fov_id, fe.status AS by_fov, ne.status AS by_ne
              FROM fe FULL JOIN ne ON fe.fov_id = ne.fov_id AND fe.ne_label = ne.ne_label),
        c AS (SELECT b.fov_id, count(*) AS detected,
                     CASE WHEN max(fr.status) = 'failed' THEN count(*) ELSE 0 END AS pruned_fov_method,
                     count(*) FILTER (by_ne = 'failed') AS pruned_ne_method,
                     count(*) FILTER (by_fov = by_ne) AS method_agreement
              FROM b LEFT JOIN fr ON b.fov_id = fr.fov_id GROUP BY b.fov_id)
        SELECT fov_id, I(sum(detected)) AS detected, I(sum(pruned_fov_method)) AS pruned_fov_method,
               I(sum(pruned_ne_method)) AS pruned_ne_method, I(sum(method_agreement)) AS method_agreement,
               I(sum(pruned_fov_method) - sum(pruned_ne_method)) AS diff
        FROM c GROUP BY ROLLUP (fov_id)""",
)
def _(v):
    fov = fov_report(v)
    return st.compare_stability(fov, st.expand_to_nuclei(fov, v("reg_label")), ne_report(v))


@query(
    "a4_slice_sigma",
    f"""SELECT mode, fov_id, ne_label, count(*) AS n, R({SIGMA}) AS sigma FROM {{reg_slice}} s GROUP BY mode, fov_id, ne_label""",
)
def _(v):
    return st.slice_sigma(v("reg_slice"))


@query(
    "a5_slice_sigma_shift_only",
    """SELECT s.mode, s.fov_id, s.ne_label, count(*) AS n,
              R(CASE WHEN count(*) > 1 THEN sqrt(pow(stddev_pop(s.shift_y), 2) + pow(stddev_pop(s.shift_x), 2))
                     ELSE max(f.ch_reg_prec) END) AS sigma_reg
       FROM {reg_slice} s LEFT JOIN {reg_fov} f ON f.mode = s.mode AND f.fov_id = s.fov_id
       GROUP BY s.mode, s.fov_id, s.ne_label""",
)
def _(v):
    return st.slice_sigma_shift_only(v("reg_slice"), v("reg_fov"))


@query(
    "a6_signal",
    f"""SELECT mode, fov_id, ne_label, R({_rss("shift_y", "shift_x", "angle", "(scale - 1)")}) AS signal
        FROM {{reg_label}} l""",
)
def _(v):
    return st.signal(v("reg_label"))


@query(
    "p8_rss",
    f"""SELECT mode, fov_id, ne_label, slice_id, R({_rss("shift_y", "shift_x", "angle", "(scale - 1)")}) AS rss
        FROM {{reg_slice}} l""",
)
def _(v):
    size = rss("shift_y", "shift_x", "angle", F.col("scale") - 1.0)
    return v("reg_slice").select("mode", "fov_id", "ne_label", "slice_id", size.alias("rss"))


@query(
    "j4_drift_map",
    f"""SELECT a.fov_id, a.ne_label, R({DRIFT}) AS drift, R(b.shift_y - a.shift_y) AS dy, R(b.shift_x - a.shift_x) AS dx,
               R(b.angle - a.angle) AS da, R(b.scale - a.scale) AS ds
        FROM {{reg_label}} a LEFT JOIN {{reg_label}} b ON a.fov_id = b.fov_id AND a.ne_label = b.ne_label AND b.mode = 2
        WHERE a.mode = 1""",
)
def _(v):
    return st.drift_map(v("reg_label"))


@query(
    "j5_fov_drift",
    f"""SELECT a.fov_id, R({DRIFT}) AS drift, R(b.shift_y - a.shift_y) AS dy, R(b.shift_x - a.shift_x) AS dx,
               R(b.angle - a.angle) AS da, R(b.scale - a.scale) AS ds
        FROM {{reg_fov}} a JOIN {{reg_fov}} b ON a.fov_id = b.fov_id AND a.mode = 1 AND b.mode = 2""",
)
def _(v):
    return st.fov_drift(v("reg_fov"))


@query(
    "a11_pooled_stability",
    f"""WITH s AS (SELECT fov_id, ne_label, {SIGMA} AS sigma FROM {{reg_slice}} x WHERE mode = 1 GROUP BY ALL),
        p AS (SELECT fov_id, sqrt(avg(sigma * sigma)) AS sigma_fov FROM s GROUP BY fov_id),
        d AS (SELECT a.fov_id, a.ne_label, {DRIFT} AS drift, sigma_fov, 2 * sigma_fov AS threshold
              FROM {{reg_label}} a JOIN p ON p.fov_id = a.fov_id
              LEFT JOIN {{reg_label}} b ON a.fov_id = b.fov_id AND a.ne_label = b.ne_label AND b.mode = 2
              WHERE a.mode = 1)
        SELECT fov_id, ne_label,
               CASE WHEN drift IS NULL OR round(drift, 9) > round(threshold, 9) THEN 'failed' ELSE 'passed' END AS status,
               R(coalesce(drift, -1e0)) AS drift, R(sigma_fov) AS sigma_fov, R(threshold) AS threshold,
               CASE WHEN drift IS NULL THEN 'missing_in_mode2' WHEN round(drift, 9) > round(threshold, 9)
                    THEN printf('unstable (%.3f > %.3f)', drift, threshold) END AS reason
        FROM d""",
)
def _(v):
    return st.pooled_stability(v("reg_label"), v("reg_slice"))


def _delta(keys: str) -> str:
    return f"""SELECT {", ".join("a." + k for k in keys.split())}, b.angle - a.angle AS angle_delta,
               b.scale - a.scale AS scale_delta, b.shift_y - a.shift_y AS rdif_y, b.shift_x - a.shift_x AS rdif_x
               FROM {{T}} a JOIN {{T}} b ON a.mode = 1 AND b.mode = 2
               AND {" AND ".join(f"a.{k} = b.{k}" for k in keys.split())}"""


_LEVELS = {"fov": ("reg_fov", "fov_id"), "label": ("reg_label", "fov_id ne_label"), "slice": ("reg_slice", "fov_id ne_label slice_id")}


@query(
    "a12_delta_stats",
    " UNION ALL ".join(
        f"""SELECT '{level}' AS level, count(*) AS n,
            R(sqrt(pow(stddev_pop(rdif_y), 2) + pow(stddev_pop(rdif_x), 2))) AS sigma_reg,
            R(avg(angle_delta)) AS angle_mean, R(stddev_pop(angle_delta)) AS angle_std,
            R(avg(scale_delta)) AS scale_mean, R(stddev_pop(scale_delta)) AS scale_std,
            R(avg(rdif_y)) AS rdif_y_mean, R(stddev_pop(rdif_y)) AS rdif_y_std,
            R(avg(rdif_x)) AS rdif_x_mean, R(stddev_pop(rdif_x)) AS rdif_x_std
            FROM ({_delta(keys).replace("{T}", "{" + t + "}")}) d"""
        for level, (t, keys) in _LEVELS.items()
    ),
)
def _(v):
    parts = [
        st.delta_stats(st.mode_delta(v(t), keys.split()), level) for level, (t, keys) in _LEVELS.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "a12_mode_delta",
    f"""SELECT fov_id, ne_label, slice_id, R(angle_delta) AS angle_delta, R(scale_delta) AS scale_delta,
               R(rdif_y) AS rdif_y, R(rdif_x) AS rdif_x, R(sqrt(rdif_y * rdif_y + rdif_x * rdif_x)) AS rdif
        FROM ({_delta("fov_id ne_label slice_id").replace("{T}", "{reg_slice}")}) d""",
)
def _(v):
    return st.mode_delta(v("reg_slice"), ["fov_id", "ne_label", "slice_id"])


@query(
    "j11_effective_registration",
    """WITH c2 AS (SELECT DISTINCT fov_id, ne_label FROM {reg_label} l),
       j AS (SELECT b.mode, c2.fov_id, c2.ne_label, p.ch1_label, r.scale AS ls, r.angle AS la, r.shift_y AS ly, r.shift_x AS lx,
                    f.scale AS fs, f.angle AS fa, f.shift_y AS fy, f.shift_x AS fx
             FROM c2 CROSS JOIN (VALUES (1), (2)) b(mode) LEFT JOIN {reg_pairs} p ON p.fov_id = c2.fov_id AND p.ch2_label = c2.ne_label
             LEFT JOIN {reg_label} r ON r.mode = b.mode AND r.fov_id = c2.fov_id AND r.ne_label = p.ch1_label
             LEFT JOIN {reg_fov} f ON f.mode = b.mode AND f.fov_id = c2.fov_id)
       SELECT mode, fov_id, ne_label, ch1_label,
              CASE WHEN ch1_label IS NULL THEN 'identity' WHEN ls IS NOT NULL THEN 'label'
                   WHEN fs IS NOT NULL THEN 'fov' ELSE 'identity' END AS source,
              R(CASE WHEN ch1_label IS NULL THEN 1e0 ELSE coalesce(ls, fs, 1e0) END) AS scale,
              R(CASE WHEN ch1_label IS NULL THEN 0e0 ELSE coalesce(la, fa, 0e0) END) AS angle,
              R(CASE WHEN ch1_label IS NULL THEN 0e0 ELSE coalesce(ly, fy, 0e0) END) AS shift_y,
              R(CASE WHEN ch1_label IS NULL THEN 0e0 ELSE coalesce(lx, fx, 0e0) END) AS shift_x
       FROM j""",
)
def _(v):
    nuclei = v("reg_label").select("fov_id", "ne_label").distinct()
    label, field = v("reg_label"), v("reg_fov")
    one, two = (
        st.effective_registration(
            nuclei, v("reg_pairs"), label.filter(F.col("mode") == m), field.filter(F.col("mode") == m)
        ).withColumn("mode", F.lit(m))
        for m in (1, 2)
    )
    return one.unionByName(two)


@query(
    "j12_prune_nuclei",
    f"""WITH {NE_REPORT} SELECT p.fov_id, p.ch1_label, p.ch2_label FROM {{reg_pairs}} p
        WHERE NOT EXISTS (SELECT 1 FROM ne WHERE ne.status = 'failed' AND ne.fov_id = p.fov_id AND ne.ne_label = p.ch1_label)""",
)
def _(v):
    return st.prune_nuclei(v("reg_pairs"), ne_report(v))


@query(
    "j12_prune_fovs",
    f"""WITH {FOV_REPORT} SELECT p.fov_id, p.ch1_label, p.ch2_label FROM {{reg_pairs}} p
        WHERE p.fov_id NOT IN (SELECT fov_id FROM fr WHERE status = 'failed')""",
)
def _(v):
    return st.prune_fovs(v("reg_pairs"), fov_report(v))


@query(
    "j12_pruned_counts",
    f"""WITH {NE_REPORT.strip()}, {FOV_REPORT.strip()}
        SELECT 'ne' AS method, count(*) AS pruned FROM ne WHERE status = 'failed'
        UNION ALL SELECT 'fov', count(*) FROM fr WHERE status = 'failed'
             AND fov_id IN (SELECT fov_id FROM {{reg_pairs}} p)""",
)
def _(v):
    return st.pruned_counts(v("reg_pairs"), ne_report(v), fov_report(v))
