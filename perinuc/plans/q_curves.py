"""Queries on ordered curves, distances between curves, and bridges."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perinuc.functions import scalars as sc
from perinuc.operators import bridging as br
from perinuc.operators import curves as cv
from perinuc.operators import stability as st
from perinuc.operators import summary as sm
from perinuc.plans.registry import query
from perinuc.scale import cut

K = "fov_id, channel, ne_label"
S = f"{K}, segment"
PI = "3141592653589793e-15"


def _w(keys: str = K, name: str = "w") -> str:
    return f"{name} AS (PARTITION BY {keys} ORDER BY idx)"


def _tan(c: str, w: str = "w") -> str:
    prev, nxt = f"lag({c}) OVER {w}", f"lead({c}) OVER {w}"
    return f"CASE WHEN {prev} IS NULL THEN {nxt} - {c} WHEN {nxt} IS NULL THEN {c} - {prev} ELSE ({nxt} - {prev}) / 2 END"


def _step(w: str = "w") -> str:
    return f"coalesce(sqrt((y - lag(y) OVER {w}) * (y - lag(y) OVER {w}) + (x - lag(x) OVER {w}) * (x - lag(x) OVER {w})), 0)"


def _points(v) -> DataFrame:
    return v("curve").select(*cv.CURVE, "idx", "y", "x")


def _segments(v) -> DataFrame:
    return v("segments").select(*cv.SEGMENT, "idx", "y", "x")


def _side(v, channel: str) -> DataFrame:
    return v("curve").filter(F.col("channel") == channel).select("fov_id", "ne_label", "idx", "y", "x")


NUC = ["fov_id", "ne_label"]
CUM = f"""cu AS (SELECT *, sum(step) OVER w AS cum FROM
    (SELECT {K}, idx, y, x, {_step()} AS step FROM {{curve}} c WINDOW {_w()}) t WINDOW {_w()})"""


@query("w4_cumulative_length", f"WITH {CUM} SELECT {K}, idx, R(y) AS y, R(x) AS x, R(step) AS step, R(cum) AS cum FROM cu")
def _(v):
    return cv.cumulative_length(_points(v))


@query(
    "w5_tangents",
    f"SELECT {K}, idx, R(y) AS y, R(x) AS x, R({_tan('c.y')}) AS ty, R({_tan('c.x')}) AS tx FROM {{curve}} c WINDOW {_w()}",
)
def _(v):
    return cv.tangents(_points(v))


def _wrap(a: str) -> str:
    return f"({a} + {PI} - 2 * {PI} * floor(({a} + {PI}) / (2 * {PI})) - {PI})"


def _bends(source: str, keys: str, cols: str = "") -> str:
    return f"""tg AS (SELECT {keys}, idx, y, x{cols}, atan2({_tan('x')}, {_tan('y')}) AS dir FROM {source} WINDOW {_w(keys)}),
        bd AS (SELECT *, round(abs(degrees({_wrap('(lead(dir) OVER w - dir)')})), 9) AS bend_next,
                      round(abs(degrees({_wrap('(dir - lag(dir) OVER w)')})), 9) AS bend_prev FROM tg WINDOW {_w(keys)})"""


@query(
    "w6_bend_filter",
    f"""WITH {_bends('{curve} c', K)} SELECT {K}, idx, R(y) AS y, R(x) AS x, R(bend_next) AS bend_next,
        NOT (coalesce(bend_prev > 53e-1, false) OR coalesce(bend_next > 53e-1, false)) AS valid FROM bd""",
)
def _(v):
    return cv.bend_filter(_points(v), max_deg=5.3)


MU = "(6 + ((idx * 7) % 11 - 5) * 2e-1)"


@query(
    "w6_revert_bends",
    f"""WITH t1 AS (SELECT {K}, idx, y, x, {_tan('y')} AS ty, {_tan('x')} AS tx, {MU} AS mu FROM {{curve}} c WINDOW {_w()}),
        mv AS (SELECT {K}, idx, y AS y0, x AS x0, ty, tx, mu, y - tx / (sqrt(ty * ty + tx * tx) + 1e-9) * (mu - 6) AS y,
                      x + ty / (sqrt(ty * ty + tx * tx) + 1e-9) * (mu - 6) AS x FROM t1),
        {_bends('mv', K, ', y0, x0, ty, tx, mu')},
        ok AS (SELECT *, coalesce(bend_prev > 20, false) OR coalesce(bend_next > 20, false) AS bad FROM bd)
        SELECT {K}, idx, bad AS was_reverted, R(CASE WHEN bad THEN 6e0 ELSE mu END) AS mu,
               R(CASE WHEN bad THEN y0 ELSE y END) AS y, R(CASE WHEN bad THEN x0 ELSE x END) AS x FROM ok""",
)
def _(v):
    fitted = cv.tangents(_points(v)).withColumn("mu", 6 + ((F.col("idx") * 7) % 11 - 5) * 0.2)
    return cv.revert_bends(fitted, cv.CURVE, 12.0, max_deg=20.0)


@query(
    "w6_largest_bend",
    f"""WITH {_bends('{curve} c', K)} SELECT {K}, R(coalesce(max(bend_next), 0)) AS max_bend,
        coalesce(max(bend_next), 0) <= 6 AS is_valid FROM bd GROUP BY {K}""",
)
def _(v):
    return cv.largest_bend(_points(v), cv.CURVE, max_deg=6.0)


@query(
    "a43_curvature",
    f"""WITH d AS (SELECT {K}, idx, y, x, (lead(y) OVER w - lag(y) OVER w) / 2 AS y1, (lead(x) OVER w - lag(x) OVER w) / 2 AS x1,
            lead(y) OVER w - 2 * y + lag(y) OVER w AS y2, lead(x) OVER w - 2 * x + lag(x) OVER w AS x2 FROM {{curve}} c WINDOW {_w()})
        SELECT {K}, idx, R(y) AS y, R(x) AS x, R(abs(x1 * y2 - y1 * x2) / pow(x1 * x1 + y1 * y1, 15e-1)) AS curvature FROM d""",
)
def _(v):
    return cv.curvature(_points(v))


SCUM = f"""su AS (SELECT *, sum(step) OVER w AS cum FROM
    (SELECT {S}, idx, y, x, {_step()} AS step FROM {{segments}} c WINDOW {_w(S)}) t WINDOW {_w(S)})"""


@query(
    "a43_curve_profile",
    f"""WITH {SCUM}, ce AS (SELECT {K}, avg(y) AS gy, avg(x) AS gx FROM {{segments}} s GROUP BY {K}),
        pa AS (SELECT {S}, count(*) AS n_points, max(cum) AS arc_length, avg(y) AS cy, avg(x) AS cx FROM su GROUP BY {S})
        SELECT {S}, n_points, R(arc_length) AS arc_length, R(pa.cy) AS cy, R(pa.cx) AS cx, R(atan2(pa.cy - gy, pa.cx - gx)) AS angle
        FROM pa JOIN ce USING ({K})""",
)
def _(v):
    return cv.curve_profile(_segments(v), cv.CURVE, cv.SEGMENT)


def _resampled(n: str) -> str:
    return f"""WITH {CUM}, tt AS (SELECT {K}, max(cum) AS total FROM cu GROUP BY {K}),
        ed AS (SELECT *, lead(y) OVER w AS y2, lead(x) OVER w AS x2, lead(cum) OVER w AS c2 FROM cu WINDOW {_w()}),
        tg AS (SELECT {K}, total, n, unnest(generate_series(0, n - 1)) AS k FROM (SELECT *, CAST({n} AS BIGINT) AS n FROM tt) q),
        hit AS (SELECT tg.{K.replace(', ', ', tg.')}, tg.k, k * (total / (n - 1)) AS s, ed.*
                FROM tg JOIN ed ON tg.fov_id = ed.fov_id AND tg.channel = ed.channel AND tg.ne_label = ed.ne_label
                 AND k * (total / (n - 1)) >= cum - 1e-9 AND k * (total / (n - 1)) <= c2 + 1e-9)
        SELECT fov_id, channel, ne_label, k AS idx, R(any_value(s)) AS s,
               R(arg_min(h.y + least(greatest((s - cum) / (c2 - cum), 0), 1) * (y2 - h.y), idx)) AS y,
               R(arg_min(h.x + least(greatest((s - cum) / (c2 - cum), 0), 1) * (x2 - h.x), idx)) AS x
        FROM hit h GROUP BY fov_id, channel, ne_label, k"""


@query("j20_resample", _resampled("200"))
def _(v):
    return cv.resample(_points(v), cv.CURVE, n=200)


@query("j20_resample_density", _resampled("greatest(round_even(total * 5e-1, 0), 2)"))
def _(v):
    return cv.resample(_points(v), cv.CURVE, density=0.5)


@query(
    "w12_angular_order",
    f"""WITH ce AS (SELECT {K}, avg(y) AS cy, avg(x) AS cx FROM {{curve}} c GROUP BY {K}),
        an AS (SELECT {K}, idx, y, x, atan2(y - cy, x - cx) AS angle FROM {{curve}} c JOIN ce USING ({K}))
        SELECT {K}, idx, R(y) AS y, R(x) AS x, R(angle) AS angle,
               row_number() OVER (PARTITION BY {K} ORDER BY round(an.angle, 9), an.idx) - 1 AS "order" FROM an""",
)
def _(v):
    return cv.angular_order(_points(v), cv.CURVE)


@query(
    "p13_mirror",
    f"SELECT {K}, n - 1 - idx AS idx, R(y) AS y, R(75 - x) AS x FROM {{curve}} c",
)
def _(v):
    return cv.mirror(_points(v), cv.CURVE, 75.0)


@query(
    "p11_similarity_transform",
    f"""SELECT {K}, mode, idx,
               R((dy * cos(a) - dx * sin(a)) * s + 375e-1 + shy) AS y, R((dy * sin(a) + dx * cos(a)) * s + 375e-1 + shx) AS x
        FROM (SELECT {K}, r.mode, idx, y - 375e-1 AS dy, x - 375e-1 AS dx, CASE WHEN r.scale IS NULL THEN 1e0 ELSE r.scale END AS s,
                     coalesce(r.angle, 0e0) AS a, coalesce(r.shift_y, 0e0) AS shy, coalesce(r.shift_x, 0e0) AS shx
              FROM {{curve}} c LEFT JOIN {{reg_fov}} r USING (fov_id)) t""",
)
def _(v):
    reg = v("reg_fov").select("fov_id", "mode", *st.PARTS)
    joined = _points(v).join(reg, "fov_id", "left").fillna({"scale": 1.0, "angle": 0.0, "shift_y": 0.0, "shift_x": 0.0})
    y, x = sc.similarity("y", "x", "scale", "angle", "shift_y", "shift_x", F.lit(37.5), F.lit(37.5))
    return joined.select(*cv.CURVE, "mode", "idx", y.alias("y"), x.alias("x"))


@query(
    "p12_to_fov_space",
    f"""SELECT {K}, idx, R(y + final_top) AS y, R(x + final_left) AS x FROM {{curve}} c JOIN {{boxes}} b USING ({K})""",
)
def _(v):
    return cv.to_fov_space(_points(v), v("boxes"))


ENDS = """SELECT {K}, idx, y, x, ty / m AS uy, tx / m AS ux FROM
    (SELECT *, sqrt(ty * ty + tx * tx) + 1e-9 AS m FROM (SELECT {K}, idx, y, x, {TY} AS ty, {TX} AS tx FROM {{curve}} c WINDOW {W}) a) b
    """.replace("{K}", K).replace("{TY}", _tan("y")).replace("{TX}", _tan("x")).replace("{W}", _w()).replace("{{", "{").replace("}}", "}")


@query(
    "p14_normals",
    f"""SELECT {K}, idx, R(y - 6 * ux) AS y0, R(x + 6 * uy) AS x0, R(y + 6 * ux) AS y1, R(x - 6 * uy) AS x1 FROM ({ENDS}) e""",
)
def _(v):
    ends = sc.normal_ends("y", "x", "ty", "tx", 12.0)
    return cv.tangents(_points(v)).select(*cv.CURVE, "idx", *[c.alias(n) for n, c in ends.items()])


@query(
    "p15_move_along_normal",
    f"""SELECT {K}, idx, R(e.y - ux * ({MU} - 6)) AS y, R(e.x + uy * ({MU} - 6)) AS x FROM ({ENDS}) e""",
)
def _(v):
    mu = 6 + ((F.col("idx") * 7) % 11 - 5) * 0.2
    y, x = sc.move_along_normal("y", "x", "ty", "tx", mu, 12.0)
    return cv.tangents(_points(v)).select(*cv.CURVE, "idx", y.alias("y"), x.alias("x"))


@query(
    "p16_wrap_angle",
    f"SELECT {K}, idx, R({_wrap('(atan2(y - 30, x - 30) * 3)')}) AS angle FROM {{curve}} c",
)
def _(v):
    angle = F.atan2(F.col("y") - 30, F.col("x") - 30) * 3
    return _points(v).select(*cv.CURVE, "idx", sc.wrap_angle(angle).alias("angle"))


@query(
    "p27_refine_bounds",
    f"""SELECT {K}, count(*) FILTER (x * 22e-1 - 30 < -10 OR x * 22e-1 - 30 > 85) AS n_clipped_x,
               count(*) FILTER (y * 22e-1 - 30 < -10 OR y * 22e-1 - 30 > 85) AS n_clipped_y FROM {{curve}} c GROUP BY {K}""",
)
def _(v):
    return cv.refine_bounds(_stretched(v), cv.CURVE)[1]


def _stretched(v) -> DataFrame:
    return _points(v).withColumn("x", F.col("x") * 2.2 - 30).withColumn("y", F.col("y") * 2.2 - 30)


@query(
    "p27_clipped_points",
    f"""SELECT {K}, idx, R(least(greatest(y * 22e-1 - 30, -1e1), 85e0)) AS y, R(least(greatest(x * 22e-1 - 30, -1e1), 85e0)) AS x
        FROM {{curve}} c""",
)
def _(v):
    return cv.refine_bounds(_stretched(v), cv.CURVE)[0]


@query(
    "p28_keep_segments",
    f"""WITH p AS (SELECT {K}, segment, idx, y * 2e0 - 25 AS y, x * 2e0 - 25 AS x FROM {{segments}} s),
        lg AS (SELECT fov_id, channel, ne_label, seg_label AS segment FROM {{profile_log}} q WHERE status = 'success'
               GROUP BY ALL HAVING count(*) >= 4),
        nr AS (SELECT {S} FROM p GROUP BY {S} HAVING min(least(y, x)) >= -20 AND max(greatest(y, x)) <= 95)
        SELECT {S}, idx, R(y) AS y, R(x) AS x FROM p JOIN nr USING ({S}) JOIN lg USING ({S})""",
)
def _(v):
    points = _segments(v).withColumn("x", F.col("x") * 2.0 - 25).withColumn("y", F.col("y") * 2.0 - 25)
    log = v("profile_log").withColumnRenamed("seg_label", "segment")
    return cv.keep_segments(points, log, cv.SEGMENT)


# ---- curve against curve ------------------------------------------------------------------

EDGE = """SELECT fov_id, channel, ne_label, idx AS edge, n, y, x, coalesce(lead(y) OVER w, first(y) OVER w) AS y2,
          coalesce(lead(x) OVER w, first(x) OVER w) AS x2 FROM {curve} c WINDOW w AS (PARTITION BY fov_id, channel, ne_label ORDER BY idx)"""
NEAREST = f"""eb AS (SELECT * FROM ({EDGE}) e WHERE channel = 'ch2'), ea AS (SELECT * FROM ({EDGE}) e WHERE channel = 'ch1'),
    ap AS (SELECT fov_id, ne_label, idx, n, y AS py, x AS px FROM {{curve}} c WHERE channel = 'ch1'),
    pr AS (SELECT ap.*, edge, y, x, y2 - y AS dy, x2 - x AS dx,
                  CASE WHEN (y2 - y) * (y2 - y) + (x2 - x) * (x2 - x) > 0 THEN
                  least(greatest(((py - y) * (y2 - y) + (px - x) * (x2 - x)) / ((y2 - y) * (y2 - y) + (x2 - x) * (x2 - x)), 0e0), 1e0)
                  ELSE 0e0 END AS t
           FROM ap JOIN eb USING (fov_id, ne_label)),
    ne AS (SELECT fov_id, ne_label, idx, any_value(n) AS n, min(d) AS dist, arg_min(ny, (round(d, 9), edge)) AS near_y,
                  arg_min(nx, (round(d, 9), edge)) AS near_x
           FROM (SELECT *, y + t * dy AS ny, x + t * dx AS nx,
                        sqrt((py - y - t * dy) * (py - y - t * dy) + (px - x - t * dx) * (px - x - t * dx)) AS d FROM pr) q
           GROUP BY fov_id, ne_label, idx)"""
INSIDE = """ins AS (SELECT ne.fov_id, ne.ne_label, ne.idx, any_value(ne.n) AS n, any_value(dist) AS dist,
    any_value(near_y) AS near_y, any_value(near_x) AS near_x,
    count(*) FILTER ((y > near_y) <> (y2 > near_y) AND near_x < (x2 - x) * (near_y - y) / (y2 - y) + x) % 2 = 1 AS inside
    FROM ne JOIN ea USING (fov_id, ne_label) GROUP BY ne.fov_id, ne.ne_label, ne.idx)"""


@query("j15_nearest_on_curve", f"WITH {NEAREST} SELECT fov_id, ne_label, idx, R(dist) AS dist, R(near_y) AS near_y, R(near_x) AS near_x FROM ne")
def _(v):
    near = cv.nearest_on_curve(_side(v, "ch1"), _side(v, "ch2"), NUC)
    return near.select(*NUC, "idx", "dist", "near_y", "near_x")


@query(
    "j16_point_in_polygon",
    f"""WITH ea AS (SELECT * FROM ({EDGE}) e WHERE channel = 'ch1'),
        ap AS (SELECT fov_id, ne_label, idx, y * 11e-1 - 3 AS py, x * 11e-1 - 3 AS px FROM {{curve}} c WHERE channel = 'ch2')
        SELECT ap.fov_id, ap.ne_label, ap.idx, R(any_value(py)) AS py, R(any_value(px)) AS px,
               count(*) FILTER ((y > py) <> (y2 > py) AND px < (x2 - x) * (py - y) / (y2 - y) + x) % 2 = 1 AS inside
        FROM ap JOIN ea USING (fov_id, ne_label) GROUP BY ap.fov_id, ap.ne_label, ap.idx""",
)
def _(v):
    points = _side(v, "ch2").select(*NUC, "idx", (F.col("y") * 1.1 - 3).alias("py"), (F.col("x") * 1.1 - 3).alias("px"))
    return cv.point_in_polygon(points, _side(v, "ch1"), NUC)


SIGNED = f"{NEAREST}, {INSIDE}, sd AS (SELECT fov_id, ne_label, idx, n, dist * CASE WHEN inside THEN 1 ELSE -1 END * 128 AS dist_nm FROM ins)"


@query("j17_signed_distance", f"WITH {SIGNED} SELECT fov_id, ne_label, idx, R(dist_nm) AS dist_nm FROM sd")
def _(v):
    return cv.signed_distance(_side(v, "ch1"), _side(v, "ch2"), NUC)


# places at equal arc lengths of the open outline, both ends included
SAMPLES = 40
SAMPLED = SIGNED.replace(
    "ap AS (SELECT fov_id, ne_label, idx, n, y AS py, x AS px FROM {curve} c WHERE channel = 'ch1')",
    f"sa AS ({_resampled(str(SAMPLES)).replace('R(arg_min', '(arg_min')}), ap AS (SELECT fov_id, ne_label, idx, 0 AS n, y AS py, x AS px FROM sa WHERE channel = 'ch1')",
)


@query("j17_sampled_distance", f"WITH {SAMPLED} SELECT fov_id, ne_label, idx, R(dist_nm) AS dist_nm FROM sd")
def _(v):
    return cv.signed_distance(_side(v, "ch1"), _side(v, "ch2"), NUC, n=SAMPLES)


# ---- stretches ----------------------------------------------------------------------------

RANGES = """ra AS (SELECT fov_id, ne_label, channel, kind, u_start, u_end FROM
    (SELECT fov_id, ne_label, channel, CASE WHEN seg % 2 = 0 THEN 'data' ELSE 'bridge' END AS kind,
            seg / 4e0 + 1e-2 AS u_start, (seg + 1) / 4e0 + CASE WHEN channel = 'ch1' THEN 0e0 ELSE 3e-2 END AS u_end
     FROM (SELECT DISTINCT fov_id, ne_label, channel, CAST(floor(4 * idx / n) AS BIGINT) AS seg FROM {curve} c) s) r)"""


def _ranges(v) -> DataFrame:
    seg = v("curve").select(*cv.CURVE, F.floor(4 * F.col("idx") / F.col("n")).cast("long").alias("seg")).distinct()
    return seg.select(
        *cv.CURVE,
        F.when(F.col("seg") % 2 == 0, "data").otherwise("bridge").alias("kind"),
        (F.col("seg") / 4.0 + 0.01).alias("u_start"),
        ((F.col("seg") + 1) / 4.0 + F.when(F.col("channel") == "ch1", 0.0).otherwise(0.03)).alias("u_end"),
    )


def _kind(a: str) -> str:
    return f"""(SELECT CASE min(CASE WHEN kind = 'data' THEN 0 ELSE 1 END) WHEN 0 THEN 'data' WHEN 1 THEN 'bridge' END FROM ra
        WHERE ra.fov_id = {a}.fov_id AND ra.ne_label = {a}.ne_label AND ra.channel = CH
          AND {a}.u >= u_start AND {a}.u <= u_end)"""


@query(
    "j13_segment_type",
    f"""WITH {RANGES}, pt AS (SELECT {K}, idx, idx * 1e0 / n AS u FROM {{curve}} c)
        SELECT {K}, idx, R(u) AS u, {_kind('pt').replace('CH', 'pt.channel')} AS kind FROM pt""",
)
def _(v):
    points = v("curve").select(*cv.CURVE, "idx", (F.col("idx") / F.col("n")).alias("u"))
    return cv.segment_type(points, _ranges(v), cv.CURVE)


PAIRED = f"""{RANGES}, pt AS (SELECT fov_id, ne_label, idx, idx * 1e0 / n AS u FROM {{curve}} c WHERE channel = 'ch1'),
    ty AS (SELECT fov_id, ne_label, idx, u, {_kind('pt').replace('CH', "'ch1'")} AS t1, {_kind('pt').replace('CH', "'ch2'")} AS t2 FROM pt),
    pt2 AS (SELECT *, CASE WHEN t1 IS NULL OR t2 IS NULL THEN 'unknown' ELSE t1 || '_' || t2 END AS pair_type FROM ty)"""


def _paired(v) -> DataFrame:
    u = v("curve").filter("channel = 'ch1'").select(*NUC, "idx", (F.col("idx") / F.col("n")).alias("u"))
    ranges = _ranges(v)
    one = cv.segment_type(u, ranges.filter("channel = 'ch1'"), NUC, "t1")
    two = cv.segment_type(one, ranges.filter("channel = 'ch2'"), NUC, "t2")
    return two.withColumn("pair_type", cv.pair_type("t1", "t2"))


@query("j14_pair_type", f"WITH {PAIRED} SELECT fov_id, ne_label, idx, R(u) AS u, t1, t2, pair_type FROM pt2")
def _(v):
    return _paired(v)


@query(
    "a18_measured_pairs",
    f"""WITH {SIGNED}, {PAIRED}, me AS (SELECT sd.fov_id, sd.ne_label, pair_type, dist_nm FROM sd JOIN pt2 USING (fov_id, ne_label, idx))
        SELECT fov_id, ne_label, R(avg(dist_nm)) AS mean_distance, R(min(dist_nm)) AS min_distance, R(max(dist_nm)) AS max_distance,
               R(quantile_cont(dist_nm, 5e-1)) AS median_distance, count(*) AS n_points,
               count(*) FILTER (pair_type = 'data_data') AS n_data_data_points,
               count(*) FILTER (pair_type = 'bridge_bridge') AS n_bridge_bridge_points,
               R(avg(dist_nm) FILTER (pair_type = 'data_data')) AS data_data_mean FROM me GROUP BY fov_id, ne_label""",
)
def _(v):
    """Measurement chain: signed distances of both outlines, kind of each point, statistics per nucleus."""
    signed = cv.signed_distance(_side(v, "ch1"), _side(v, "ch2"), NUC)
    # the statistics read these rows several times
    typed = cut(signed.join(_paired(v).select(*NUC, "idx", "pair_type"), [*NUC, "idx"]))
    return sm.distance_stats(typed, NUC).select(
        *NUC, "mean_distance", "min_distance", "max_distance", "median_distance", "n_points",
        "n_data_data_points", "n_bridge_bridge_points", "data_data_mean",
    )


FLAGS = """fl AS (SELECT fov_id, channel, ne_label, idx, (idx * 5 + n) % 7 > 2 AS flag FROM {curve} c)"""
ISLANDS = f"""{FLAGS}, gr AS (SELECT *, idx - row_number() OVER (PARTITION BY {K} ORDER BY idx) AS g FROM fl WHERE flag),
    isl AS (SELECT {K}, min(idx) AS start, max(idx) AS stop FROM gr GROUP BY {K}, g)"""


def _flags(v) -> DataFrame:
    return v("curve").select(*cv.CURVE, "idx", ((F.col("idx") * 5 + F.col("n")) % 7 > 2).alias("flag"))


@query("w2_islands", f"WITH {ISLANDS} SELECT {K}, start, stop FROM isl")
def _(v):
    return cv.islands(_flags(v), cv.CURVE).drop("run")


@query("w2_islands_exclusive", f"WITH {ISLANDS} SELECT {K}, start, stop + 1 AS stop FROM isl")
def _(v):
    return cv.islands(_flags(v), cv.CURVE, inclusive=False).drop("run")


@query(
    "w3_u_ranges",
    """WITH s AS (SELECT curve_id, u, CASE WHEN round(u - lag(u) OVER w, 9) > 2e-2 THEN 1 ELSE 0 END AS nw FROM {u_values} x
                  WINDOW w AS (PARTITION BY curve_id ORDER BY u, event_id)),
       r AS (SELECT curve_id, u, sum(nw) OVER (PARTITION BY curve_id ORDER BY u ROWS UNBOUNDED PRECEDING) AS run FROM s),
       g AS (SELECT curve_id, run, min(u) AS a, max(u) AS b, count(*) AS c FROM r GROUP BY curve_id, run),
       e AS (SELECT curve_id, sum(c) AS n, max(run) AS last, min(a) AS fa, max(b) AS lb, min(b) AS fb FROM g GROUP BY curve_id),
       j AS (SELECT *, round(1 - lb + fa, 9) <= 2e-2 AND last > 0 AS seam FROM g JOIN e USING (curve_id) WHERE n >= 2)
       SELECT curve_id, R(a) AS u_start, R(CASE WHEN seam AND run = last THEN fb ELSE b END) AS u_end FROM j
       WHERE NOT (seam AND run = 0)""",
)
def _(v):
    return cv.u_ranges(v("u_values"), ["curve_id"], gap=0.02, tie=["event_id"])


@query(
    "p22_range_overlap",
    f"""WITH {RANGES} SELECT a.fov_id, a.ne_label, a.kind AS kind_a, b.kind AS kind_b, R(a.u_start) AS start_a, R(b.u_start) AS start_b,
        R(greatest(least(a.u_end, b.u_end) - greatest(a.u_start, b.u_start), 0e0)) AS overlap
        FROM ra a JOIN ra b ON a.fov_id = b.fov_id AND a.ne_label = b.ne_label AND a.channel = 'ch1' AND b.channel = 'ch2'
        AND a.u_start = b.u_start""",
)
def _(v):
    r = _ranges(v)

    def side(channel: str, p: str) -> DataFrame:
        return r.filter(F.col("channel") == channel).select(
            *NUC, F.col("kind").alias(f"kind_{p}"), F.col("u_start").alias("u"), F.col("u_start").alias(f"start_{p}"), F.col("u_end").alias(f"end_{p}")
        )

    joined = side("ch1", "a").join(side("ch2", "b"), [*NUC, "u"])
    overlap = sc.range_overlap("start_a", "end_a", "start_b", "end_b")
    return joined.select(*NUC, "kind_a", "kind_b", "start_a", "start_b", overlap.alias("overlap"))


# ---- bridges ------------------------------------------------------------------------------

TRIM = f"""{SCUM}, st AS (SELECT {S}, max(cum) AS total FROM su GROUP BY {S}),
    se AS (SELECT su.*, total, tr.trim, lead(su.y) OVER w AS y2, lead(su.x) OVER w AS x2, lead(cum) OVER w AS c2
           FROM su JOIN st USING ({S}) JOIN (SELECT DISTINCT {K}, CASE WHEN ne_label = '03' THEN 0e0 ELSE 12e-1 END AS trim
                                             FROM {{segments}} q) tr USING ({K}) WINDOW {_w(S)}),
    lg AS (SELECT * FROM se WHERE trim <= 0 OR round(total, 9) > round(21e-1 * trim, 9)),
    al AS (SELECT {S}, cum AS s, 1 AS o, y, x FROM lg WHERE trim <= 0 OR (cum > trim AND cum < total - trim)
           UNION ALL SELECT {S}, trim, 0, y + (trim - cum) / (c2 - cum) * (y2 - y), x + (trim - cum) / (c2 - cum) * (x2 - x)
           FROM lg WHERE trim > 0 AND cum <= trim AND c2 > trim
           UNION ALL SELECT {S}, total - trim, 2, y + (total - trim - cum) / (c2 - cum) * (y2 - y),
                  x + (total - trim - cum) / (c2 - cum) * (x2 - x) FROM lg WHERE trim > 0 AND cum < total - trim AND c2 >= total - trim),
    tm AS (SELECT {S}, row_number() OVER (PARTITION BY {S} ORDER BY o, s) - 1 AS idx, y, x FROM
           (SELECT {S}, s, CASE WHEN o = 1 THEN 1 ELSE o END AS o, y, x FROM al) q)"""


def _trims(v) -> DataFrame:
    t = F.when(F.col("ne_label") == "03", 0.0).otherwise(1.2)
    return _segments(v).select(*cv.CURVE).distinct().withColumn("trim", t)


@query("w7_trim_ends", f"WITH {TRIM} SELECT {S}, idx, R(y) AS y, R(x) AS x FROM tm")
def _(v):
    return br.trim_ends(_segments(v), _trims(v))


@query(
    "w7_trim_length",
    """WITH s AS (SELECT mode, fov_id, ne_label, count(*) AS n, sqrt(pow(stddev_pop(shift_y), 2) + pow(stddev_pop(shift_x), 2)) AS own
                  FROM {reg_slice} r GROUP BY ALL)
       SELECT l.mode, l.fov_id, l.ne_label, R(2 * coalesce(CASE WHEN s.n > 1 THEN own ELSE f.ch_reg_prec END, f.ch_reg_prec, 5e-1)) AS trim
       FROM (SELECT DISTINCT fov_id, ne_label, mode FROM (SELECT fov_id, ne_label FROM {reg_label} q) a, (VALUES (1), (2)) b(mode)) l
       LEFT JOIN s USING (mode, fov_id, ne_label) LEFT JOIN {reg_fov} f USING (mode, fov_id)""",
)
def _(v):
    nuclei = v("reg_label").select(*NUC).distinct()
    own = st.slice_sigma_shift_only(v("reg_slice"), v("reg_fov"))
    field = v("reg_fov").withColumnRenamed("ch_reg_prec", "sigma_reg")
    one, two = (
        br.trim_length(nuclei, own.filter(F.col("mode") == m), field.filter(F.col("mode") == m)).withColumn("mode", F.lit(m)) for m in (1, 2)
    )
    return one.unionByName(two)


ORIENT = f"""ce AS (SELECT {K}, avg(y) AS gy, avg(x) AS gx FROM {{segments}} s GROUP BY {K}),
    og AS (SELECT {S}, idx, m, y, x, {_tan('y')} AS ty, {_tan('x')} AS tx FROM {{segments}} s WINDOW {_w(S)}),
    al AS (SELECT {S}, abs((y - gy) / (sqrt((y - gy) * (y - gy) + (x - gx) * (x - gx)) + 1e-6) * ty / (sqrt(ty * ty + tx * tx) + 1e-6)
             + (x - gx) / (sqrt((y - gy) * (y - gy) + (x - gx) * (x - gx)) + 1e-6) * tx / (sqrt(ty * ty + tx * tx) + 1e-6)) AS alignment
           FROM og JOIN ce USING ({K}) WHERE idx = CAST(floor((m - 1) / 2) AS BIGINT))"""


@query("w8_orientation", f"WITH {ORIENT} SELECT {S}, R(alignment) AS alignment FROM al")
def _(v):
    return br.orientation(_segments(v))


@query(
    "w8_orientation_filter",
    f"""WITH {ORIENT} SELECT {S}, idx, R(y) AS y, R(x) AS x FROM {{segments}} s JOIN al USING ({S}) WHERE round(alignment, 9) < 2e-1""",
)
def _(v):
    return br.orientation_filter(_segments(v), limit=0.2)


TIPS = f"""{SCUM}, tp AS (SELECT {S}, max(idx) AS last, max(cum) AS length, arg_min(y, idx) AS ya, arg_min(x, idx) AS xa,
        arg_max(y, idx) AS yd, arg_max(x, idx) AS xd FROM su GROUP BY {S}),
    en AS (SELECT tp.*, b.y - ya AS sty, b.x - xa AS stx, yd - c.y AS ety, xd - c.x AS etx,
                  row_number() OVER (PARTITION BY tp.fov_id, tp.channel, tp.ne_label ORDER BY tp.segment) - 1 AS rk,
                  count(*) OVER (PARTITION BY tp.fov_id, tp.channel, tp.ne_label) AS nseg
           FROM tp JOIN su b ON b.fov_id = tp.fov_id AND b.channel = tp.channel AND b.ne_label = tp.ne_label AND b.segment = tp.segment AND b.idx = 1
           JOIN su c ON c.fov_id = tp.fov_id AND c.channel = tp.channel AND c.ne_label = tp.ne_label AND c.segment = tp.segment AND c.idx = last - 1),
    gp AS (SELECT e.*, f.segment AS next_segment, f.ya AS ny, f.xa AS nx, f.sty AS nty, f.stx AS ntx,
                  sqrt((f.ya - e.yd) * (f.ya - e.yd) + (f.xa - e.xd) * (f.xa - e.xd)) AS gap
           FROM en e JOIN en f ON e.fov_id = f.fov_id AND e.channel = f.channel AND e.ne_label = f.ne_label AND f.rk = (e.rk + 1) % e.nseg),
    bz AS (SELECT {S}, next_segment, gap, idx, pow(r, 3) * yd + 3 * r * r * t * (yd + 3e-1 * gap * ety / sqrt(ety * ety + etx * etx))
                  + 3 * r * t * t * (ny - 3e-1 * gap * nty / sqrt(nty * nty + ntx * ntx)) + pow(t, 3) * ny AS y,
                  pow(r, 3) * xd + 3 * r * r * t * (xd + 3e-1 * gap * etx / sqrt(ety * ety + etx * etx))
                  + 3 * r * t * t * (nx - 3e-1 * gap * ntx / sqrt(nty * nty + ntx * ntx)) + pow(t, 3) * nx AS x
           FROM (SELECT *, idx / 49e0 AS t, 1 - idx / 49e0 AS r FROM
                 (SELECT *, unnest(generate_series(0, 49)) AS idx FROM gp WHERE round(gap, 9) >= 1) q) z),
    {_bends('bz', S, ', next_segment, gap')},
    vd AS (SELECT {S}, max(bend_next) AS max_bend, max(bend_next) <= 5 AS is_valid FROM bd GROUP BY {S})"""


def _ranked(v) -> DataFrame:
    return cut(br.rank_segments(br.segment_ends(_segments(v))))


@query(
    "w9_gaps",
    f"WITH {TIPS} SELECT {S}, next_segment, nseg AS n_segments, R(length) AS length, R(gap) AS gap FROM gp",
)
def _(v):
    return br.gaps(_ranked(v)).select(*cv.SEGMENT, "next_segment", "n_segments", "length", "gap")


@query(
    "w9_bridge_gaps",
    f"""WITH {TIPS} SELECT {S}, next_segment, idx, R(gap) AS gap, R(y) AS y, R(x) AS x, R(max_bend) AS max_bend, is_valid
        FROM bz JOIN vd USING ({S})""",
)
def _(v):
    return br.bridge_gaps(_ranked(v), max_deg=5.0)


@query(
    "w10_u_range_table",
    f"""WITH {TIPS}, bl AS (SELECT {S}, sum(st) AS blen FROM (SELECT {S}, {_step()} AS st FROM bz JOIN vd USING ({S}) WHERE is_valid
                            WINDOW {_w(S)}) q GROUP BY {S}),
        pa AS (SELECT {K}, rk * 2 AS o, 'data' AS kind, length AS len FROM en
               UNION ALL SELECT {K}, rk * 2 + 1, 'bridge', coalesce(blen, 0) FROM en LEFT JOIN bl USING ({S})),
        ru AS (SELECT *, sum(len) OVER (PARTITION BY {K} ORDER BY o) AS upto, sum(len) OVER (PARTITION BY {K}) AS total FROM pa)
        SELECT {K}, kind, R((upto - len) / total) AS u_start, R(upto / total) AS u_end FROM ru WHERE len > 0""",
)
def _(v):
    return br.u_range_table(br.parts_of_outline(cut(br.bridge_lines(_ranked(v), max_deg=5.0))))


def _renamed(text: str, tag: str, source: str) -> str:
    """The steps of ``text`` under names of their own, over another table of segments."""
    steps = set(re.findall(r"(?:^|,)\s*(\w+) AS \(SELECT", text))
    for step in sorted(steps):
        text = re.sub(rf"\b{step}\b(?!\()", f"{step}_{tag}", text)
    return text.replace("{segments}", source)


# the same steps as above, each over what the one before it left
CHAIN = f"""{TRIM}, kp AS (SELECT *, count(*) OVER (PARTITION BY {S}) AS m FROM tm), {_renamed(ORIENT, 'or', 'kp')},
    fs AS (SELECT kp.* FROM kp JOIN al_or USING ({S}) WHERE round(alignment, 9) < 6e-1), {_renamed(TIPS, 'br', 'fs')}"""


@query(
    "w10_bridged_outline",
    f"""WITH {CHAIN}, bl AS (SELECT {S}, sum(st) AS blen FROM (SELECT {S}, {_step()} AS st FROM bz_br JOIN vd_br USING ({S}) WHERE is_valid
                             WINDOW {_w(S)}) q GROUP BY {S}),
        pa AS (SELECT {K}, rk * 2 AS o, 'data' AS kind, length AS len FROM en_br
               UNION ALL SELECT {K}, rk * 2 + 1, 'bridge', coalesce(blen, 0) FROM en_br LEFT JOIN bl USING ({S})),
        ru AS (SELECT *, sum(len) OVER (PARTITION BY {K} ORDER BY o) AS upto, sum(len) OVER (PARTITION BY {K}) AS total FROM pa)
        SELECT {K}, kind, R((upto - len) / total) AS u_start, R(upto / total) AS u_end FROM ru WHERE len > 0""",
)
def _(v):
    """Trim, orientation, bridges and ranges in one chain."""
    return br.bridge(_segments(v), _trims(v), max_deg=5.0)[1]
