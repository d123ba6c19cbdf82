"""Queries on stacks, masks, crops and shifts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perinuc.operators import bridging as br
from perinuc.operators import components as cp
from perinuc.operators import curves as cv
from perinuc.operators import pixels as px
from perinuc.plans.q_curves import _segments
from perinuc.plans.registry import query

FOV = ["fov_id"]
M = "fov_id, channel"


@query("p23_threshold_mask", "SELECT fov_id, frame, y, x, R(e) AS e, value FROM {stack} s WHERE value >= 1100")
def _(v):
    return px.threshold_mask(v("stack"), 1100)


@query(
    "a27_frame_mean",
    "SELECT fov_id, y, x, R(avg(value)) AS value FROM {stack} s WHERE frame >= 0 AND frame < 40 GROUP BY fov_id, y, x",
)
def _(v):
    return px.frame_mean(v("stack"), FOV, 0, 40)


@query(
    "a27_relative_mean",
    """WITH m AS (SELECT fov_id, y, x, avg(value) AS v FROM {stack} s GROUP BY fov_id, y, x)
       SELECT fov_id, y, x, R(v / max(v) OVER (PARTITION BY fov_id)) AS value FROM m""",
)
def _(v):
    return px.relative_mean(px.frame_mean(v("stack"), FOV), FOV)


@query(
    "a28_slice_means",
    """SELECT fov_id, 'slice_' || (I(floor(frame / 10)) + 1) AS slice_id, y, x, R(avg(value)) AS value FROM {stack} s
       WHERE frame < 50 GROUP BY 1, 2, 3, 4""",
)
def _(v):
    return px.slice_means(v("stack"), FOV, 0, 50, 10)


@query(
    "a29_camera_gain",
    """WITH dk AS (SELECT avg(dark) AS off, var_pop(dark) AS dv FROM {calibration} c),
       lv AS (SELECT frame, y, x, bright - off AS v FROM {calibration} c, dk),
       fm AS (SELECT frame, avg(v) AS m FROM lv GROUP BY frame), f1 AS (SELECT arg_min(m, frame) AS f FROM fm),
       pt AS (SELECT y, x, avg(v * f / m) AS m, var_pop(v * f / m) AS v FROM lv JOIN fm USING (frame), f1 GROUP BY y, x),
       sp AS (SELECT min(m) AS lo, (max(m) - min(m)) / 1e2 AS w, count(*) AS n FROM pt),
       bn AS (SELECT least(floor((m - lo) / w), 99) AS b, avg(v) AS yy, pow(count(*) / any_value(n), 2) AS ww, any_value(lo) AS lo, any_value(w) AS w
              FROM pt, sp GROUP BY 1),
       ls AS (SELECT count(*) AS n_bins, sum(ww) AS s0, sum(ww * xx) AS s1, sum(ww * xx * xx) AS s2, sum(ww * yy) AS t0, sum(ww * xx * yy) AS t1
              FROM (SELECT ww, yy, lo + (b + 5e-1) * w AS xx FROM bn) q),
       ln AS (SELECT n_bins, (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) AS slope, s0, s1, t0 FROM ls)
       SELECT n_bins, R(slope) AS slope, R((t0 - slope * s1) / s0) AS intercept, R(1 / slope) AS gain, R(off) AS "offset",
              R(sqrt(dv) / slope) AS dk_noise FROM ln, dk""",
)
def _(v):
    return px.camera_gain(v("calibration"))


@query(
    "a30_qc_labels",
    f"SELECT {M}, ne_label, count(*) AS n_pixels FROM {{mask}} m WHERE ne_label <> 0 GROUP BY {M}, ne_label HAVING count(*) >= 75",
)
def _(v):
    return px.qc_labels(v("mask"))


@query(
    "a31_crop_boxes",
    f"""SELECT {M}, ne_label, 75 AS height, 75 AS width, I(least(greatest(ceil(my - 375e-1), 0), 150)) AS final_top,
        I(least(greatest(ceil(mx - 375e-1), 0), 190)) AS final_left,
        I(greatest(least(greatest(ceil(my + 375e-1), 0), 150), least(greatest(ceil(my - 375e-1), 0), 150))) AS final_bottom,
        I(greatest(least(greatest(ceil(mx + 375e-1), 0), 190), least(greatest(ceil(mx - 375e-1), 0), 190))) AS final_right
        FROM (SELECT {M}, ne_label, (min(y) + max(y)) / 2 AS my, (min(x) + max(x)) / 2 AS mx FROM {{mask}} m GROUP BY {M}, ne_label) t""",
)
def _(v):
    return px.crop_boxes(v("mask"), px.MASK, 75, 75, 190, 150)


@query("a32_centroid", f"SELECT {M}, ne_label, R(avg(y)) AS cy, R(avg(x)) AS cx FROM {{mask}} m GROUP BY {M}, ne_label")
def _(v):
    return px.centroids(v("mask"))


@query(
    "a33_dilate3x3",
    f"""SELECT DISTINCT {M}, ne_label, y + a AS y, x + b AS x FROM {{mask}} m, (VALUES (-1), (0), (1)) p(a), (VALUES (-1), (0), (1)) q(b)
        WHERE y + a BETWEEN 0 AND 149 AND x + b BETWEEN 0 AND 129""",
)
def _(v):
    return px.dilate3x3(v("mask"), px.MASK, 150, 130)


# the discs of one field do not touch, so each label is one region; reading order follows the first pixel
REGIONS = f"""rg AS (SELECT {M}, ne_label, min(y * 1000 + x) AS head FROM {{mask}} m GROUP BY {M}, ne_label),
    rk AS (SELECT {M}, ne_label, row_number() OVER (PARTITION BY {M} ORDER BY head) AS nr FROM rg)"""


@query(
    "a9_label_regions",
    f"WITH {REGIONS} SELECT {M}, y, x, nr AS ne_label FROM {{mask}} m JOIN rk USING ({M}, ne_label)",
)
def _(v):
    return px.label_regions(v("mask"), px.MASK)


# regions of runs, from runs without a neighbour above them; the smallest that reaches a run names its region
SHAPES = """RECURSIVE sp AS (SELECT DISTINCT fov_id, y, x FROM {shapes} q),
    pr AS (SELECT *, x - row_number() OVER (PARTITION BY fov_id, y ORDER BY x) AS g FROM sp),
    ru AS (SELECT fov_id, y, min(x) AS a, max(x) AS b, y * 1000 + min(x) AS id FROM pr GROUP BY fov_id, y, g),
    dn AS (SELECT p.fov_id, p.id AS u, q.id AS v FROM ru p JOIN ru q
           ON p.fov_id = q.fov_id AND q.y = p.y + 1 AND q.a <= p.b + 1 AND q.b >= p.a - 1),
    lk AS (SELECT * FROM dn UNION ALL SELECT fov_id, v, u FROM dn),
    re AS (SELECT fov_id, id AS u, id AS v FROM ru ANTI JOIN (SELECT fov_id, v AS id FROM dn) n USING (fov_id, id)
           UNION SELECT re.fov_id, re.u, lk.v FROM re JOIN lk ON lk.fov_id = re.fov_id AND lk.u = re.v),
    na AS (SELECT fov_id, v AS id, min(u) AS head FROM re GROUP BY ALL),
    nr AS (SELECT fov_id, head, row_number() OVER (PARTITION BY fov_id ORDER BY head) AS nr FROM (SELECT DISTINCT fov_id, head FROM na) t)
    SELECT sp.fov_id, sp.y, sp.x, nr.nr AS ne_label FROM sp JOIN ru ON ru.fov_id = sp.fov_id AND ru.y = sp.y AND sp.x BETWEEN ru.a AND ru.b
    JOIN na ON na.fov_id = ru.fov_id AND na.id = ru.id JOIN nr ON nr.fov_id = na.fov_id AND nr.head = na.head"""


@query("a9_label_shapes", f"WITH {SHAPES}")
def _(v):
    return px.label_regions(v("shapes"), ["fov_id"])


@query("a9_label_shapes_tiles", f"WITH {SHAPES}")
def _(v):
    return px.label_regions(v("shapes"), ["fov_id"], side=16)


@query(
    "a9_clear_border",
    f"""SELECT {M}, ne_label, y, x FROM (
            SELECT {M}, ne_label, y, x, max(CASE WHEN y <= 0 OR x <= 0 OR y >= 105 OR x >= 126 THEN 1 ELSE 0 END)
                   OVER (PARTITION BY {M}, ne_label) AS touch FROM {{mask}} m) t WHERE touch = 0""",
)
def _(v):
    return px.clear_border(v("mask"), px.MASK, 106, 127)


SEG_ENDS = """sn AS (SELECT fov_id, channel, ne_label || '/' || segment AS segment, arg_min(y, idx) AS ya, arg_min(x, idx) AS xa,
    arg_max(y, idx) AS yd, arg_max(x, idx) AS xd FROM {segments} s GROUP BY ALL),
    lk AS (SELECT a.fov_id, a.channel, a.segment AS u, b.segment AS v FROM sn a JOIN sn b ON a.fov_id = b.fov_id AND a.channel = b.channel
           WHERE least(sqrt(pow(a.ya - b.ya, 2) + pow(a.xa - b.xa, 2)), sqrt(pow(a.ya - b.yd, 2) + pow(a.xa - b.xd, 2)),
                       sqrt(pow(a.yd - b.ya, 2) + pow(a.xd - b.xa, 2)), sqrt(pow(a.yd - b.yd, 2) + pow(a.xd - b.xd, 2))) <= 15e-1)"""


@query(
    "a9_segment_clusters",
    f"""WITH RECURSIVE {SEG_ENDS}, re AS (SELECT fov_id, channel, u, u AS v FROM lk
            UNION SELECT re.fov_id, re.channel, re.u, lk.v FROM re JOIN lk ON lk.fov_id = re.fov_id AND lk.channel = re.channel AND lk.u = re.v)
        SELECT fov_id, channel, u AS segment, min(v) AS cluster FROM re GROUP BY fov_id, channel, u""",
)
def _(v):
    ends = br.segment_ends(_segments(v))
    named = ends.withColumn("segment", F.concat_ws("/", "ne_label", "segment"))
    return cp.segment_clusters(named, ["fov_id", "channel"], 1.5)


@query(
    "j22_masked_intensity",
    """WITH im AS (SELECT fov_id, y, x, avg(value) AS v FROM {pixels} p GROUP BY fov_id, y, x)
       SELECT m.fov_id, m.channel, m.ne_label, m.y, m.x, R(coalesce(v / mx, 0)) AS value
       FROM {mask} m LEFT JOIN (SELECT *, max(v) OVER (PARTITION BY fov_id) AS mx FROM im) i
            ON i.fov_id = m.fov_id AND i.y = m.y AND i.x = m.x""",
)
def _(v):
    image = px.relative_mean(px.frame_mean(v("pixels"), FOV), FOV)
    return px.masked_intensity(v("mask"), image, FOV)


@query(
    "d4_on_mask_segments",
    f"""WITH pc AS (SELECT fov_id, channel, ne_label, idx, I(least(greatest(round_even(y * 16e-1, 0), 0), 149)) AS py,
                           I(least(greatest(round_even(x * 16e-1, 0), 0), 129)) AS px FROM {{curve}} c),
        mk AS (SELECT DISTINCT fov_id, channel, y, x FROM {{mask}} m),
        fl AS (SELECT pc.*, mk.y IS NOT NULL AS flag FROM pc LEFT JOIN mk ON mk.fov_id = pc.fov_id AND mk.channel = pc.channel AND mk.y = py AND mk.x = px),
        gp AS (SELECT *, idx - row_number() OVER (PARTITION BY fov_id, channel, ne_label ORDER BY idx) AS g FROM fl WHERE flag),
        ru AS (SELECT fov_id, channel, ne_label, min(idx) AS start, max(idx) AS stop FROM gp GROUP BY fov_id, channel, ne_label, g),
        nu AS (SELECT *, row_number() OVER (PARTITION BY fov_id, channel, ne_label ORDER BY start) - 1 AS nr FROM ru)
        SELECT fov_id, channel, ne_label, printf('segment_%02d', nr) AS segment, start, stop FROM nu WHERE stop - start >= 1""",
)
def _(v):
    points = v("curve").select(*cv.CURVE, "idx", (F.col("y") * 1.6).alias("y"), (F.col("x") * 1.6).alias("x"))
    return px.on_mask_segments(points, v("mask"), cv.CURVE, ["fov_id", "channel"], 150, 130, least=2)


# boxes of one field and label exist per channel, so the channel is part of the label here
BOXED = """bx AS (SELECT fov_id, channel || '/' || ne_label AS ne_label, final_top, final_left, final_bottom, final_right FROM {boxes} b),
    im AS (SELECT fov_id, y, x, sum(value) AS value FROM {pixels} p GROUP BY fov_id, y, x),
    cr AS (SELECT im.fov_id, ne_label, y - final_top AS y, x - final_left AS x, I(value) AS value FROM im JOIN bx ON im.fov_id = bx.fov_id
           AND y >= final_top AND y < final_bottom AND x >= final_left AND x < final_right)"""


def _boxed(v, lists: bool = False) -> tuple[DataFrame, DataFrame]:
    image = v("pixels_by_place").groupBy("fov_id", "y", "x").agg(F.sum("value").alias("value"))
    label = F.concat_ws("/", "channel", "ne_label").alias("ne_label")
    boxes = v("boxes").select("fov_id", label, "final_top", "final_left", "final_bottom", "final_right")
    return px.crop(image, boxes, FOV, lists=lists), boxes


@query("j18_crop", f"WITH {BOXED} SELECT fov_id, ne_label, y, x, value FROM cr")
def _(v):
    return _boxed(v)[0]


@query(
    "j18_pad_crops",
    f"""WITH {BOXED}, gr AS (SELECT fov_id, ne_label, gy, unnest(generate_series(0, 79)) AS gx FROM
                             (SELECT fov_id, ne_label, unnest(generate_series(0, 79)) AS gy FROM bx) q),
        pd AS (SELECT gr.fov_id, gr.ne_label, gy, gx, I(coalesce(value, 0)) AS value FROM gr LEFT JOIN cr
               ON cr.fov_id = gr.fov_id AND cr.ne_label = gr.ne_label AND cr.y = gy - 2 AND cr.x = gx - 2)
        SELECT fov_id, ne_label, count(*) AS n_pixels, I(sum(value)) AS total, I(sum(value * gy)) AS by_row, I(sum(value * gx)) AS by_column
        FROM pd GROUP BY fov_id, ne_label""",
)
def _(v):
    crops, boxes = _boxed(v, lists=True)
    lines = px.pad_lines(crops, boxes, FOV, 80, 80)
    each = lines.select("fov_id", "ne_label", "y", F.posexplode("values").alias("x", "value"))
    return each.groupBy("fov_id", "ne_label").agg(
        F.count("*").alias("n_pixels"),
        F.sum("value").alias("total"),
        F.sum(F.col("value") * F.col("y")).alias("by_row"),
        F.sum(F.col("value") * F.col("x")).alias("by_column"),
    )


SHIFTS = "(SELECT unnest(generate_series(-5, 5)) AS dy) gy, (SELECT unnest(generate_series(-5, 5)) AS dx) gx"


def _centred(source: str, keys: str) -> str:
    return f"""SELECT *, (value - avg(value) OVER k) / (stddev_pop(value) OVER k * sqrt(count(*) OVER k)) AS z FROM {source}
               WINDOW k AS (PARTITION BY {keys})"""


def _shift(keys: str) -> str:
    """Scores and best shift between the images ``ia`` and ``ib``."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    both = ", ".join(f"b.{k}" for k in keys.split(", "))
    return f"""za AS ({_centred('ia', keys)}), zb AS ({_centred('ib', keys)}),
        sc AS (SELECT {both}, dy, dx, sum(a.z * b.z) AS score FROM zb b, {SHIFTS}, za a
               WHERE {on} AND a.y = b.y + dy AND a.x = b.x + dx GROUP BY {both}, dy, dx),
        rk AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(score, 9) DESC, dy * dy + dx * dx, dy, dx) AS rn FROM sc),
        nb AS (SELECT {both}, b.dy AS bdy, b.dx AS bdx, round(b.score, 9) AS best, b.score AS c,
                      max(a.score) FILTER (a.dy = b.dy - 1 AND a.dx = b.dx) AS u, max(a.score) FILTER (a.dy = b.dy + 1 AND a.dx = b.dx) AS d,
                      max(a.score) FILTER (a.dy = b.dy AND a.dx = b.dx - 1) AS l, max(a.score) FILTER (a.dy = b.dy AND a.dx = b.dx + 1) AS r
               FROM rk b JOIN sc a ON {on} WHERE rn = 1 GROUP BY {both}, b.dy, b.dx, b.score),
        sh AS (SELECT {keys}, best, bdy + coalesce(CASE WHEN u - 2 * c + d < 0 THEN 5e-1 * (u - d) / (u - 2 * c + d) ELSE 0 END, 0) AS shift_y,
                      bdx + coalesce(CASE WHEN l - 2 * c + r < 0 THEN 5e-1 * (l - r) / (l - 2 * c + r) ELSE 0 END, 0) AS shift_x FROM nb)"""


@query(
    "a41_shift_by_correlation",
    f"""WITH ia AS (SELECT fov_id, y, x, avg(value) AS value FROM {{stack}} s WHERE frame % 2 = 0 GROUP BY fov_id, y, x),
        ib AS (SELECT fov_id, y, x, avg(value) AS value FROM {{stack}} s WHERE frame % 2 = 1 GROUP BY fov_id, y, x), {_shift('fov_id')}
        SELECT fov_id, R(best) AS best_score, R(shift_y) AS shift_y, R(shift_x) AS shift_x FROM sh""",
)
def _(v):
    stack = v("stack")
    one, two = (px.frame_mean(stack.filter(F.col("frame") % 2 == r), FOV) for r in (0, 1))
    return px.shift_by_correlation(one, two, FOV)


@query(
    "a41_shift_per_slice",
    f"""WITH sl AS (SELECT fov_id, frame % 2 AS half, 'slice_' || (I(floor(frame / 10)) + 1) AS slice_id, y, x, avg(value) AS value FROM {{stack}} s
                    WHERE frame < 50 GROUP BY ALL),
        ia AS (SELECT * EXCLUDE (half) FROM sl WHERE half = 0), ib AS (SELECT * EXCLUDE (half) FROM sl WHERE half = 1), {_shift('fov_id, slice_id')}
        SELECT fov_id, slice_id, R(best) AS best_score, R(shift_y) AS shift_y, R(shift_x) AS shift_x FROM sh""",
)
def _(v):
    stack = v("stack")
    one, two = (px.slice_means(stack.filter(F.col("frame") % 2 == r), FOV, 0, 50, 10) for r in (0, 1))
    return px.shift_by_correlation(one, two, ["fov_id", "slice_id"])


def _drift(frame: str, keys: str, extra: str = "") -> str:
    k = keys + (", half" if extra else "")
    return f"""st AS (SELECT fov_id{extra}, {frame} AS frame, y, x, value FROM {{stack}} s),
        sz AS (SELECT {k}, max(frame) + 1 AS size FROM st GROUP BY {k}),
        bi AS (SELECT {k}, nr AS bin, (nr + 5e-1) * any_value(size) / 4 AS center, y, x, avg(value) AS value
               FROM (SELECT st.*, size, (SELECT max(j) FROM (VALUES (0), (1), (2), (3)) t(j) WHERE floor(j * size / 4e0) <= frame) AS nr
                     FROM st JOIN sz USING ({k})) q GROUP BY {k}, nr, y, x),
        ia AS (SELECT {k}, bin + 1 AS bin, y, x, value FROM bi WHERE bin < 3), ib AS (SELECT {k}, bin, y, x, value FROM bi WHERE bin > 0),
        {_shift(k + ', bin')}, ce AS (SELECT DISTINCT {k}, bin, center FROM bi),
        dr AS (SELECT {k}, I(bin) AS idx, center, sum(coalesce(shift_y, 0)) OVER w AS dy, sum(coalesce(shift_x, 0)) OVER w AS dx
               FROM ce LEFT JOIN sh USING ({k}, bin) WINDOW w AS (PARTITION BY {k} ORDER BY bin))"""


@query(
    "a42_bin_drift",
    f"WITH {_drift('frame', 'fov_id')} SELECT fov_id, idx, R(center) AS center, R(dy) AS dy, R(dx) AS dx FROM dr",
)
def _(v):
    return px.bin_drift(v("stack"), FOV, 4)


@query(
    "a42_drift_halves",
    f"""WITH {_drift("I(floor(frame / 2))", 'fov_id', ", CASE WHEN frame % 2 = 0 THEN 'even' ELSE 'odd' END AS half")}
        SELECT fov_id, half, idx, R(center) AS center, R(dy) AS dy, R(dx) AS dx FROM dr""",
)
def _(v):
    return px.drift_halves(v("stack"), FOV, 4)


@query(
    "j21_interp_drift",
    f"""WITH {_drift('frame', 'fov_id')}, nx AS (SELECT *, lead(center) OVER w AS c2, lead(dy) OVER w AS dy2, lead(dx) OVER w AS dx2 FROM dr
                                                  WINDOW w AS (PARTITION BY fov_id ORDER BY idx)),
        fr AS (SELECT fov_id, unnest(generate_series(0, I(size - 1))) AS frame FROM sz),
        pk AS (SELECT fr.fov_id, fr.frame, arg_max(idx, CASE WHEN center <= frame THEN idx ELSE -1 - idx END) AS ix
               FROM fr JOIN nx ON nx.fov_id = fr.fov_id AND c2 IS NOT NULL GROUP BY fr.fov_id, fr.frame)
        SELECT pk.fov_id, pk.frame, R(dy + (frame - center) / (c2 - center) * (dy2 - dy)) AS dy,
               R(dx + (frame - center) / (c2 - center) * (dx2 - dx)) AS dx
        FROM pk JOIN nx ON nx.fov_id = pk.fov_id AND nx.idx = pk.ix""",
)
def _(v):
    stack = v("stack")
    size = stack.groupBy("fov_id").agg((F.max("frame") + 1).alias("size"))
    return cv.interp_drift(px.bin_drift(stack, FOV, 4), FOV, size)


@query(
    "j21_smooth_drift",
    f"""WITH {_drift('frame', 'fov_id')}, lo AS (SELECT fov_id, idx, center, 'dy' AS axis, dy AS v FROM dr UNION ALL SELECT fov_id, idx, center, 'dx', dx FROM dr),
        pv AS (SELECT fov_id, axis, max(center) FILTER (idx = 0) AS t0, max(center) FILTER (idx = 1) AS t1, max(center) FILTER (idx = 2) AS t2,
                      max(center) FILTER (idx = 3) AS t3, max(v) FILTER (idx = 0) AS v0, max(v) FILTER (idx = 1) AS v1,
                      max(v) FILTER (idx = 2) AS v2, max(v) FILTER (idx = 3) AS v3 FROM lo GROUP BY fov_id, axis),
        st3 AS (SELECT *, t1 - t0 AS h0, t2 - t1 AS h1, t3 - t2 AS h2, 6 * ((v2 - v1) / (t2 - t1) - (v1 - v0) / (t1 - t0)) AS r1,
                       6 * ((v3 - v2) / (t3 - t2) - (v2 - v1) / (t2 - t1)) AS r2 FROM pv),
        be AS (SELECT *, (2 * (h1 + h2) * r1 - h1 * r2) / (4 * (h0 + h1) * (h1 + h2) - h1 * h1) AS m1,
                      (2 * (h0 + h1) * r2 - h1 * r1) / (4 * (h0 + h1) * (h1 + h2) - h1 * h1) AS m2 FROM st3),
        fr AS (SELECT fov_id, unnest(generate_series(0, I(size - 1))) AS frame FROM sz),
        pc AS (SELECT fr.fov_id, frame, axis, CASE WHEN frame < t1 THEN 0e0 WHEN frame < t2 THEN m1 ELSE m2 END AS ma,
                      CASE WHEN frame < t1 THEN m1 WHEN frame < t2 THEN m2 ELSE 0e0 END AS mb,
                      CASE WHEN frame < t1 THEN v0 WHEN frame < t2 THEN v1 ELSE v2 END AS va, CASE WHEN frame < t1 THEN v1 WHEN frame < t2 THEN v2 ELSE v3 END AS vb,
                      CASE WHEN frame < t1 THEN t0 WHEN frame < t2 THEN t1 ELSE t2 END AS ta, CASE WHEN frame < t1 THEN t1 WHEN frame < t2 THEN t2 ELSE t3 END AS tb
               FROM fr JOIN be USING (fov_id)),
        ev AS (SELECT fov_id, frame, axis, (ma * pow(tb - frame, 3) + mb * pow(frame - ta, 3)) / (6 * (tb - ta))
                      + (va / (tb - ta) - ma * (tb - ta) / 6) * (tb - frame) + (vb / (tb - ta) - mb * (tb - ta) / 6) * (frame - ta) AS v FROM pc)
        SELECT fov_id, frame, R(max(v) FILTER (axis = 'dy')) AS dy, R(max(v) FILTER (axis = 'dx')) AS dx FROM ev GROUP BY fov_id, frame""",
)
def _(v):
    stack = v("stack")
    size = stack.groupBy("fov_id").agg((F.max("frame") + 1).alias("size"))
    return cv.smooth_drift(px.bin_drift(stack, FOV, 4), FOV, size)


@query(
    "j18_padded_rows",
    f"""WITH {BOXED}, gr AS (SELECT fov_id, ne_label, gy, unnest(generate_series(0, 79)) AS gx FROM
                             (SELECT fov_id, ne_label, unnest(generate_series(0, 79)) AS gy FROM bx) q)
        SELECT gr.fov_id, gr.ne_label, gy AS y, string_agg(I(coalesce(value, 0)), ',' ORDER BY gx) AS pixels FROM gr LEFT JOIN cr
               ON cr.fov_id = gr.fov_id AND cr.ne_label = gr.ne_label AND cr.y = gy - 2 AND cr.x = gx - 2 GROUP BY gr.fov_id, gr.ne_label, gy""",
)
def _(v):
    """Every pixel of the padded crops, a text for each row of an image."""
    crops, boxes = _boxed(v, lists=True)
    lines = px.pad_lines(crops, boxes, FOV, 80, 80, sep=",")
    return lines.select("fov_id", "ne_label", "y", F.col("values").alias("pixels"))
