"""Queries on matching nuclei, key sets and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from perinuc.functions import scalars as sc
from perinuc.operators import pairing as pr
from perinuc.operators import sets as st
from perinuc.plans.registry import query

IOU = """CASE WHEN least(a.final_right, b.final_right) < greatest(a.final_left, b.final_left)
      OR least(a.final_bottom, b.final_bottom) < greatest(a.final_top, b.final_top) THEN 0e0
      ELSE CAST((least(a.final_right, b.final_right) - greatest(a.final_left, b.final_left))
              * (least(a.final_bottom, b.final_bottom) - greatest(a.final_top, b.final_top)) AS DOUBLE)
         / ((a.final_right - a.final_left) * (a.final_bottom - a.final_top)
          + (b.final_right - b.final_left) * (b.final_bottom - b.final_top)
          - (least(a.final_right, b.final_right) - greatest(a.final_left, b.final_left))
          * (least(a.final_bottom, b.final_bottom) - greatest(a.final_top, b.final_top))) END"""
DIST = "sqrt((a.cy - b.cy) * (a.cy - b.cy) + (a.cx - b.cx) * (a.cx - b.cx))"
BOTH = "{boxes} a JOIN {boxes} b ON a.fov_id = b.fov_id AND a.channel = 'ch1' AND b.channel = 'ch2'"

# Ordered walk: candidates need fov_id, a, a_ord, b, b_ord, score
GREEDY = """
o AS (SELECT *, dense_rank() OVER (PARTITION BY fov_id ORDER BY a_ord) AS i FROM cand WHERE score > 0),
g AS (SELECT DISTINCT fov_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS a,
             CAST(NULL AS VARCHAR) AS b FROM o
      UNION ALL
      SELECT n.fov_id, n.i, CASE WHEN n.b IS NULL THEN n.used ELSE list_append(n.used, n.b) END, n.a, n.b
      FROM (SELECT g.fov_id, g.i + 1 AS i, g.used, max(o.a) AS a,
                   arg_min(o.b, (-o.score, o.b_ord)) FILTER (NOT list_contains(g.used, o.b)) AS b
            FROM g JOIN o ON o.fov_id = g.fov_id AND o.i = g.i + 1 GROUP BY g.fov_id, g.i, g.used) n)
"""


def _sides(v):
    boxes = v("boxes")
    return boxes.filter("channel = 'ch1'"), boxes.filter("channel = 'ch2'")


@query(
    "p9_box_iou",
    f"SELECT a.fov_id, a.ne_label, R({IOU}) AS iou FROM {BOTH} AND a.ne_label = b.ne_label",
)
def _(v):
    a, b = _sides(v)
    keys = ["fov_id", "ne_label"]
    joined = a.select(*keys, *pr._sides(a, "a_")).join(b.select(*keys, *pr._sides(b, "b_")), keys)
    return joined.select(*keys, sc.box_iou("a_", "b_").alias("iou"))


@query(
    "p10_pair_score",
    f"""SELECT fov_id, ch1_label, a_ord, ch2_label, b_ord, R(iou) AS iou, R(dist) AS dist, R(iou / (1 + dist)) AS score
        FROM (SELECT a.fov_id, a.ne_label AS ch1_label, a.ord AS a_ord, b.ne_label AS ch2_label, b.ord AS b_ord,
                     {IOU} AS iou, {DIST} AS dist FROM {BOTH}) t WHERE iou >= 7e-1 AND dist <= 10""",
)
def _(v):
    return pr.box_candidates(*_sides(v))


@query(
    "j6_iou_best_match",
    f"""SELECT fov_id, ch1_label, arg_min(ch2_label, (-iou, b_ord)) AS ch2_label, R(max(iou)) AS iou
        FROM (SELECT a.fov_id, a.ne_label AS ch1_label, b.ne_label AS ch2_label, b.ord AS b_ord, {IOU} AS iou FROM {BOTH}) t
        WHERE iou >= 8e-1 GROUP BY fov_id, ch1_label""",
)
def _(v):
    return pr.iou_best_match(*_sides(v), 0.8)


BOX_GREEDY = f"""WITH RECURSIVE cand AS (SELECT fov_id, a, a_ord, b, b_ord, iou * (1 / (1 + dist)) AS score
        FROM (SELECT a.fov_id, a.ne_label AS a, a.ord AS a_ord, b.ne_label AS b, b.ord AS b_ord, {IOU} AS iou, {DIST} AS dist
              FROM {BOTH}) t WHERE iou >= 7e-1 AND dist <= 10), {GREEDY}
        SELECT fov_id, a AS ch1_label, b AS ch2_label FROM g WHERE b IS NOT NULL"""


@query("j7_greedy_pair", BOX_GREEDY)
def _(v):
    return pr.greedy_pair(*_sides(v))


@query("j7_greedy_pair_rounds", BOX_GREEDY)
def _(v):
    return pr.greedy_pair(*_sides(v))


@query(
    "j8_mask_pair",
    f"""WITH RECURSIVE m1 AS (SELECT * FROM {{mask}} q WHERE channel = 'ch1'), m2 AS (SELECT * FROM {{mask}} q WHERE channel = 'ch2'),
        r1 AS (SELECT fov_id, ne_label, count(*) AS area, avg(y) AS cy, avg(x) AS cx FROM m1 GROUP BY ALL),
        r2 AS (SELECT fov_id, ne_label, count(*) AS area, avg(y) AS cy, avg(x) AS cx FROM m2 GROUP BY ALL),
        it AS (SELECT m1.fov_id, m1.ne_label AS la, m2.ne_label AS lb, count(*) AS inter FROM m1 JOIN m2
               ON m1.fov_id = m2.fov_id AND m1.y = m2.y AND m1.x = m2.x GROUP BY ALL),
        sc AS (SELECT it.fov_id, la, lb, inter / (a.area + b.area - inter) AS iou, {DIST} AS dist
               FROM it JOIN r1 a ON a.fov_id = it.fov_id AND a.ne_label = la JOIN r2 b ON b.fov_id = it.fov_id AND b.ne_label = lb),
        cand AS (SELECT fov_id, CAST(la AS VARCHAR) AS a, la AS a_ord, CAST(lb AS VARCHAR) AS b, lb AS b_ord,
                        iou * (1 / (1 + dist)) AS score FROM sc WHERE iou >= 5e-1 AND dist <= 10), {GREEDY}
        SELECT fov_id, a AS ch1_label, b AS ch2_label FROM g WHERE b IS NOT NULL""",
)
def _(v):
    mask = v("mask")
    return pr.mask_pair(mask.filter("channel = 'ch1'"), mask.filter("channel = 'ch2'"), min_iou=0.5)


@query(
    "j9_shared_keys",
    """SELECT DISTINCT a.fov_id, a.ne_label FROM {reg_label} a JOIN {reg_label} b
       ON a.mode = 1 AND b.mode = 2 AND a.fov_id = b.fov_id AND a.ne_label = b.ne_label""",
)
def _(v):
    reg = v("reg_label")
    return st.shared_keys(reg.filter("mode = 1"), reg.filter("mode = 2"), ["fov_id", "ne_label"])


@query(
    "u2_key_sets",
    """SELECT fov_id, ne_label, CASE WHEN count(DISTINCT mode) = 2 THEN 'both' WHEN max(mode) = 1 THEN 'left'
              ELSE 'right' END AS side FROM {reg_label} r GROUP BY fov_id, ne_label""",
)
def _(v):
    reg = v("reg_label")
    return st.key_sets(reg.filter("mode = 1"), reg.filter("mode = 2"), ["fov_id", "ne_label"])


@query(
    "j10_filter_by_pairs",
    """WITH r AS (SELECT * FROM {reg_label} x), p AS (SELECT * FROM {reg_pairs} x
            WHERE fov_id IN (SELECT fov_id FROM r WHERE mode = 1) AND fov_id IN (SELECT fov_id FROM r WHERE mode = 2))
       SELECT 'ch1' AS channel, r.fov_id, r.ne_label, R(r.scale) AS scale FROM r
       WHERE r.mode = 1 AND EXISTS (SELECT 1 FROM p WHERE p.fov_id = r.fov_id AND p.ch1_label = r.ne_label)
       UNION ALL
       SELECT 'ch2', r.fov_id, r.ne_label, R(r.scale) FROM r
       WHERE r.mode = 2 AND EXISTS (SELECT 1 FROM p WHERE p.fov_id = r.fov_id AND p.ch2_label = r.ne_label)""",
)
def _(v):
    reg = v("reg_label").select("mode", "fov_id", "ne_label", "scale")
    one, two = (reg.filter(F.col("mode") == m).drop("mode") for m in (1, 2))
    return pr.filter_by_pairs(one, two, v("reg_pairs"))


@query(
    "u1_union_runs",
    """SELECT 'a' AS method, fov_id, ne_label, R(scale) AS scale, R(shift_y) AS shift_y FROM {reg_label} r WHERE mode = 1
       UNION ALL SELECT 'b', fov_id, ne_label, R(scale), NULL FROM {reg_label} r WHERE mode = 2""",
)
def _(v):
    reg = v("reg_label")
    one = reg.filter("mode = 1").select("fov_id", "ne_label", "scale", "shift_y")
    two = reg.filter("mode = 2").select("fov_id", "ne_label", "scale")
    return st.union_labelled({"a": one, "b": two})


@query(
    "u3_upsert",
    """SELECT fov_id, ne_label, R(coalesce(n.scale, o.scale)) AS scale, n.fov_id IS NOT NULL AS fresh
       FROM (SELECT * FROM {reg_label} a WHERE mode = 1) o
       FULL JOIN (SELECT * FROM {reg_label} b WHERE mode = 2) n USING (fov_id, ne_label)""",
)
def _(v):
    reg = v("reg_label")
    parts = [reg.filter(F.col("mode") == m).select("fov_id", "ne_label", "scale", F.lit(m == 2).alias("fresh")) for m in (1, 2)]
    return st.upsert(*parts, ["fov_id", "ne_label"])


@query("u4_ready_units", "SELECT DISTINCT fov_id FROM {reg_pairs} p")
def _(v):
    return st.ready_units(v("reg_pairs"), v("reg_label"))


@query("u4_ready_units_single", "SELECT DISTINCT fov_id FROM {curve} p")
def _(v):
    return st.ready_units(v("reg_pairs"), v("curve"), dual=False)


@query(
    "s17_resume",
    """SELECT fov_id, ne_label FROM {reg_label} a WHERE mode = 1
       AND NOT EXISTS (SELECT 1 FROM {reg_label} b WHERE b.mode = 2 AND b.fov_id = a.fov_id AND b.ne_label = a.ne_label)""",
)
def _(v):
    reg = v("reg_label")
    todo = reg.filter("mode = 1").select("fov_id", "ne_label")
    return st.resume(todo, reg.filter("mode = 2"), ["fov_id", "ne_label"])


@query(
    "p24_keep_indices",
    """SELECT fov_id, ne_label, slice_id, R(scale) AS scale FROM {reg_slice} a WHERE mode = 1
       AND (fov_id, ne_label, slice_id) IN (SELECT (fov_id, ne_label, slice_id) FROM {reg_slice} b WHERE mode = 2)""",
)
def _(v):
    reg = v("reg_slice")
    label = F.concat_ws("/", "fov_id", "ne_label").alias("ne_label")
    data = reg.filter("mode = 1").select(label, F.col("slice_id").alias("idx"), "scale")
    wanted = reg.filter("mode = 2").select(label, F.col("slice_id").alias("idx"))
    kept = st.keep_indices(data, wanted)
    parts = F.split("ne_label", "/")
    return kept.select(parts[0].alias("fov_id"), parts[1].alias("ne_label"), F.col("idx").alias("slice_id"), "scale")
