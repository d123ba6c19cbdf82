"""Measurement-shaped views over the test tables.

Each view reads whole tables and derives microscopy-like rows from them, so its size grows
with its tables.  The same text runs in Spark and in the SQL check; only the spelling of row
generators differs between the two.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perinuc.scale import TILE, apart, cut, dealt, join_nulls, positions

TABLES = {"supplier", "customer", "part", "lineitem", "orders", "events", "embeddings"}

# Added before rounding on both sides: moves exact decimal ties, which engines round differently.
NUDGE = "1.2345e-9"

VIEWS: dict[str, str] = {}

VIEWS["reg_slice"] = """
SELECT mode, fov_id, ne_label, slice_id,
       1 + (s_qty * 1e0 / n - 25) / 10000 AS scale, (s_tax * 1e0 / n - 4) / 1000 AS angle,
       (s_disc * 1e0 / n - 5) / 10 + CASE WHEN mode = 2 AND moved = 0 THEN 6e-1 ELSE 0e0 END AS shift_y,
       (s_tax * 1e0 / n - 4) / 10 AS shift_x
FROM (SELECT CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS mode,
             PAD(CAST(l_suppkey AS STRING)) AS fov_id,
             lpad(CAST(l_partkey % 100 AS STRING), 4, '0') AS ne_label,
             concat('slice_', CAST(l_linenumber AS STRING)) AS slice_id,
             sum(CAST(l_quantity AS BIGINT)) AS s_qty, sum(CAST(round(l_discount * 100) AS BIGINT)) AS s_disc,
             sum(CAST(round(l_tax * 100) AS BIGINT)) AS s_tax, count(*) AS n,
             min((l_partkey % 100 * 7 + l_suppkey) % 5) AS moved
      FROM {lineitem} GROUP BY 1, 2, 3, 4) t
"""

VIEWS["reg_label"] = """
SELECT mode, fov_id, ne_label, round(avg(scale), 9) AS scale, round(avg(angle), 9) AS angle,
       round(avg(shift_y), 9) AS shift_y, round(avg(shift_x), 9) AS shift_x
FROM {reg_slice} s GROUP BY mode, fov_id, ne_label
"""

VIEWS["reg_fov"] = """
SELECT mode, fov_id, round(avg(scale), 9) AS scale, round(avg(angle), 9) AS angle,
       round(avg(shift_y), 9) + CASE WHEN mode = 2 AND fov_id LIKE '%7' THEN 3e0 ELSE 0e0 END AS shift_y,
       round(avg(shift_x), 9) AS shift_x, round(stddev_pop(shift_y), 9) AS ch_reg_prec
FROM {reg_slice} s GROUP BY mode, fov_id
"""

VIEWS["reg_pairs"] = """
SELECT fov_id, ne_label AS ch1_label, lpad(CAST((CAST(ne_label AS INT) + 3) % 100 AS STRING), 4, '0') AS ch2_label
FROM (SELECT DISTINCT fov_id, ne_label FROM {reg_slice} s WHERE mode = 1 AND slice_id <> 'slice_7') t
"""

VIEWS["experiment_key"] = """
SELECT concat('BMY14', lpad(CAST(s_nationkey % 7 AS STRING), 2, '0')) AS strain,
       concat('2024010', CAST(s_suppkey % 2 + 1 AS STRING)) AS date,
       CASE WHEN s_acctbal > 5000 THEN 'batch 2' ELSE NULL END AS addl_info,
       PAD(CAST(s_suppkey AS STRING)) AS fov_id
FROM {supplier} s
"""

VIEWS["fov_results"] = """
SELECT k.strain AS strain, 'x' AS addl_info, concat('mode', CAST(r.mode AS STRING)) AS mode, r.fov_id AS fov_id,
       r.scale AS scale, r.angle AS angle, r.shift_y AS shift_y, r.shift_x AS shift_x
FROM {reg_fov} r JOIN {experiment_key} k ON r.fov_id = k.fov_id
"""

VIEWS["label_results"] = """
SELECT k.strain AS strain, k.date AS date, k.addl_info AS addl_info, concat('mode', CAST(r.mode AS STRING)) AS mode,
       r.fov_id AS fov_id, r.ne_label AS ne_label,
       r.scale AS scale, CASE WHEN r.ne_label = '0013' THEN NULL ELSE r.angle END AS angle,
       r.shift_y AS shift_y, r.shift_x AS shift_x
FROM {reg_label} r JOIN {experiment_key} k ON r.fov_id = k.fov_id
"""

VIEWS["boxes"] = """
SELECT channel, PAD(CAST(CAST(floor(pk / 12) AS BIGINT) AS STRING)) AS fov_id, pk AS ord,
       lpad(CAST(pk % 12 AS STRING), 2, '0') AS ne_label, 75 AS height, 75 AS width,
       l AS final_left, t AS final_top, l + 75 AS final_right, t + 75 AS final_bottom,
       CASE WHEN size = 50 THEN NULL ELSE t + 37 + size % 4 * 5e-1 END AS cy,
       CASE WHEN size = 50 THEN NULL ELSE l + 37 + size % 3 * 5e-1 END AS cx
FROM (SELECT 'ch1' AS channel, p_partkey AS pk, p_size AS size,
             CAST(p_partkey % 4 * 12 + 10 + p_size % 5 AS BIGINT) AS l,
             CAST(floor(p_partkey / 4) AS BIGINT) % 3 * 14 + 5 + p_size % 3 AS t
      FROM {part} a
      UNION ALL
      SELECT 'ch2', p_partkey, p_size, CAST(p_partkey % 4 * 12 + 10 + p_size % 11 AS BIGINT),
             CAST(floor(p_partkey / 4) AS BIGINT) % 3 * 14 + 5 + p_size % 7
      FROM {part} b) t
"""

VIEWS["event_order"] = """
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx,
       count(*) OVER (PARTITION BY user_id) AS n
FROM {events} e
"""

VIEWS["curve"] = """
SELECT fov_id, ne_label, channel, idx, n,
       round(375e-1 + (r + dr) * sin(6283185307179586e-15 * idx / n), 6) AS y,
       round(375e-1 + (r + dr) * cos(6283185307179586e-15 * idx / n), 6) AS x
FROM (SELECT PAD(CAST(CAST(floor(user_id / 4) AS BIGINT) AS STRING)) AS fov_id,
             lpad(CAST(user_id % 4 AS STRING), 2, '0') AS ne_label, idx, n, 20 + user_id % 5 AS r
      FROM {event_order} e) c
JOIN (SELECT 'ch1' AS channel, 0e0 AS dr UNION ALL SELECT 'ch2' AS channel, 8e-1 AS dr) d ON TRUE
"""

VIEWS["segment_events"] = """
SELECT PAD(CAST(CAST(floor(user_id / 4) AS BIGINT) AS STRING)) AS fov_id,
       lpad(CAST(user_id % 4 AS STRING), 2, '0') AS ne_label, event_id,
       CASE WHEN event_type IN ('view', 'click', 'error') THEN 'ch1' ELSE 'ch2' END AS channel,
       event_id % 3 AS seg, 20 + user_id % 5 AS r, event_id % 5 - 2 AS wob
FROM {events} e
"""

VIEWS["segment_order"] = """
SELECT fov_id, ne_label, channel, seg, r, wob,
       CAST(row_number() OVER (PARTITION BY fov_id, ne_label, channel, seg ORDER BY event_id) - 1 AS BIGINT) AS idx,
       count(*) OVER (PARTITION BY fov_id, ne_label, channel, seg) AS m
FROM {segment_events} t
"""

VIEWS["segments"] = """
SELECT fov_id, ne_label, channel, concat('segment_0', CAST(seg AS STRING)) AS segment, idx, m,
       round(375e-1 + r * sin(20943951023931953e-16 * (seg + 85e-2 * idx / (m - 1))) + 1e-2 * wob, 6) AS y,
       round(375e-1 + r * cos(20943951023931953e-16 * (seg + 85e-2 * idx / (m - 1))) + 1e-2 * wob, 6) AS x
FROM {segment_order} u
WHERE m > 1
"""

VIEWS["mask"] = """
SELECT fov_id, channel, ne_label, CAST(20 + 40 * (k % 4) + oy0 AS BIGINT) AS y,
       CAST(20 + 50 * (k - k % 4) / 4 + ox0 AS BIGINT) AS x
FROM (SELECT fov_id, channel, ne_label, k, rad, sy, sx, oy0, {SERIES:-9,9} AS ox0
      FROM (SELECT PAD(CAST(CAST(floor(pk / 12) AS BIGINT) AS STRING)) AS fov_id,
                   CASE WHEN ch = 1 THEN 'ch1' ELSE 'ch2' END AS channel, pk % 12 + 1 AS ne_label, pk % 12 AS k,
                   3 + size % 4 AS rad, CASE WHEN ch = 1 THEN 0 ELSE size % 3 END AS sy,
                   CASE WHEN ch = 1 THEN 0 ELSE size % 2 END AS sx, {SERIES:-9,9} AS oy0
            FROM (SELECT p_partkey AS pk, p_size AS size, {SERIES:1,2} AS ch FROM {part} p) q) r) s
WHERE (oy0 - sy) * (oy0 - sy) + (ox0 - sx) * (ox0 - sx) <= rad * rad
"""

# U shapes, spirals, crosses and chequers in cells that lie beside each other; some are moved onto their neighbours
VIEWS["shapes"] = """
SELECT fov_id, CAST(1 + 16 * (k % 4) + dy - CASE WHEN size % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS y,
       CAST(1 + 16 * (k - k % 4) / 4 + dx - CASE WHEN size % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS x
FROM (SELECT fov_id, k, size, dy, dx, least(dy, dx, 14 - dy, 14 - dx) AS d
      FROM (SELECT fov_id, k, size, dy, {SERIES:0,14} AS dx
            FROM (SELECT PAD(CAST(CAST(floor(p_partkey / 12) AS BIGINT) AS STRING)) AS fov_id, p_partkey % 12 AS k, p_size AS size,
                         {SERIES:0,14} AS dy FROM {part} p) q) r) s
WHERE CASE size % 4 WHEN 0 THEN dx <= 1 OR dx >= 13 OR dy >= 13
                    WHEN 1 THEN (d % 2 = 0) <> (dx = d AND dy = d + 1)
                    WHEN 2 THEN dx = dy OR dx + dy = 14
                    ELSE (dx + dy) % 2 = 0 END
"""

VIEWS["pixels"] = """
SELECT PAD(CAST(l_suppkey AS STRING)) AS fov_id, CAST(l_quantity AS BIGINT) - 1 AS frame,
       l_partkey % 75 AS y, l_orderkey % 75 AS x, sum(CAST(round(l_extendedprice) AS BIGINT)) AS value
FROM {lineitem} l GROUP BY 1, 2, 3, 4
"""

VIEWS["stack"] = """
SELECT PAD(CAST(CAST(floor(vec_id / 50) AS BIGINT) AS STRING)) AS fov_id, vec_id % 50 AS frame,
       CAST(floor(i / 8) AS BIGINT) AS y, CAST(i % 8 AS BIGINT) AS x, CAST(e AS DOUBLE) AS e,
       CAST(round(1000 + 1000 * CAST(e AS DOUBLE)) AS BIGINT) AS value
FROM (SELECT vec_id, {POSITIONS:embedding} FROM {embeddings} v) t
"""

VIEWS["calibration"] = """
SELECT frame_no AS frame, y, x,
       round(500 + 100 * (y + x) + 20 * e * sqrt(500e0 + 100 * (y + x)), 3) AS bright,
       100 + (frame_no * 31 + y * 17 + x * 13) % 5 AS dark
FROM (SELECT CAST(fov_id AS BIGINT) * 50 + frame AS frame_no, y, x, e FROM {stack} s) t
"""

VIEWS["profiles"] = """
SELECT profile_index, k, k * 12 / 49e0 AS dist,
       CASE WHEN size = 1 THEN 100e0 WHEN size = 2 THEN 100e0 + k % 5 ELSE
       round(100 + 2e0 * k + (size - 1) * 5 * exp(-pow(k * 12 / 49e0 - 6 - (profile_index % 7 - 3) * 3e-1, 2) / 288e-2), 6)
         + (profile_index * 31 + k * 17) % 13 - 6 END AS intensity
FROM (SELECT p_partkey AS profile_index, p_size AS size, {SERIES:0,49} AS k FROM {part} p) t
"""

# likelihood ratios up to several hundred, below zero, and in ties
VIEWS["lr"] = """
SELECT o_orderkey AS roi_id, o_orderpriority AS batch,
       CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice / 1000 WHEN o_orderkey % 11 = 0 THEN floor(o_totalprice / 20000) * 1e0
            WHEN o_orderkey % 13 = 0 THEN -o_totalprice / 20000 ELSE o_totalprice / 20000 END AS lr FROM {orders} o
"""

VIEWS["distances"] = """
SELECT PAD(CAST(l_suppkey AS STRING)) AS fov_id, lpad(CAST(l_partkey % 12 AS STRING), 2, '0') AS ch1_label,
       lpad(CAST((l_partkey + 3) % 12 AS STRING), 2, '0') AS ch2_label, l_orderkey AS okey, l_linenumber AS lnum,
       l_partkey AS pkey,
       (l_extendedprice - 50000) / 200 + (l_partkey % 12 - 6) * 120 AS dist_nm,
       CASE WHEN l_returnflag = 'A' THEN 'data_data' WHEN l_returnflag = 'N' THEN 'data_bridge'
            WHEN l_linestatus = 'F' THEN 'bridge_data' ELSE 'bridge_bridge' END AS pair_type
FROM {lineitem} l
"""

VIEWS["profile_log"] = """
SELECT PAD(CAST(l_suppkey AS STRING)) AS fov_id, CASE WHEN l_linestatus = 'F' THEN 'ch1' ELSE 'ch2' END AS channel,
       lpad(CAST(l_partkey % 12 AS STRING), 2, '0') AS ne_label, concat('segment_0', CAST(l_linenumber % 3 AS STRING)) AS seg_label,
       CASE WHEN l_quantity > 15 THEN 'success' WHEN l_quantity > 10 THEN 'fail:likelihood_ratio'
            WHEN l_quantity > 6 THEN 'fail:all_step_sizes' WHEN l_quantity > 3 THEN 'skip:low_contrast'
            ELSE 'skip:out_of_bounds' END AS status,
       l_tax > 0.07 AS was_reverted,
       CASE WHEN l_quantity > 3 THEN l_extendedprice / 100 ELSE NULL END AS intensity_mean,
       CASE WHEN l_quantity > 3 THEN l_discount * 100 ELSE NULL END AS intensity_std,
       CASE WHEN l_quantity > 3 THEN l_quantity * 3 ELSE NULL END AS intensity_range
FROM {lineitem} l
"""

VIEWS["u_values"] = """
SELECT user_id AS curve_id, event_id, ((event_id * 7919) % 10000) / 10000e0 AS u FROM {events} e
"""

VIEWS["ledger"] = """
SELECT event_id, ts, concat('ch', CAST(user_id % 2 + 1 AS STRING)) AS channel,
       PAD(CAST(CAST(floor(user_id / 12) AS BIGINT) AS STRING)) AS fov_id,
       lpad(CAST(user_id % 12 AS STRING), 2, '0') AS ne_label,
       concat('Reg Filter: ', event_type) AS event,
       CASE event_type WHEN 'error' THEN 'registration' WHEN 'signup' THEN 'paired' WHEN 'view' THEN 'refined_fit'
            ELSE 'detection' END AS attribute,
       CASE WHEN value > 80 THEN 'failed' ELSE 'passed' END AS value, value AS metric
FROM {events} e
"""

VIEWS["paths"] = """
SELECT concat('/img/BMY', CAST(800 + o_custkey % 5 AS STRING), '/2024-01-', lpad(CAST(o_orderkey % 28 + 1 AS STRING), 2, '0'),
              CASE WHEN o_orderstatus = 'P' THEN '' ELSE concat(' batch ', o_orderstatus) END,
              CASE o_orderpriority WHEN '5-LOW' THEN '/notes' WHEN '1-URGENT' THEN '/FoV_none'
                   ELSE concat('/FoV_', PAD(CAST(o_orderkey AS STRING))) END) AS path
FROM {orders} o
"""


def _needs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z_0-9]+)\}", text)))


def _spell(text: str, engine: str) -> str:
    # ids of eight digits or more, never cut
    text = _macro(text, "PAD", "lpad({0}, CAST(greatest(8, length({0})) AS INT), '0')")
    if engine == "spark":
        text = re.sub(r"\{SERIES:(-?\d+),(-?\d+)\}", r"explode(sequence(\1, \2))", text)
        return re.sub(r"\{POSITIONS:(\w+)\}", r"posexplode(\1) AS (i, e)", text)
    text = re.sub(r"\{SERIES:(-?\d+),(-?\d+)\}", r"unnest(generate_series(\1, \2))", text)
    return re.sub(r"\{POSITIONS:(\w+)\}", r"unnest(range(len(\1))) AS i, unnest(\1) AS e", text)


# Views that number the rows of a key: source, key, order, name of the number, name of the size.
NUMBERED = {
    "event_order": ("events", ["user_id"], ["ts", "event_id"], "idx", "n"),
    "segment_order": ("segment_events", ["fov_id", "ne_label", "channel", "seg"], ["event_id"], "idx", "m"),
}


# Views that unfold a row of a table into many: the table and the key by which its rows are dealt to tasks.
UNFOLDED = {"mask": ("part", "p_partkey"), "shapes": ("part", "p_partkey"), "profiles": ("part", "p_partkey")}
# Rows of the table that one task unfolds, a few hundred rows each.
DEALT = 2_048


# The rows of a view, dealt to tasks by part of its key: the view, the table that it adds up, and that part.  Sums over it, of a
# pixel over all frames for one, then need no second shuffle.
DEALT_BY = {"pixels_by_place": ("pixels", "lineitem", ["PAD(CAST(l_suppkey AS STRING))", "l_partkey % 75", "l_orderkey % 75"])}


def _numbered(rows: DataFrame, by: list[str], order: list[str], idx: str, size: str) -> DataFrame:
    """Same rows as the window form of the text, without sorting a key of more than a tile in one task."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias(size))
    if (sizes.agg(F.max(size)).first()[0] or 0) <= TILE:
        w = W.partitionBy(*by)
        place = (F.row_number().over(w.orderBy(*order)) - 1).cast("long")
        return rows.select("*", place.alias(idx), F.count("*").over(w).alias(size))
    return join_nulls(positions(rows, by, order, idx), apart(sizes), by)


def view(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """A view, or a plain table, as a DataFrame that no join broadcasts unasked; see ``apart``."""
    return apart(_view(spark, sf_dir, name, made))


def _view(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """A view, or a plain table; numbered and dealt rows are made once per ``made``."""
    made = {} if made is None else made
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in NUMBERED:
        if name not in made:
            source, *how = NUMBERED[name]
            # several branches of a query read these rows
            made[name] = cut(_numbered(_view(spark, sf_dir, source, made), *how))
        return made[name]
    name, *dealt_by = DEALT_BY.get(name, (name,))
    text = _spell(VIEWS[name], "spark")
    inputs = {n: _view(spark, sf_dir, n, made) for n in _needs(text)}
    if name in UNFOLDED:
        table, key = UNFOLDED[name]
        if f"{table}, dealt" not in made:
            made[f"{table}, dealt"] = dealt(inputs[table], key, DEALT)
        inputs[table] = made[f"{table}, dealt"]
    if dealt_by:
        table, key = dealt_by
        inputs[table] = inputs[table].repartition(*[F.expr(_spell(k, "spark")) for k in key])
    if "JOIN" in text:
        inputs = {n: apart(df) for n, df in inputs.items()}
    return spark.sql(text, **inputs)


def _macro(sql: str, name: str, form: str) -> str:
    """Replace ``NAME(expr)`` by ``form`` with ``{0}`` for the expression, honouring nested parentheses."""
    out, at = "", 0
    for hit in re.finditer(rf"\b{name}\(", sql):
        if hit.start() < at:
            continue
        depth, end = 1, hit.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += sql[at : hit.start()] + form.replace("{0}", sql[hit.end() : end - 1])
        at = end
    return out + sql[at:]


def oracle(sql: str) -> str:
    """Self-contained SQL: the needed views as leading common table expressions.

    ``R(x)`` rounds a double the way the queries do, ``I(x)`` casts to a 64-bit integer.
    """
    sql = _macro(sql, "R", f"(round(CAST({{0}} AS DOUBLE) + {NUDGE}, 6) + 0e0)")
    sql = _macro(sql, "I", "CAST({0} AS BIGINT)")
    parts: dict[str, str] = {}

    def add(name: str) -> None:
        if name in TABLES or name in parts:
            return
        text = _spell(VIEWS[name], "sql")
        for n in _needs(text):
            add(n)
        parts[name] = re.sub(r"\{([a-z_0-9]+)\}", r"\1", text)

    for n in _needs(sql):
        add(n)
    body = re.sub(r"\{([a-z_0-9]+)\}", r"\1", sql).strip()
    if not parts:
        return body
    ctes = ",\n".join(f"{n} AS ({t.strip()})" for n, t in parts.items())
    head = re.match(r"WITH( RECURSIVE)?\s+", body, re.I)
    if head:
        return f"{head.group(0)}{ctes}, {body[head.end():]}"
    return f"WITH {ctes} {body}"
