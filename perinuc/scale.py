"""Building blocks that keep one oversized key from landing in one task.

Curves, fields of view and batches are natural grouping keys, and any of them may
hold a large share of all rows.  A window that is partitioned by such a key sorts
the whole group in one task, so the helpers here split a group into tiles, join on
aggregates, or number rows through a range shuffle instead.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Bins that a quantile's bracket is cut into.
BINS = 1024

# Rows of one key that stay together in a window; larger keys spread over tasks.
TILE = 65_536


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the one the cluster names, or a temporary one in local mode."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return named or current
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="perinuc-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``cut`` for many rows that are read more than once: columns in the shared folder, not serialised objects.

    Partitions are not kept as they were.
    """
    path = f"{shared_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """Rows that are joined through a shuffle, whatever size the plan expects.

    That size is the one of the files, scaled by the columns that are read: it knows neither their compression nor how many
    rows come out of an ``explode``.  A table thousands of times larger would be broadcast through the driver.  The hint holds
    up to the next join, whose own expected size is a product and too large to be broadcast.
    """
    return df.hint("merge")


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Rows spread by key over tasks of about ``rows`` each; the files are asked for their number of rows."""
    return df.repartition(max(1, math.ceil(df.count() / rows)), key)


def cut_round(df: DataFrame) -> DataFrame:
    """``cut`` for the state of a loop: also forgets the size that the plan expects.

    That size is a product over all joins so far.  Kept from round to round its digits grow exponentially, and planning with
    them.
    """
    kept, spark = cut(df), df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(kept._jdf.toJavaRDD(), kept._jdf.schema()), spark)


def join_nulls(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; the key columns come from ``left``."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def with_key(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Give an ungrouped request a constant key, so that the grouped code path serves both."""
    if by:
        return df, list(by)
    return df.withColumn("_all", F.lit(0)), ["_all"]


def tiles(df: DataFrame, keys: Sequence[str], idx: str, halo: int = 1, tile: int = TILE) -> DataFrame:
    """Cut rows numbered 0, 1, 2, ... within ``keys`` into tiles, with ``halo`` border rows of the next tiles.

    Windows over ``keys`` and ``_tile`` then see every neighbour of a tile's own rows (``_own``), and a long
    curve spreads over tasks instead of being sorted in one.
    """
    home = F.floor(F.col(idx) / tile).cast("long")
    pos = F.col(idx) % tile
    copies = F.array_compact(
        F.array(home, F.when((pos < halo) & (home > 0), home - 1), F.when(pos >= tile - halo, home + 1))
    )
    return df.withColumn("_tile", F.explode(copies)).withColumn("_own", home == F.col("_tile"))


def per_tile(keys: Sequence[str], idx: str):
    return W.partitionBy(*keys, "_tile").orderBy(idx)


def beside(keys: Sequence[str], idx: str, cols: Sequence[str]) -> list[Column]:
    """``{c}_prev`` and ``{c}_next`` inside a tile."""
    w = per_tile(keys, idx)
    return [f(c).over(w).alias(f"{c}_{n}") for c in cols for f, n in ((F.lag, "prev"), (F.lead, "next"))]


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_own")


def neighbours(
    df: DataFrame, keys: Sequence[str], idx: str, cols: Sequence[str], tile: int = TILE
) -> DataFrame:
    """Add ``{c}_prev`` and ``{c}_next``; ``_tile`` stays, so that later per-tile steps need no new shuffle."""
    return own_rows(tiles(df, keys, idx, 1, tile).select("*", *beside(keys, idx, cols)))


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    value: Column | str,
    name: str,
    tile: int = TILE,
    levels: int = 1,
) -> DataFrame:
    """Inclusive running sum over densely numbered rows, added tile by tile.

    Rows that already carry ``_tile`` keep it, and with it their partitioning.  Tile totals are summed first (they are far fewer rows) and joined back as offsets,
    ``levels`` times over, so no task ever sorts a whole key.
    """
    value = F.col(value) if isinstance(value, str) else value
    if levels == 0:
        w = W.partitionBy(*keys).orderBy(idx).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(value).over(w))
    if "_tile" not in df.columns:
        df = df.withColumn("_tile", F.floor(F.col(idx) / tile).cast("long"))
    tiled = df.withColumn("_step", value)
    totals = tiled.groupBy(*keys, "_tile").agg(F.sum("_step").alias("_total"))
    upto = running_sum(
        totals.withColumnRenamed("_tile", "_t"), keys, "_t", "_total", "_upto", tile, levels - 1
    )
    offsets = upto.select(
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        F.col("_t").alias("_o_tile"),
        (F.col("_upto") - F.col("_total")).alias("_before"),
    )
    w = W.partitionBy(*keys, "_tile").orderBy(idx).rowsBetween(W.unboundedPreceding, 0)
    within = tiled.withColumn("_within", F.sum("_step").over(w))
    on = [F.col(k) == F.col(f"_o_{k}") for k in keys] + [F.col("_tile") == F.col("_o_tile")]
    return (
        within.join(offsets, on, "left")
        .withColumn(name, F.col("_within") + F.coalesce("_before", F.lit(0)))
        .drop("_tile", "_step", "_within", "_before", "_o_tile", *[f"_o_{k}" for k in keys])
    )


def ordered_means(df: DataFrame, keys: Sequence[str], idx: str, cols: Sequence[str], tile: int = TILE) -> DataFrame:
    """Mean of each of ``cols`` per key, added up in the order of ``idx``, so that it is the same to the last bit however rows lie.

    Rows are added tile by tile, then the totals of the tiles; no task ever sorts a whole key.  Nulls do not count.
    """

    def added(rows: DataFrame, by: list[str], order: str) -> DataFrame:
        w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        upto = F.struct(*[F.sum(c).over(w).alias(c) for c in rows.columns if c not in (*by, order)])
        return rows.select(*by, order, upto.alias("_upto")).groupBy(*by).agg(F.max_by("_upto", order).alias("_upto")).select(*by, "_upto.*")

    tiled = df.select(
        *keys, F.floor(F.col(idx) / tile).cast("long").alias("_tile"), F.col(idx).alias("_idx"),
        *[F.col(c).cast("double").alias(f"_s_{c}") for c in cols], *[F.col(c).isNotNull().cast("long").alias(f"_n_{c}") for c in cols],
    )
    totals = added(added(tiled, [*keys, "_tile"], "_idx"), list(keys), "_tile")
    return totals.select(*keys, *[(F.col(f"_s_{c}") / F.nullif(F.col(f"_n_{c}"), F.lit(0))).alias(c) for c in cols])


def positions(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "pos"
) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... in ``order`` without a per-group window.

    Rows are range-partitioned by group and order, so a large group spans partitions.
    The sorted rows are checkpointed once; partition sizes and group starts are then
    small aggregates, and the position is plain arithmetic.
    """
    added = [] if by else ["_all"]
    df, by = with_key(df, by)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [F.col(b) for b in by] + order
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = cut(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_mid", 33)).withColumn(
        "_row", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per shuffle partition, so this window and the broadcast are bounded by the partition count
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    numbered = placed.join(F.broadcast(offsets), "_part").withColumn("_abs", F.col("_off") + F.col("_row"))
    # partial minima per partition keep a large group out of any one task
    starts = numbered.groupBy(*by).agg(F.min("_abs").alias("_start"))
    out = join_nulls(numbered, starts, by).withColumn(name, (F.col("_abs") - F.col("_start")).cast("long"))
    return out.drop("_mid", "_part", "_row", "_off", "_abs", "_start", *added)


# groups whose sketches may be broadcast: a few numbers per metric and rank each
FEW_GROUPS = 10_000


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    cols: Sequence[str],
    probs: Sequence[float],
    small: int = 10_000,
    slack: float = 1e-3,
) -> DataFrame:
    """Exact linear-interpolation quantiles per group, one row per ``by`` x ``metric`` x ``p``.

    One scan gives each group's size and a mergeable sketch, whose proven bound brackets every wanted rank.  Groups of up to
    ``small`` rows then take the built-in exact percentile, which holds the values of a group.  For larger ones a second
    scan counts what lies below each bracket and keeps only the values inside, a few thousandths of all; they are cut into
    bins, and just the bins that hold the rank are put in order.  Values that are null or not a number do not count.
    """
    given = list(by)
    df, by = with_key(df, by)
    value = {c: f"_v{i}" for i, c in enumerate(cols)}

    def number(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.when(~F.isnan(v), v)

    base = cut(df.select(*by, *[number(c).alias(v) for c, v in value.items()]))
    # a sketched rank is off by at most 1 / accuracy of the group, half of what the bracket allows
    accuracy, k = math.ceil(2.0 / slack), len(probs)
    ends = [max(0.0, p - slack) for p in probs] + [min(1.0, p + slack) for p in probs]
    stats = []
    for v in value.values():
        stats += [F.count(v).alias(f"{v}_n"), F.min(v).alias(f"{v}_lo"), F.max(v).alias(f"{v}_hi"), F.percentile_approx(v, ends, accuracy).alias(f"{v}_q")]
    size = F.array_max(F.array(*[F.col(f"{v}_n") for v in value.values()]))
    sketch = cut(base.groupBy(*by).agg(*stats).withColumn("_size", size))
    groups, most, least = sketch.agg(F.count("*"), F.max("_size"), F.min("_size")).first()
    if not groups:
        return _no_quantiles(base, given)

    def beside(groups_: DataFrame, how: str) -> DataFrame:
        return join_nulls(base, F.broadcast(groups_) if groups <= FEW_GROUPS else groups_, by, how)

    parts = []
    if least <= small:
        some = base if most <= small else beside(sketch.filter(F.col("_size") <= small).select(*by), "left_semi")
        exact = some.groupBy(*by).agg(*[F.percentile(v, list(probs)).alias(v) for v in value.values()])
        each = [
            F.struct(F.lit(c).alias("metric"), F.lit(float(p)).alias("p"), F.get(F.col(v), F.lit(j)).alias("q"))
            for c, v in value.items() for j, p in enumerate(probs)
        ]
        rows = exact.select(*by, F.explode(F.array(*each)).alias("_q")).select(*given, "_q.*")
        parts.append(rows.filter("q IS NOT NULL"))
    if most > small:
        parts.append(_bracketed(beside, sketch.filter(F.col("_size") > small), by, given, value, probs))
    return reduce(DataFrame.unionByName, parts)


def _no_quantiles(base: DataFrame, given: Sequence[str]) -> DataFrame:
    nothing = [F.lit("").alias("metric"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q")]
    return base.limit(0).select(*given, *nothing)


def _bracketed(beside, large: DataFrame, by: list[str], given: list[str], value: dict[str, str], probs: Sequence[float]) -> DataFrame:
    """Quantiles of large groups from the values inside the brackets of their sketches."""
    key, k = [*by, "metric", "p"], len(probs)
    brackets = [
        (c, v, j, p, f"_f{i}_{j}", f"_t{i}_{j}") for i, (c, v) in enumerate(value.items()) for j, p in enumerate(probs)
    ]
    edges = [e for _, v, j, _, low, high in brackets for e in (F.col(f"{v}_q")[j].alias(low), F.col(f"{v}_q")[k + j].alias(high))]
    met = beside(large.select(*by, *edges), "inner")
    below = met.groupBy(*by).agg(*[F.count(F.when(F.col(v) < F.col(low), 1)).alias(f"{low}_b") for _, v, _, _, low, _ in brackets])
    inside = met.select(
        *by,
        F.explode(
            F.array_compact(
                F.array(
                    *[
                        F.when(
                            F.col(v).between(F.col(low), F.col(high)),
                            F.struct(F.lit(c).alias("metric"), F.lit(float(p)).alias("p"), F.col(v).alias("v"), F.col(low).alias("_from"), F.col(high).alias("_to")),
                        )
                        for c, v, _, p, low, high in brackets
                    ]
                )
            )
        ).alias("_i"),
    ).select(*by, "_i.*")
    width = F.col("_to") - F.col("_from")
    bin_ = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("_from")) / width * BINS), F.lit(BINS - 1))).otherwise(F.lit(0))
    counted = cut(inside.groupBy(*key, bin_.cast("int").alias("_bin"), "v").agg(F.count("*").alias("_c")))
    # at most BINS + 1 rows per group and rank: how many values come before each bin, those below the bracket first
    first = join_nulls(large.select(*by, *[f"{v}_n" for v in value.values()]), below, by).select(
        *by,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("metric"), F.lit(float(p)).alias("p"), ((F.col(f"{v}_n") - 1) * F.lit(float(p))).alias("_h"),
                        F.col(f"{low}_b").alias("_in"),
                    )
                    for c, v, _, p, low, _ in brackets
                ]
            )
        ).alias("_s"),
    ).select(*by, "_s.*")
    bins = join_nulls(counted.groupBy(*key, "_bin").agg(F.sum("_c").alias("_in")), first.withColumnRenamed("_in", "_below"), key)
    upto = F.sum("_in").over(W.partitionBy(*key).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)) + F.col("_below")
    reached = bins.withColumn("_upto", upto).filter((F.col("_upto") > F.floor("_h")) & (F.col("_upto") - F.col("_in") <= F.ceil("_h")))
    reached = reached.select(*key, "_bin", "_h", (F.col("_upto") - F.col("_in")).alias("_before"))
    # only the bins that hold the two wanted ranks are put in order
    w = W.partitionBy(*key, "_bin").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    ranked = join_nulls(counted, reached, [*key, "_bin"]).withColumn("_cum", F.col("_before") + F.sum("_c").over(w))
    picked = ranked.groupBy(*key, "_h").agg(
        F.min(F.when(F.col("_cum") > F.floor("_h"), F.col("v"))).alias("_a"),
        F.min(F.when(F.col("_cum") > F.ceil("_h"), F.col("v"))).alias("_z"),
    )
    q = F.col("_a") + (F.col("_h") - F.floor("_h")) * (F.col("_z") - F.col("_a"))
    return picked.select(*given, "metric", "p", q.alias("q"))


def quantile_columns(
    df: DataFrame, by: Sequence[str], cols: Sequence[str], named: dict[str, float]
) -> DataFrame:
    """``quantiles`` spread into columns ``{col}_{name}``, one row per group."""
    tall = quantiles(df, by, cols, sorted(set(named.values())))
    aggs = [
        F.max(F.when((F.col("metric") == c) & (F.col("p") == F.lit(float(p))), F.col("q"))).alias(f"{c}_{n}")
        for c in cols
        for n, p in named.items()
    ]
    return tall.groupBy(*by).agg(*aggs)
