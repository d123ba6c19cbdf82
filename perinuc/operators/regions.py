"""Numbering of the 8-connected regions of a set of pixels, tile by tile."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perinuc.operators.components import components
from perinuc.operators.raster import starts
from perinuc.scale import apart, cut, positions

# side of the square tiles: a tile holds at most its square of pixels, whatever an image holds
SIDE = 256


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component: larger roots hang under smaller ones, then chains are flattened."""
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            return parent
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def tile_runs(rows: pa.Table, keys: Sequence[str], side: int) -> pa.Table:
    """Runs along a row for whole tiles, sorted by tile, row and column: keys, y, x0, x1 and the first pixel of their region.

    All tiles are handled at once: a tile's number, row and column make one number, in which runs of the row below that
    touch a run, also by a corner, form a stretch.
    """
    tile = np.cumsum(starts(rows, keys)) - 1
    y, x = rows.column("y").to_numpy(), rows.column("x").to_numpy()
    # one row and two columns of a tile's grid stay empty, so neighbouring tiles and rows never meet here
    place = (tile * (side + 1) + np.mod(y, side)) * (side + 2) + np.mod(x, side) + 1
    once = np.r_[True, place[1:] != place[:-1]]
    at = np.flatnonzero(once)
    place = place[at]
    opens = np.r_[True, np.diff(place) != 1]
    first, last = place[opens], place[np.r_[opens[1:], True]]
    low = np.searchsorted(last, first + side + 1, side="left")
    high = np.searchsorted(first, last + side + 3, side="right")
    touch = np.maximum(high - low, 0)
    u = np.repeat(np.arange(len(first)), touch)
    v = np.arange(touch.sum()) - np.repeat(np.cumsum(touch) - touch, touch) + np.repeat(low, touch)
    head = at[opens]
    root = head[roots(len(first), u, v)]
    out = rows.select(list(keys)).take(pa.array(head))
    for name, values in (("y", y[head]), ("x0", x[head]), ("x1", x[head] + last - first), ("node", (y[root] << 32) + x[root])):
        out = out.append_column(name, pa.array(values, pa.int64()))
    return out


def _runs(pixels: DataFrame, by: Sequence[str], side: int) -> DataFrame:
    """Runs of every tile; a task streams its tiles in order and holds one of them and a batch at a time."""
    keys = [*by, "_ty", "_tx"]
    place = [F.col(c).cast("long").alias(c) for c in ("y", "x")]
    tiled = pixels.filter("y IS NOT NULL AND x IS NOT NULL").select(*by, *place)
    tiled = tiled.withColumn("_ty", F.floor(F.col("y") / side)).withColumn("_tx", F.floor(F.col("x") / side))
    dealt = tiled.repartition(*keys).sortWithinPartitions(*keys, "y", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            open_ = int(np.flatnonzero(starts(table, keys))[-1])
            if open_:
                yield from tile_runs(table.slice(0, open_), keys, side).to_batches()
            held = table.slice(open_)
        if held is not None and held.num_rows:
            yield from tile_runs(held, keys, side).to_batches()

    kinds = dict(dealt.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "y long", "x0 long", "x1 long", "node long"])
    return dealt.mapInArrow(run, schema)


def _border_links(runs: DataFrame, by: Sequence[str], side: int) -> DataFrame:
    """Regions of two tiles that touch across a border, also by a corner; only pixels at a border are looked at."""

    def at_border(condition, x) -> DataFrame:
        return runs.filter(condition).select(*by, "node", "y", x.alias("x"))

    in_row = F.explode(F.sequence("x0", "x1"))
    bottom = at_border(F.pmod("y", F.lit(side)) == side - 1, in_row)
    top = at_border(F.pmod("y", F.lit(side)) == 0, in_row)
    right = at_border(F.pmod("x1", F.lit(side)) == side - 1, F.col("x1"))
    left = at_border(F.pmod("x0", F.lit(side)) == 0, F.col("x0"))

    def met(near: DataFrame, far: DataFrame, steps: Sequence[tuple[int, int]]) -> DataFrame:
        moved = near.select(
            *by, F.col("node").alias("u"),
            F.explode(F.array(*[F.struct((F.col("y") + a).alias("y"), (F.col("x") + b).alias("x")) for a, b in steps])).alias("_to"),
        ).select(*by, "u", "_to.*")
        return moved.join(far.withColumnRenamed("node", "v"), [*by, "y", "x"]).select(*by, "u", "v")

    below = met(bottom, top, [(1, -1), (1, 0), (1, 1)])
    beside = met(right, left, [(-1, 1), (0, 1), (1, 1)])
    return below.unionByName(beside).distinct()


def label_regions(pixels: DataFrame, by: Sequence[str], side: int = SIDE) -> DataFrame:
    """Number the 8-connected regions of a set of pixels, in reading order of their first pixel.

    Pixels meet once, in tiles, whose regions are found there; a region is named by its first pixel.  Regions that touch
    across tile borders are joined by a component search over them alone.  Pixels that repeat count once, those without a
    place are no pixels.  Images are told apart by ``by``; rows with a null there belong to no image and are left out.
    """
    by = list(by)
    named = [F.col(b).alias(f"_by{i}") for i, b in enumerate(by)]
    keys = [f"_by{i}" for i in range(len(by))]
    known = pixels.dropna(subset=by) if by else pixels
    runs = apart(cut(_runs(known.select(*named, "y", "x"), keys, side).drop("_ty", "_tx")))
    links = _border_links(runs, keys, side)
    nodes = runs.select(*keys, "node").distinct()
    linked = cut(links)
    if linked.isEmpty():
        found = nodes.withColumn("component", F.col("node"))
    else:
        found = components(nodes, linked, keys)
    found = apart(cut(found))
    heads = found.filter("node = component").select(*keys, "component")
    labels = positions(heads, keys, ["component"], "_rank").select(*keys, "component", (F.col("_rank") + 1).alias("ne_label"))
    of_node = found.join(labels, [*keys, "component"]).select(*keys, "node", "ne_label")
    back = [F.col(k).alias(b) for k, b in zip(keys, by)]
    return runs.join(of_node, [*keys, "node"]).select(*back, "y", F.explode(F.sequence("x0", "x1")).alias("x"), "ne_label")
