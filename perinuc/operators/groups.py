"""User functions on every field of view."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from perinuc.scale import apart, cut


def apply_per_fov(
    df: DataFrame,
    fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    schema: StructType,
    by: str = "fov_id",
) -> DataFrame:
    """Run ``fn`` on the batches of each field; a field that raises gives one row with the message.

    The function gets an iterator of batches, so a field of any size passes through one batch at a time.
    Rows it had yielded before the error stay, next to the error row.
    """
    names = [f.name for f in schema.fields]
    out = StructType([*[StructField(f.name, f.dataType, True) for f in schema.fields], StructField("error", StringType(), True)])

    # the annotations choose the batch-iterator form of the grouped call
    def guarded(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            for result in fn(batches):
                yield result.assign(error=None)
        except Exception as e:  # the other fields go on
            row = {n: [None] for n in names}
            if by in row:
                row[by] = [key[0]]
            yield pd.DataFrame({**row, "error": [f"{type(e).__name__}: {e}"]})

    return df.groupBy(by).applyInPandas(guarded, out)


def apply_per_tile(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: StructType,
    by: str = "fov_id",
    place: Sequence[str] = ("y", "x"),
    side: int = 256,
    border: int = 0,
) -> DataFrame:
    """Run ``fn`` on the square tiles of each field, with the rows of a border of stated width around each.

    ``fn`` gets a tile's rows with a flag ``own``, false for those of the border, so that it can look at neighbours and
    answer for its own rows only.  A field of any size spreads over tasks.  If one tile raises, no rows of its field come
    out, only one row with the message of the first such tile, in reading order.  Rows without a place are in no tile.
    """
    tile = [f"_t{i}" for i in range(len(place))]
    dealt = df.dropna(subset=list(place)).withColumn("own", F.lit(True))
    for t, c in zip(tile, place):
        spread = F.sequence(F.floor((F.col(c) - border) / side), F.floor((F.col(c) + border) / side))
        dealt = dealt.withColumn(t, F.explode(spread)).withColumn("own", F.col("own") & (F.floor(F.col(c) / side) == F.col(t)))
    names = [f.name for f in schema.fields]
    # a tile that holds nothing but the border of others has no answer to give
    out = StructType(
        [
            StructField("_field", df.schema[by].dataType), *[StructField(t, dealt.schema[t].dataType) for t in tile],
            *[StructField(f.name, f.dataType, True) for f in schema.fields], StructField("error", StringType(), True),
        ]
    )

    empty = pd.DataFrame({f.name: [] for f in out.fields}, dtype=object)

    def guarded(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if not rows["own"].to_numpy().any():
            return empty
        try:
            columns = {n: values.tolist() for n, values in fn(rows.drop(columns=tile))[names].items()}
            error = None
        except Exception as e:  # the other fields go on
            columns, error = {n: [None] for n in names}, f"{type(e).__name__}: {e}"
        size = len(next(iter(columns.values()), []))
        place_ = {name: [value] * size for name, value in zip(["_field", *tile], key)}
        return pd.DataFrame({**place_, **columns, "error": [error] * size}, dtype=object)

    found = cut(dealt.groupBy(by, *tile).applyInPandas(guarded, out))
    failed = found.filter("error IS NOT NULL").groupBy("_field").agg(F.min_by("error", F.struct(*tile)).alias("error"))
    failed = apart(cut(failed))
    fine = found.join(failed.select("_field"), "_field", "left_anti").select(*names, "error")
    nothing = [F.col("_field").alias(n) if n == by else F.lit(None).cast(schema[n].dataType).alias(n) for n in names]
    return fine.unionByName(failed.select(*nothing, "error"))
