"""Small helpers shared by the text operators."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perinuc.scale import cut

# the white space of all contracts here: space and U+0009 to U+000D
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def spare(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have in any spelling."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def own(df: DataFrame, name: str) -> Column:
    """Column ``name`` of ``df`` even where the name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept away from training; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def joined_with_hot(rows: DataFrame, lookup: DataFrame, key: str, size: str, total: int, most: int = 4096) -> DataFrame:
    """Left join of ``rows`` with one ``lookup`` row per key; ``size`` counts the rows of a key among ``total``.

    Keys above ``total / most`` rows are fewer than ``most``, so their lookup rows are broadcast; their rows get a
    spread key that matches nothing in the ordinary join of all others.
    """
    hot = F.col(size) * most > total
    extra = [c for c in lookup.columns if c != key]
    loud = lookup.filter(hot).select(F.col(key).alias("_hot_key"), *[F.col(c).alias(f"_hot_{c}") for c in extra])
    rest = lookup.filter(~hot).select(
        F.col(key).alias("_cold_key"), F.lit(-1).alias("_cold_salt"), *[F.col(c).alias(f"_cold_{c}") for c in extra]
    )
    near = rows.join(F.broadcast(loud), F.col(key) == F.col("_hot_key"), "left")
    salt = F.when(F.col("_hot_key").isNull(), F.lit(-1)).otherwise(
        F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)).cast("int")
    )
    both = near.withColumn("_salt", salt).join(
        rest, (F.col(key) == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")), "left"
    )
    return both.select(
        *rows.columns,
        *[F.when(F.col("_hot_key").isNotNull(), F.col(f"_hot_{c}")).otherwise(F.col(f"_cold_{c}")).alias(c) for c in extra],
    )


def piece(text: Column, chars: int, turn: Column) -> Column:
    """At most ``chars`` characters of ``text``; of a longer one, a stretch at a place given by the hash ``turn``."""
    spare_ = F.greatest(F.length(text) - chars, F.lit(0))
    return F.substring(text, (F.pmod(turn, spare_ + 1) + 1).cast("int"), F.lit(chars))


def thinned(turn: Column, wanted: int, among: Column) -> Column:
    """Rows to draw ``wanted`` from: with four times as many or fewer all of ``among``, else about that many.

    ``turn`` is a hash, so a share of its values is a share of the rows; no task then gets more than it can rank.
    """
    steps = 1 << 30
    return F.pmod(turn, F.lit(steps)) / F.lit(float(steps)) * among < F.lit(4.0 * wanted)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once and numbered 0, 1, 2, ... in the order of their partitions."""
    placed = cut(rows.withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row per partition, so this window and the broadcast are bounded by the partition count
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    dense = F.col("_off") + F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), part == F.col("_part")).withColumn(name, dense).drop("_part", "_off")


def in_a_task(spark: SparkSession, work: Callable[[], Any]) -> Any:
    """Result of small numpy work, run in a task: numpy keeps to one thread there, and the driver stays free."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(work())], pa.binary())], ["result"])

    return pickle.loads(spark.range(0, 1, 1, 1).mapInArrow(run, "result binary").first().result)
