"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary per partition finds digests that many rows share.  The summaries are added up in a shuffle of a
few thousand counters; the candidates are then counted exactly, and the verified ones, fewer than ``counters``, are
broadcast, so that rows of a large group of copies are settled where they are read.  All other digests have at most
``rows / counters`` copies and take an ordinary shuffle.

Null texts count as empty, and all empty texts are copies of each other.  The smallest id wins, null ids come last, and
of rows that repeat the winner's id one stays.  An empty table gives an empty result.  Only the id and text columns are
read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perinuc.llm.common import WHITE, own, spare
from perinuc.scale import cut

# counters of a Misra-Gries summary, and the bound on broadcast digests
COUNTERS = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def misra_gries(batches: Iterable[pa.RecordBatch], counters: int) -> dict[bytes, int]:
    """Counters of one stream: each count is at most ``n / (counters + 1)`` below the true one, never above it."""
    held: dict[bytes, int] = {}
    for batch in batches:
        found = pc.value_counts(batch.column(0))
        for digest, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist()):
            held[digest] = held.get(digest, 0) + n
        if len(held) > counters:
            least = sorted(held.values(), reverse=True)[counters]
            held = {digest: n - least for digest, n in held.items() if n > least}
    return held


def heavy_hitters(rows: DataFrame, total: int, counters: int = COUNTERS) -> DataFrame:
    """Candidates among ``rows.digest``: every digest of more than ``2 * total / (counters + 1)`` rows is one."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = misra_gries(batches, counters)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["digest", "n"]
        )

    parts = rows.select("digest").mapInArrow(summarise, "digest binary, n long")
    # all counters together hold at most `total`, so at most `counters` digests can pass
    return parts.groupBy("digest").agg(F.sum("n").alias("n")).filter(F.col("n") * (counters + 1) > total).select("digest")


def winners(rows: DataFrame, total: int, counters: int = COUNTERS) -> DataFrame:
    """Exact size and winner of each verified heavy digest."""
    heavy = F.broadcast(heavy_hitters(rows, total, counters))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")
    counted = rows.join(heavy, "digest", "left_semi").groupBy("digest").agg(first, F.count("*").alias("group_size"))
    return cut(counted.filter(F.col("group_size") * (counters + 1) > total))


def digest_rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Id, digest and a fixed number for each row, written once so that every later pass sees the same numbers."""
    return cut(
        docs.select(
            own(docs, doc_id).alias("id"),
            digest_of(own(docs, text)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        )
    )


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: id, the id that stays, size of its group, whether it stays, digest."""
    rows = digest_rows(docs, text, doc_id)
    heavy = winners(rows, rows.count(), counters)
    settled = rows.join(F.broadcast(heavy), "digest")
    group = W.partitionBy("digest")
    rest = (
        rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
        .withColumn("first", F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).over(group))
        .withColumn("group_size", F.count("*").over(group))
    )
    return settled.select(*rest.columns).union(rest).select(
        F.col("id").alias("doc_id"),
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = digest_rows(docs, text, doc_id)
    heavy = winners(rows, rows.count(), counters).select("digest", F.col("first.id").alias("keep_id"))
    digest, key, keep, place = (spare(docs, n) for n in ("digest", "heavy", "keep", "place"))
    near = docs.withColumn(digest, digest_of(own(docs, text))).join(
        F.broadcast(heavy.select(F.col("digest").alias(key), F.col("keep_id").alias(keep))), F.col(digest) == F.col(key), "left"
    )
    # copies of a heavy text go before the shuffle; its winner is ranked with the others, in case its id repeats
    left = near.filter(F.col(key).isNull() | own(docs, doc_id).eqNullSafe(F.col(keep)))
    order = W.partitionBy(digest).orderBy(own(docs, doc_id).asc_nulls_last())
    return left.withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).select(
        *[own(docs, c) for c in docs.columns]
    )
