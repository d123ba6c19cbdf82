"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into buckets, which are cut into blocks of bounded size.  A first pass compares each
query with one block, which gives a floor under its k-th best score.  For a block whose longest vector has length l, a
vector can only beat the floor if its cosine with the query reaches ``floor / (|query| * l)``: above one the block is
passed over; where the threshold is high, candidates come from the ranges that it leaves for the query's largest
coordinates; where it is low, from the vectors that are long enough.  Products of candidates are verified in whole
numbers.  Bounds are loosened by a hair before they prune, so nothing is lost to rounding.

Vectors that are null, or hold null or non-finite components, take no part, nor do rows without an id.  Vectors of
different dimension are never compared.  Components and scores beyond 64 bits are held at the ends of that range, so such
scores tie.  A row is never its own candidate; rows that repeat an id are separate rows.
Ties go to the smaller id.  With fewer than k candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perinuc.llm.common import own
from perinuc.scale import cut

K = 5
# vectors of a block, queries compared with it at once, buckets by length, and blocks that a task gets
BLOCK, QUERIES, BUCKETS, STRIPE = 4096, 1024, 64, 2
# local cosine from which the ranges of this many coordinates choose the candidates
COSINE, FOCUS = 0.35, 6
HAIR = 1e-9
# scores and components stay within 64 bits
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~bad


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _pack(rows: pa.Table) -> pa.Table:
    """The rows of one block as one row: ids and vectors, longest first."""
    dim = rows.column("dim")[0].as_py()
    norm, row = rows.column("norm2").to_numpy(), rows.column("row").to_numpy()
    order = np.lexsort((row, -norm))
    matrix = _matrix(rows.column("vec"), dim)[order]
    return pa.table(
        {
            "dim": pa.array([dim], pa.int32()),
            "block": rows.column("block")[:1],
            "longest": pa.array([float(norm.max(initial=0.0))], pa.float64()),
            "ids": pa.array([rows.column("vec_id").to_numpy()[order].tobytes()], pa.binary()),
            "rows": pa.array([row[order].tobytes()], pa.binary()),
            "matrix": pa.array([matrix.tobytes()], pa.binary()),
        }
    )


PACKED = "dim int, block string, longest double, ids binary, rows binary, matrix binary"


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to smaller ids."""
    if len(score) > 8 * k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= floor)
    else:
        near = np.arange(len(score))
    # turned over by its bits: the smallest whole number has no opposite
    return near[np.lexsort((ids[near], ~score[near]))[:k]]


class Block:
    """Vectors of one block, prepared for pruning."""

    def __init__(self, dim: int, ids: bytes, rows: bytes, matrix: bytes):
        self.ids, self.rows = np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64)
        self.matrix = np.frombuffer(matrix, np.int64).reshape(len(self.ids), dim)
        # products of float64 are exact below 2**53; larger vectors are multiplied as integers
        self.float = self.matrix.astype(np.float64)
        self.norm = np.sqrt((self.float**2).sum(axis=1))
        self.unit = self.float / np.maximum(self.norm, 1e-300)[:, None]

    def products(self, vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Integer products of some of the vectors with some queries."""
        # as floats, for the smallest whole number of 64 bits has no opposite
        most = max(1, vectors.shape[1])
        for side in (vectors, queries):
            most *= float(np.abs(side.astype(np.float64)).max(initial=0))
        if most < 2.0**52:
            return (vectors.astype(np.float64) @ queries.astype(np.float64).T).astype(np.int64)
        whole = [[sum(int(a) * int(b) for a, b in zip(v, q)) for q in queries] for v in vectors]
        held = [[min(max(s, LEAST), MOST) for s in row] for row in whole]
        return np.array(held, np.int64).reshape(len(vectors), len(queries))

    def search(self, queries: np.ndarray, rows: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its k best of this block among those that reach its floor: query, ids, scores."""
        if not len(self.ids):
            return
        size = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        reach = size * self.norm[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(np.isneginf(floors), -1.0, np.where(reach > 0, floors / reach, np.where(floors > 0, 2.0, -1.0)))
        cosine -= HAIR
        by_coordinate = (cosine >= COSINE) & (cosine <= 1.0)
        for q in np.flatnonzero(by_coordinate).tolist():
            direction = queries[q] / size[q]
            focus = np.argsort(-np.abs(direction))[:FOCUS]
            near = None
            for f in focus.tolist():
                low, high = _range(direction[f], cosine[q])
                column = self.unit[:, f] if near is None else self.unit[near, f]
                inside = (column >= low) & (column <= high)
                near = np.flatnonzero(inside) if near is None else near[inside]
                if not len(near):
                    break
            if len(near):
                yield from self._verified(q, near, self.products(self.matrix[near], queries[q : q + 1])[:, 0], rows, floors, k)
        by_length = np.flatnonzero(cosine < COSINE)
        for at in range(0, len(by_length), 256):
            some = by_length[at : at + 256]
            # the vectors are sorted by length, so those that are long enough come first
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(floors[some] > 0, floors[some] / np.maximum(size[some], 1e-300), 0.0) * (1 - HAIR)
            long_enough = np.searchsorted(-self.norm, -need, side="right")
            product = self.products(self.matrix[: long_enough.max(initial=0)], queries[some])
            for j, q in enumerate(some.tolist()):
                near = np.arange(long_enough[j])
                yield from self._verified(q, near, product[: long_enough[j], j], rows, floors, k)

    def _verified(self, q: int, near: np.ndarray, score: np.ndarray, rows: np.ndarray, floors: np.ndarray, k: int):
        keep = (score >= floors[q]) & (self.rows[near] != rows[q])
        near, score = near[keep], score[keep]
        if len(near):
            best = _best(score, self.ids[near], k)
            yield q, self.ids[near[best]], score[best]


def _range(d: float, cosine: float) -> tuple[float, float]:
    """Coordinates that a unit vector can have if its cosine with a query of coordinate ``d`` is at least ``cosine``.

    Angles keep the triangle inequality, so the vector's angle to the axis differs from the query's by at most
    ``arccos(cosine)``.
    """
    axis, turn = math.acos(max(-1.0, min(1.0, d))), math.acos(max(-1.0, min(1.0, cosine)))
    return math.cos(min(math.pi, axis + turn)) - HAIR, math.cos(max(0.0, axis - turn)) + HAIR


def _blocks(vectors: DataFrame, rows: int, block: int) -> DataFrame:
    """Vectors packed into blocks of about ``block`` rows of like length, within each dimension."""
    edges = []
    if rows > block:
        edges = sorted(set(vectors.approxQuantile("norm2", [k / BUCKETS for k in range(1, BUCKETS)], 0.5 / BUCKETS)))
    bucket = sum((F.when(F.col("norm2") > e, 1).otherwise(0) for e in edges), F.lit(0))
    dealt = vectors.withColumn("bucket", bucket)
    # at most BUCKETS rows: how many blocks a bucket needs, whatever share of all vectors has its length
    per = dealt.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).collect()
    parts = {r.bucket: r.parts for r in per}
    of_bucket = F.element_at(F.array(*[F.lit(parts.get(b, 1)) for b in range(len(edges) + 1)]), F.col("bucket") + 1)
    placed = dealt.withColumn("block", F.concat_ws("/", "dim", "bucket", F.pmod(F.xxhash64("row"), of_bucket)))
    packed = placed.select("dim", "block", "norm2", "vec_id", "row", "vec")
    return cut(packed.groupBy("dim", "block").applyInArrow(_pack, PACKED))


FOUND = "query_row long, query_id long, vec_id long, score long"


def _compare(pairs: DataFrame, k: int) -> DataFrame:
    """Rows of a query block next to a vector block: the best of each pair that reach the floors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_block, held = None, None
        for batch in batches:
            for r in (x for at in range(batch.num_rows) for x in batch.slice(at, 1).to_pylist()):
                if held_block != r["block"]:
                    held_block, held = r["block"], Block(r["dim"], r["ids"], r["rows"], r["matrix"])
                q_ids, q_rows = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_rows"], np.int64)
                queries = np.frombuffer(r["q_matrix"], np.int64).reshape(len(q_ids), r["dim"])
                floors = np.frombuffer(r["q_floors"], np.float64)
                out = [(q_rows[q], q_ids[q], i, s) for q, ids, score in held.search(queries, q_rows, floors, k) for i, s in zip(ids, score)]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(c, np.int64)) for c in zip(*out)], ["query_row", "query_id", "vec_id", "score"]
                    )

    return pairs.mapInArrow(run, FOUND)


def _pack_queries(rows: pa.Table) -> pa.Table:
    dim = rows.column("dim")[0].as_py()
    return pa.table(
        {
            "dim": pa.array([dim], pa.int32()),
            "q_block": rows.column("q_block")[:1],
            "q_ids": pa.array([rows.column("vec_id").to_numpy().tobytes()], pa.binary()),
            "q_rows": pa.array([rows.column("row").to_numpy().tobytes()], pa.binary()),
            "q_floors": pa.array([rows.column("floor").to_numpy().tobytes()], pa.binary()),
            "q_matrix": pa.array([_matrix(rows.column("vec"), dim).tobytes()], pa.binary()),
        }
    )


Q_PACKED = "dim int, q_block long, q_ids binary, q_rows binary, q_floors binary, q_matrix binary"


def _packed_queries(queries: DataFrame, parts: int) -> DataFrame:
    return (
        queries.withColumn("q_block", F.pmod(F.xxhash64("row"), F.lit(parts)))
        .groupBy("dim", "q_block")
        .applyInArrow(_pack_queries, Q_PACKED)
    )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def top_k(
    table: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 50, scale: int = 256,
    block: int = BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best for every row whose id is divisible by ``every``."""
    vector = own(table, embedding)
    vectors = cut(
        table.filter(usable(vector) & own(table, vec_id).isNotNull()).select(
            own(table, vec_id).cast("long").alias("vec_id"),
            quantised(vector, scale).alias("vec"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    vectors = vectors.withColumn("dim", F.size("vec")).withColumn(
        "norm2", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    )
    blocks = _blocks(vectors, vectors.count(), block)
    queries = vectors.filter(F.col("vec_id") % every == 0)
    parts = max(1, math.ceil(queries.count() / QUERIES))
    packed = _packed_queries(queries.withColumn("floor", F.lit(float("-inf"))), parts)
    # first pass: the block with the longest vectors of each dimension gives every query a floor
    longest = blocks.groupBy("dim").agg(F.max_by("block", "longest").alias("block"))
    seeds = blocks.join(longest.select("block"), "block", "left_semi").withColumn(
        "q_block", F.explode(F.expr(f"sequence(0L, {parts - 1}L)"))
    )
    ranked = _ranked(_compare(packed.join(seeds, ["dim", "q_block"]), k), k)
    floor = ranked.groupBy("query_row").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    known = queries.join(floor, F.col("row") == F.col("query_row"), "left").withColumn(
        "floor", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf")))
    )
    packed = cut(_packed_queries(known.select("dim", "vec_id", "row", "vec", "floor"), parts))
    # second pass: the stated queries meet all blocks, dealt to stripes of a few blocks each
    stripes = max(1, math.ceil(blocks.count() / STRIPE))
    dealt = blocks.withColumn("stripe", F.pmod(F.xxhash64("block"), F.lit(stripes)))
    asked = packed.withColumn("stripe", F.explode(F.expr(f"sequence(0L, {stripes - 1}L)")))
    best = _ranked(_compare(dealt.join(asked, ["dim", "stripe"]), k), k)
    return best.select("query_id", "rank", "vec_id", "score")
