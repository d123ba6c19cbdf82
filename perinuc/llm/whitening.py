"""Whitening of embeddings with distributed block matrices.

Components become whole numbers.  Each distinct vector counts once in the fit: centred, it is a row of a block matrix
whose product with its own transpose is the scatter.  That product is as small as the dimension squared, so its
eigenvectors are found in one small task; scaled to unit variance they are the whitening matrix, and a second product
projects all rows.  Blocks meet in groups of a few (the middle dimension is split), so no task holds more than those.

Rows whose vector is null, or holds null or non-finite entries, take no part.  Vectors of different dimension are fitted
apart, one after the other; an empty vector has no components and gives no row.  Rows that repeat an id or a vector stay
rows of their own, a null id stays null.  Entries beyond 2**61 are held there.  ``deviation`` is null where it passes 63
bits.  A component without variance has a null ``whitened`` and takes no part in the identity check; ``explained`` is
null where no component has variance, as with one vector or with equal ones.  An empty table gives an empty result.
Only the id and vector columns are read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perinuc.llm.common import in_a_task, numbered, own
from perinuc.llm.top_k import usable
from perinuc.scale import cut

COMPONENTS = 16
# rows and columns of a block, and blocks that meet in a task
ROWS, COLUMNS, TOGETHER = 4096, 1024, 8
# entries are held within these bounds, so that their differences are whole numbers of 64 bits
MOST = 1 << 61

RESULT = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(vector: Column, scale: int, shift: int) -> Column:
    def entry(x: Column) -> Column:
        return F.greatest(F.least(F.floor(x.cast("double") * scale).cast("long"), F.lit(MOST)), F.lit(-MOST)) + shift

    return F.transform(vector, entry)


def _of(numbers: list, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in numbers]).cast(f"array<{kind}>")


def product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """``left @ right`` with the middle dimension dealt to ``splits`` groups of blocks."""
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


class Centred:
    """Distance of a vector of whole numbers to the mean ``sums / n``, which is not rounded before it is taken off."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.dim = n, len(sums)
        parts = [divmod(s, n) for s in sums]
        self.floor, self.rest = [q for q, _ in parts], [r for _, r in parts]

    def _gap(self, x: Column) -> Column:
        return F.zip_with(x, _of(self.floor, "long"), lambda a, b: a - b)

    def entries(self, x: Column) -> Column:
        return F.zip_with(self._gap(x), _of([r / self.n for r in self.rest], "double"), lambda a, b: a.cast("double") - b)

    def deviation(self, x: Column) -> Column:
        """Sum over dimensions of ``(n * x - sum)**2``, exact; in 64 bits where that fits, else in decimals."""
        gap, n = self._gap(x), self.n
        # |n * gap - rest| is at most n * (|gap| + 1)
        safe = math.isqrt((1 << 62) // self.dim) // n - 1

        def add(total: Column, v: Column) -> Column:
            return total + v * v

        plain = F.aggregate(F.zip_with(gap, _of(self.rest, "long"), lambda a, r: a * n - r), F.lit(0).cast("long"), add)

        def far(a: Column, r: Column) -> Column:
            return F.try_subtract(F.try_multiply(a.cast("decimal(38,0)"), F.lit(n).cast("decimal(38,0)")), r).cast("decimal(38,0)")

        def add_far(total: Column, v: Column) -> Column:
            return F.try_add(total, F.try_multiply(v, v)).cast("decimal(38,0)")

        zero = F.lit(0).cast("decimal(38,0)")
        wide = F.aggregate(F.zip_with(gap, _of(self.rest, "decimal(38,0)"), far), zero, add_far).try_cast("long")
        within = F.forall(gap, lambda a: (a <= safe) & (a >= -safe)) if safe > 0 else F.lit(False)
        return F.when(within, plain).otherwise(wide)


def sums_of(vectors: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors, and the exact sum of each of their ``dim`` entries."""
    entry = vectors.select(F.posexplode("x").alias("at", "v"))
    found = entry.groupBy("at").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()
    sums = {r.at: int(r.s) for r in found}
    return found[0].n, [sums[i] for i in range(dim)]


def blocks(vectors: DataFrame, centre: Centred, rows: int, row_block: int, column_block: int) -> BlockMatrix:
    """The centred vectors ``x``, numbered by ``at``, as a block matrix."""
    lines = vectors.select(F.col("at").alias("index"), array_to_vector(centre.entries(F.col("x"))).alias("vector"))
    lines = MLUtils.convertVectorColumnsFromML(lines, "vector")
    return IndexedRowMatrix(lines, rows, centre.dim).toBlockMatrix(row_block, column_block)


def whitening(scatter: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whitening matrix (a column per component), share of the variance, and whether a component has any."""
    covariance = (scatter + scatter.T) / (2 * n)
    value, vector = np.linalg.eigh(covariance)
    value, vector = value[::-1][:components], vector[:, ::-1][:, :components]
    trace = float(np.trace(covariance))
    spread = value > max(0.0, float(value[0])) * len(scatter) * np.finfo(float).eps
    scale = np.where(spread, 1 / np.sqrt(np.where(spread, value, 1.0)), 0.0)
    return vector * scale, (value / trace if trace > 0 else np.full(len(value), np.nan)), spread


def _of_dimension(vectors: DataFrame, dim: int, components: int, row_block: int, column_block: int) -> DataFrame:
    spark = vectors.sparkSession
    same = vectors.filter(F.size("x") == dim)
    fit = numbered(same.select("x").distinct(), "at")
    n, sums = sums_of(fit, dim)
    centre = Centred(n, sums)
    column_block = min(column_block, dim)
    part = blocks(fit, centre, n, row_block, column_block)
    groups = max(1, math.ceil(math.ceil(n / row_block) / TOGETHER))
    scatter = product(part.transpose(), part, groups).toLocalMatrix().toArray()
    turn, explained, spread = in_a_task(spark, lambda: whitening(scatter, n, components))
    k = turn.shape[1]
    pieces = [
        ((i, 0), Matrices.dense(len(rows), k, rows.ravel(order="F").tolist()))
        for i, rows in enumerate(turn[a : a + column_block] for a in range(0, dim, column_block))
    ]
    turned = BlockMatrix(spark.sparkContext.parallelize(pieces, 1), column_block, k, dim, k)
    middle = len(pieces)
    fitted = product(part, turned, middle)
    unit = product(fitted.transpose(), fitted, groups).toLocalMatrix().toArray() / n
    gap = np.abs(unit - np.eye(k))[np.ix_(spread, spread)]
    error = float(gap.max(initial=0.0))
    rows = numbered(same, "at")
    total = rows.count()
    shown = product(blocks(rows, centre, total, row_block, column_block), turned, middle).toIndexedRowMatrix()
    lines = callMLlibFunc("getIndexedRows", shown._java_matrix_wrapper._java_model)
    projected = lines.select(F.col("index").alias("at"), vector_to_array("vector").alias("w"))
    known = rows.select("vec_id", "at", centre.deviation(F.col("x")).alias("deviation"))
    share, real = _of(explained.tolist(), "double"), _of(spread.tolist(), "boolean")
    each = known.join(projected, "at").select("vec_id", "deviation", F.posexplode("w").alias("c", "v"))
    return each.select(
        "vec_id",
        (F.col("c") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.when(F.get(real, F.col("c")), F.col("v")).alias("whitened"),
        F.nanvl(F.get(share, F.col("c")), F.lit(None).cast("double")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def whiten(
    table: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64,
    shift: int = 1_000_000, row_block: int = ROWS, column_block: int = COLUMNS,
) -> DataFrame:
    """One row per row of ``table`` and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    vector = own(table, embedding)
    vectors = cut(
        table.filter(usable(vector)).select(own(table, vec_id).alias("vec_id"), whole(vector, scale, shift).alias("x"))
    )
    kind = dict(vectors.dtypes)["vec_id"]
    dims = sorted(r.dim for r in vectors.select(F.size("x").alias("dim")).distinct().collect() if r.dim > 0)
    out = vectors.sparkSession.createDataFrame([], RESULT.format(kind))
    for dim in dims:
        out = out.union(_of_dimension(vectors, dim, components, row_block, column_block))
    return out
