"""Mix sources to target weights by pivotal dependent rounding.

A source's target over its size is the expected number of copies of each of its documents.  The whole part is taken
from every document; the fractions are rounded in pairs: mass (words) moves at random from one document of the pair to
the other until one fraction is 0 or 1, so expectations hold for each document and the words of the pair stay the same.
A group of documents leaves one open fraction; these residuals are paired again in ever fewer groups, a reduction tree
over Spark tasks, until one document per source is left, which is rounded alone.  A source therefore misses its target
by less than one document.

Groups and random numbers depend on hashes of the ids and a seed, never on the layout, so reruns agree.  Null texts have
size 0.  Only rows without an id are told apart by their place in the table, so with them a rerun agrees if the layout
does.  A null source is a source of its own, last in order.  Documents of size 0 carry no words and are taken as often
as the whole part says, at least once where the source is taken at all.  Repeated rows are mixed as separate documents;
they get different random numbers by their place among the repeats.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from perinuc.llm.common import WORD, own, spare
from perinuc.scale import cut, positions

# documents of one group, and residuals paired by one task of the tree
GROUP = 1024
# sources whose targets may be broadcast
FEW_SOURCES = 10_000


def sized(docs: DataFrame, text: str, source: str, doc_id: str) -> DataFrame:
    """Id, source, words and a stable number of each document."""
    return cut(
        docs.select(
            own(docs, doc_id).alias("doc_id"),
            own(docs, source).alias("source"),
            F.coalesce(F.regexp_count(own(docs, text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.monotonically_increasing_id().alias("row"),
        )
    )


def targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2) -> DataFrame:
    """One row per source: source, source_size, docs, target.

    Sources are weighed in code point order, null last.  A target is ``min(most * size, level * weight)``; the level
    rises until the targets add up to ``share`` of all words.  Each step is one aggregate over the sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    ranked = positions(per.withColumn("no_source", F.col("source").isNull()), [], ["no_source", "source"], "pos")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    weighed = cut(ranked.select("source", "source_size", "docs", weight.cast("long").alias("weight")))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    wanted = Fraction(total) * share
    level, cap = Fraction(0), F.col("source_size") * most
    while True:
        # a source is full if its cap is at or below level * weight, compared in whole numbers
        full = cap.cast("decimal(38,0)") * F.lit(level.denominator).cast("decimal(38,0)") <= F.col("weight").cast(
            "decimal(38,0)"
        ) * F.lit(level.numerator).cast("decimal(38,0)")
        capped, open_weight = weighed.agg(
            F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))
        ).first()
        if not open_weight:
            break
        risen = (wanted - capped) / open_weight
        if risen <= level:
            break
        level = risen
    filled = F.col("weight") * F.lit(float(level))
    return weighed.select(
        "source",
        "source_size",
        "docs",
        F.when(cap.cast("double") <= filled, cap.cast("double")).otherwise(filled).alias("target"),
    )


def _unit(row: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) per row number, the same on every run."""
    with np.errstate(over="ignore"):
        z = row.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)) * 2.0**-53


def pivot(size: Sequence[int], part: Sequence[float], chance: Sequence[float]) -> tuple[list[float], int]:
    """Round the fractions of one group in pairs; the fractions, and the index of the one left open (or -1)."""
    out, held = list(part), -1
    for i, own_part in enumerate(part):
        if not 0.0 < own_part < 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b, p, q = size[held], size[i], out[held], own_part
        up = min((1.0 - p) * a, q * b)  # words that can move to the held document
        down = min(p * a, (1.0 - q) * b)  # words that can move away from it
        if chance[i] * (up + down) < down:
            p, q = (1.0 if up == (1.0 - p) * a else p + up / a), (0.0 if up == q * b else q - up / b)
        else:
            p, q = (0.0 if down == p * a else p - down / a), (1.0 if down == (1.0 - q) * b else q + down / b)
        out[held], out[i] = p, q
        held = held if 0.0 < p < 1.0 else i if 0.0 < q < 1.0 else -1
    return out, held


def _rounded(rows: pa.Table, seed: int) -> pa.Table:
    """One group with its fractions rounded; ``open`` marks the one that is left."""
    turn, row, size = (rows.column(c).to_numpy() for c in ("turn", "row", "size"))
    order = np.lexsort((row, size, turn))
    rows, turn = rows.take(pa.array(order)), turn[order]
    # rows that repeat an id share its hash; their place among the repeats tells them apart, whatever the layout
    first = np.r_[True, turn[1:] != turn[:-1]]
    place = np.arange(len(turn)) - np.maximum.accumulate(np.where(first, np.arange(len(turn)), 0))
    chance = _unit(turn.view("uint64") ^ (place.astype("uint64") << np.uint64(1)), seed)
    parts, held = pivot(rows.column("size").to_pylist(), rows.column("part").to_pylist(), chance.tolist())
    rows = rows.set_column(rows.schema.get_field_index("part"), "part", pa.array(parts, pa.float64()))
    return rows.append_column("open", pa.array(np.arange(len(parts)) == held))


def _rounder(seed: int) -> Callable[[pa.Table], pa.Table]:
    return lambda rows: _rounded(rows, seed)


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: Sequence[int] = (3, 1, 2),
    share: Fraction = Fraction(3, 2),
    most: int = 2,
    seed: int = 7,
    group: int = GROUP,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target of its source, copies, taken, row."""
    sizes = sized(docs, text, source, doc_id)
    goals = cut(targets(sizes, weights, share, most))
    n_sources, most_docs = goals.agg(F.count("*"), F.max("docs")).first()
    side = goals.withColumnRenamed("source", "goal_source")
    side = F.broadcast(side) if n_sources <= FEW_SOURCES else side
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # groups follow the source, so a hot source has many and a small one is not cut up
    n_groups = max(1, math.ceil((most_docs or 0) / group))
    base = (
        sizes.join(side, F.col("source").eqNullSafe(F.col("goal_source")))
        .drop("goal_source")
        .withColumn("ratio", ratio)
        .withColumn("whole", F.floor("ratio"))
        # a document without words moves none, so its fraction is settled at once
        .withColumn(
            "part",
            F.when(F.col("size") > 0, F.col("ratio") - F.col("whole")).otherwise(
                ((F.col("whole") == 0) & (F.col("ratio") > 0)).cast("double")
            ),
        )
        # rows without an id are told apart by their number
        .withColumn("turn", F.xxhash64(F.lit(seed), "doc_id", F.when(F.col("doc_id").isNull(), F.col("row"))))
        .withColumn("grp", F.pmod(F.xxhash64("turn"), F.ceil(F.col("docs") / group)))
        .drop("ratio", "docs")
    )
    kinds = {f.name: f.dataType for f in base.schema}
    schema = StructType([StructField(c, kinds[c]) for c in base.columns] + [StructField("open", BooleanType())])
    done, level = [], 0
    rows = base
    while True:
        step = cut(rows.groupBy("source", "grp").applyInArrow(_rounder(seed * 1000 + level), schema))
        if n_groups == 1:
            break
        done.append(step.filter(~F.col("open")))
        n_groups = math.ceil(n_groups / group)
        level += 1
        rows = step.filter("open").drop("open").withColumn("grp", F.floor(F.col("grp") / group))
    # the one document left per source is rounded alone
    last = step.withColumn(
        "part",
        F.when(
            F.col("open"), (F.pmod(F.xxhash64("turn", F.lit("last")), F.lit(1 << 30)) / F.lit(1 << 30) < F.col("part")).cast("double")
        ).otherwise(F.col("part")),
    )
    out = last
    for part in done:
        out = out.union(part)
    copies = F.col("whole") + F.col("part").cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "row")


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; documents meet their copies by id and source."""
    taken = mix(docs, text, source, doc_id, **options)
    key, nth, copies, turn = (spare(docs, n) for n in ("key", "nth", "copies", "turn"))
    of_key = W.partitionBy(key).orderBy(nth)
    plan = (
        taken.select(F.struct("doc_id", "source").alias(key), F.col("row").alias(nth), F.col("copies").alias(copies))
        .withColumn(nth, F.row_number().over(of_key))
        .select(F.col(key).alias(f"{key}_of"), F.col(nth).alias(f"{nth}_of"), copies)
    )
    # rows that repeat an id and source are interchangeable here, so any order pairs them with their copies
    placed = docs.withColumn(
        key, F.struct(own(docs, doc_id).alias("doc_id"), own(docs, source).alias("source"))
    ).withColumn(nth, F.row_number().over(W.partitionBy(key).orderBy(key)))
    met = placed.join(plan, (F.col(key) == F.col(f"{key}_of")) & (F.col(nth) - F.col(f"{nth}_of") == 0))
    return met.withColumn(turn, F.explode(F.sequence(F.lit(1), F.greatest(F.col(copies), F.lit(1))))).filter(
        F.col(copies) > 0
    ).select(*[own(docs, c) for c in docs.columns])
