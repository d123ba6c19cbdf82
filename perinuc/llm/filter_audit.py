"""How the filters of a corpus overlap, from sorted posting lists.

Each part (a source) keeps, per filter, a posting list: the sorted numbers of the rows that fail it, cut into ranges of
row numbers, so a hot part has many ranges and none is larger than a range.  Within a range, the union of every set of
filters is made by a galloping merge of all its lists at once, and what a filter removes after such a set is its list
less that union, again by galloping; what of it was good or toxic is met the same way in the lists of those rows.  Only
the sizes leave the range.  They are summed per part, and any order of the filters reads its steps off these sums.

Null texts count as empty, null sources are the part with the empty name.  Of equal texts those above the smallest id
fail the copy filter; a null id stands after all others, and rows that share the smallest id, or all lack one, pass it.
Rows that repeat an id are separate rows with the same labels; a document is good or toxic if any of its labels says so.
Rows without an id have no labels.  An empty table gives an empty result.  Only the id, text and source columns are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perinuc.llm.common import joined_with_hot, own
from perinuc.scale import cut

FILTERS = "ABCDE"
# rows of a range of row numbers, as a power of two
RANGE = 16
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SIGNS = re.compile(rb"[#$%&*|]")


def failures(text: str) -> int:
    """Bits of the filters A to D that a text fails."""
    data = text.encode("utf-8", "replace")
    words = data.split()  # splits bytes at space and U+0009 to U+000D
    capitals = len(data) - len(data.translate(None, CAPITALS))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > CAPITAL_PERCENT * len(text)) << 2
        | (SIGNS.search(data) is not None) << 3
    )


def gallop(ids: Sequence[int], value: int, at: int) -> int:
    """First place from ``at`` on whose id is not below ``value``, by doubling steps and then halving."""
    n, step = len(ids), 1
    if at >= n or ids[at] >= value:
        return at
    while at + step < n and ids[at + step] < value:
        at += step
        step *= 2
    return bisect_left(ids, value, at + 1, min(n, at + step + 1))


def union(lists: Sequence[Sequence[int]]) -> list[int]:
    """Merge of sorted lists of distinct ids: the list with the smallest head gives all ids below the other heads."""
    heads = [[ids[0], k, 0] for k, ids in enumerate(lists) if ids]
    out: list[int] = []
    while len(heads) > 1:
        heads.sort()
        first, k, at = heads[0]
        other, ids = heads[1][0], lists[k]
        if first == other:
            stop = at + 1  # the other list gives it
        else:
            stop = gallop(ids, other, at)
            out += ids[at:stop]
        if stop < len(ids):
            heads[0] = [ids[stop], k, stop]
        else:
            del heads[0]
    if heads:
        _, k, at = heads[0]
        out += lists[k][at:]
    return out


def difference(ids: Sequence[int], taken: Sequence[int]) -> list[int]:
    """Ids that are not in ``taken``."""
    out: list[int] = []
    at = there = 0
    while at < len(ids):
        there = gallop(taken, ids[at], there)
        if there == len(taken):
            out += ids[at:]
            break
        stop = gallop(ids, taken[there], at)
        out += ids[at:stop]
        at = stop + (stop < len(ids) and ids[stop] == taken[there])
    return out


def shared(ids: Sequence[int], others: Sequence[int]) -> int:
    """How many ids are in both lists."""
    n = at = there = 0
    while at < len(ids) and there < len(others):
        there = gallop(others, ids[at], there)
        if there == len(others):
            break
        at = gallop(ids, others[there], at)
        if at < len(ids) and ids[at] == others[there]:
            n, at, there = n + 1, at + 1, there + 1
    return n


def steps() -> list[tuple[int, int]]:
    """Each filter with each set of filters that can stand before it, as bits."""
    return [(f, before) for f in range(len(FILTERS)) for before in range(1 << len(FILTERS)) if not before >> f & 1]


STEPS = steps()


def sizes(lists: Sequence[Sequence[int]], good: Sequence[int], toxic: Sequence[int]) -> list[tuple[int, int, int]]:
    """For each step: rows that the filter removes after that set, and how many of them are good and toxic."""
    unions = [union([ids for f, ids in enumerate(lists) if s >> f & 1]) for s in range(1 << len(lists))]
    out = []
    for f, before in STEPS:
        gone = difference(lists[f], unions[before])
        out.append((len(gone), shared(gone, good), shared(gone, toxic)))
    return out


def flagged(docs: DataFrame, text: str, source: str, doc_id: str) -> DataFrame:
    """row, doc_id, part, fails (bits of A to D) and digest of each row's text, written once."""
    rows = docs.select(
        own(docs, doc_id).alias("doc_id"),
        F.coalesce(own(docs, source).cast("string"), F.lit("")).alias("part"),
        own(docs, text).cast("string").alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(3), pa.array([failures(t) for t in texts], pa.int32()),
                     pa.array([hashlib.sha256(t.encode("utf-8", "replace")).digest() for t in texts], pa.binary())],
                    ["doc_id", "part", "row", "fails", "digest"],
                )

    kind = dict(rows.dtypes)["doc_id"]
    return cut(rows.mapInArrow(run, f"doc_id {kind}, part string, row long, fails int, digest binary"))


def with_copies(rows: DataFrame) -> DataFrame:
    """Adds the bit of filter E: the text stands under a smaller id anywhere in the table."""
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    met = joined_with_hot(rows, cut(groups), "digest", "n", rows.count())
    copy = F.col("first").isNotNull() & F.coalesce(F.col("doc_id") > F.col("first"), F.lit(True))
    return met.select("doc_id", "part", "row", F.when(copy, F.col("fails") + 16).otherwise(F.col("fails")).alias("fails"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds whether a row is good and whether it is toxic."""

    def says(name: str) -> Column:
        return F.max(F.coalesce(own(labels, name) == 1, F.lit(False)))

    known = labels.filter(own(labels, "doc_id").isNotNull()).groupBy(own(labels, "doc_id").alias("_of")).agg(
        says("quality").alias("good"), says("toxic").alias("toxic")
    )
    met = rows.join(known.filter("good OR toxic"), F.col("doc_id") == F.col("_of"), "left")
    return met.select("part", "row", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def postings(rows: DataFrame) -> DataFrame:
    """One row per part and range of row numbers: how many rows, and the sorted lists A to E, good and toxic."""

    def those(condition: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(condition, F.col("row"))))

    lists = [those(F.col("fails").bitwiseAND(1 << f) != 0).alias(name) for f, name in enumerate(FILTERS)]
    return rows.groupBy("part", F.shiftright("row", RANGE).alias("range")).agg(
        F.count("*").alias("docs"), *lists, those(F.col("good")).alias("good"), those(F.col("toxic")).alias("toxic")
    )


def step_sizes(lists: DataFrame) -> DataFrame:
    """One row per part: docs, and by step how many rows go, and how many good and toxic ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                part, _, docs, *held = (column[0].as_py() for column in row.columns)
                found = sizes(held[: len(FILTERS)], held[-2], held[-1])
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.string()), pa.array([docs] * n, pa.int64()), pa.array(range(n), pa.int32()),
                     *[pa.array(c, pa.int64()) for c in zip(*found)]],
                    ["part", "docs", "step", "gone", "good", "toxic"],
                )

    each = lists.mapInArrow(run, "part string, docs long, step int, gone long, good long, toxic long")
    summed = each.groupBy("part", "step").agg(*[F.sum(c).alias(c) for c in ("docs", "gone", "good", "toxic")])
    return summed.groupBy("part").agg(
        F.max("docs").alias("docs"),
        *[F.transform(F.sort_array(F.collect_list(F.struct("step", c))), lambda s: s[c]).alias(c) for c in ("gone", "good", "toxic")],
    )


def orders() -> list[tuple[str, list[int]]]:
    """Every order of the filters with the places in ``STEPS`` of its steps."""
    place = {s: i for i, s in enumerate(STEPS)}
    out = []
    for order in permutations(range(len(FILTERS))):
        before, at = 0, []
        for f in order:
            at.append(place[f, before])
            before |= 1 << f
        out.append(("".join(FILTERS[f] for f in order), at))
    return out


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    rows = with_labels(with_copies(flagged(docs, text, source, doc_id)), labels)
    sums = cut(step_sizes(postings(rows)))
    n, place = len(FILTERS), {s: i for i, s in enumerate(STEPS)}
    full = (1 << n) - 1
    alone = [place[f, 0] for f in range(n)]
    last = [place[f, full & ~(1 << f)] for f in range(n)]

    def weighed(f: int) -> Column:
        """Rows that filter ``f`` removes, over all orders: a set before it stands in so many of them."""
        terms = [
            F.get(F.col("gone"), F.lit(place[f, s])) * (math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count()))
            for s in range(1 << n) if not s >> f & 1
        ]
        return sum(terms[1:], terms[0])

    parts = sums.withColumn("shapley", F.array(*[weighed(f) for f in range(n)]))
    each = F.explode(
        F.array(*[F.struct(F.lit(order).alias("filter_order"), F.array(*[F.lit(a) for a in at]).alias("at")) for order, at in orders()])
    )
    table = parts.withColumn("_o", each).select("*", "_o.*", F.posexplode("_o.at").alias("turn", "now"))
    letter = F.substr("filter_order", F.col("turn") + 1, F.lit(1))
    table = table.withColumn("f", F.ascii(letter) - ord(FILTERS[0]))
    gone = F.aggregate(F.slice("at", F.lit(1), F.col("turn") + 1), F.lit(0).cast("long"), lambda a, s: a + F.get(F.col("gone"), s))

    def of(column: str, places: Sequence[int]) -> Column:
        return F.get(F.col(column), F.get(F.array(*[F.lit(p) for p in places]), F.col("f")))

    removed = F.get(F.col("gone"), F.col("now"))
    return table.select(
        "part", "filter_order", (F.col("turn") + 1).cast("int").alias("step"), (F.col("docs") - gone).alias("kept"), removed.alias("removed"),
        (of("gone", alone) - removed).alias("redundant"), of("gone", last).alias("unique_fails"), F.get(F.col("good"), F.col("now")).alias("good_lost"),
        F.get(F.col("toxic"), F.col("now")).alias("toxic_lost"), F.get(F.col("shapley"), F.col("f")).alias("shapley"),
    )
