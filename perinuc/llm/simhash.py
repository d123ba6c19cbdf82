"""Near-duplicates by SimHash fingerprints and a binary trie joined with itself.

Distinct fingerprints are keys of a binary trie.  Two nodes of equal depth are visited together; the bits in which their
paths differ add up, and a pair of nodes goes as soon as they exceed the budget.  To spread the trie over tasks, the 64
bits are cut into ``budget + 1`` blocks: two keys within the budget agree on at least one whole block, so for each block
a trie with that block at its top is cut into the nodes below it, and every link lies within a node of at least one of
them.  A node with too many keys is split further into pairs of nodes, in as many rounds as it takes, so no task gets an
unbounded group and no link is lost.  Tasks return a spanning star per cluster of links, not all pairs; components of
these come from alternating star contraction.

A null text, or one without words, has fingerprint zero and links like any other.  The component id is the smallest
non-null id that can be reached; it is null only if no member has an id.  Repeated rows share their component, an empty
table gives an empty result, and only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perinuc.llm.common import joined_with_hot, own, spare
from perinuc.scale import cut

SEED, SHINGLE, BUDGET = 42, 3, 2
# keys of one node that a task takes whole, and how many bits a larger one is split by
NODE, SPLIT_BITS = 4096, 8
# rows that a task joins at once, and pairs below which two nodes are compared directly
ROWS, LEAF = 1 << 16, 64
LANES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes."""
    rows = -(-len(hashes) // 255)
    filled = np.zeros(rows * 255, np.uint64)
    filled[: len(hashes)] = hashes
    filled = filled.reshape(rows, 255)
    counts = np.zeros((8, 8), np.int64)  # eight counters of one byte each share a word; 255 rows cannot overflow them
    for shift in range(8):
        lanes = ((filled >> np.uint64(shift)) & LANES).sum(axis=1, dtype=np.uint64)
        counts[shift] = lanes.astype("<u8").view(np.uint8).reshape(rows, 8).sum(axis=0, dtype=np.int64)
    bits = counts.T.ravel() * 2 > len(hashes)  # byte by byte, lowest bit first
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    sizes = list(map(len, words))
    starts = [0, *accumulate(n + 1 for n in sizes)]
    ends = [a + n for a, n in zip(starts, sizes)]
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])]
    return majority(np.array(hashes, np.uint64))


def fingerprints(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, also: str | None = None
) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of each row, and column ``also`` under that name if one is given."""
    more = [] if also is None else [own(docs, also).alias("also")]
    rows = docs.select(own(docs, doc_id).alias("doc_id"), own(docs, text).cast("string").alias("text"), *more)
    kinds, names = dict(rows.dtypes), ["doc_id", "fp", *["also" for _ in more]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = np.array([fingerprint(t, shingle) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64)), *part.columns[2:]], names)

    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, fp long" + (f", also {kinds['also']}" if more else ""))


def _pairs(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of the ranges ``a + [0, n_a)`` and ``b + [0, n_b)``."""
    size = n_a * n_b
    which = np.repeat(np.arange(len(a)), size)
    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return a[which] + k // n_b[which], b[which] + k % n_b[which]


def trie_links(key: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray, depth: np.ndarray, error: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of keys that differ in at most ``budget`` bits, from pairs of trie nodes.

    Keys are sorted within each node.  Node pair k is ``[start, mid)`` with ``[mid, end)``, or a node with itself if
    mid equals end; ``depth`` bits are behind it, in which its sides differ by ``error``.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    same = mid == end
    # columns: first node from, to, second node from, to, differing bits
    todo = np.c_[start, mid, np.where(same, start, mid), end, error].astype(np.int64)
    live = np.zeros((0, 5), np.int64)
    for d in range(int(depth.min()) if len(depth) else 64, 65):
        live = np.vstack([live, todo[depth == d]])
        n_a, n_b = live[:, 1] - live[:, 0], live[:, 3] - live[:, 2]
        itself = live[:, 0] == live[:, 2]
        live = live[(n_a > 0) & (n_b > 0) & (live[:, 4] <= budget) & ~(itself & (n_a < 2))]
        n_a, n_b = live[:, 1] - live[:, 0], live[:, 3] - live[:, 2]
        small = n_a * n_b <= LEAF
        if small.any():
            i, j = _pairs(live[small, 0], n_a[small], live[small, 2], n_b[small])
            i, j = i[i != j], j[i != j]
            near = np.bitwise_count(key[i] ^ key[j]) <= budget
            found.append((i[near], j[near]))
            live = live[~small]
        if d == 64 or not len(live):
            if not (depth > d).any():
                break
            continue
        # zeros come before ones below a node, so its split point follows from a running count of ones
        ones = np.r_[0, np.cumsum((key >> np.uint64(63 - d)) & np.uint64(1)).astype(np.int64)]
        cut_a = live[:, 1] - (ones[live[:, 1]] - ones[live[:, 0]])
        cut_b = live[:, 3] - (ones[live[:, 3]] - ones[live[:, 2]])
        a0, a1, b0, b1, e = live.T
        itself = a0 == b0
        zero, one = np.c_[a0, cut_a, b0, cut_b, e], np.c_[cut_a, a1, cut_b, b1, e]
        left, right = np.c_[a0, cut_a, cut_b, b1, e + 1], np.c_[cut_a, a1, b0, cut_b, e + 1][~itself]
        live = np.vstack([zero, one, left, right])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``n`` indices reaches over the links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by path, cut only between paths."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows >= ROWS:
            path = held.column("path").combine_chunks().dictionary_encode().indices.to_numpy()
            last = int(np.flatnonzero(path == path[-1])[0])
            if last:
                yield held.slice(0, last)
                held = held.slice(last)
    if held is not None and held.num_rows:
        yield held


def _join_nodes(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    for table in _blocks(batches):
        path = table.column("path").combine_chunks().dictionary_encode().indices.to_numpy()
        side = table.column("side").to_numpy()
        key = table.column("key").to_numpy().view(np.uint64)
        fp = table.column("fp").to_numpy()
        start = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
        end = np.r_[start[1:], len(path)]
        # side 0: the node itself; sides 1 and 2: a pair of nodes
        mid = start + np.add.reduceat(side < 2, start)
        pair = side[start] > 0
        keep = ~pair | (mid < end)
        start, mid, end = start[keep], mid[keep], end[keep]
        if not len(start):
            continue
        i, j = trie_links(
            key, start, mid, end, table.column("depth").to_numpy()[start], table.column("err").to_numpy()[start], budget
        )
        # the same key may stand at several rows, so links join keys, not rows
        keys, at = np.unique(fp, return_inverse=True)
        label = _stars(len(keys), at[i], at[j])
        moved = np.flatnonzero(label != np.arange(len(keys)))
        yield pa.RecordBatch.from_arrays([pa.array(keys[moved]), pa.array(keys[label[moved]])], ["u", "v"])


def trie_join(keys: DataFrame, budget: int = BUDGET, node: int = NODE) -> DataFrame:
    """Links ``u, v`` that join every cluster of distinct keys ``fp`` within ``budget`` bits."""
    n = budget + 1
    width = [64 // n + (k < 64 % n) for k in range(n)]
    from_ = [sum(width[:k]) for k in range(n)]

    def turned(k: int):  # the block of trie k becomes the top of the key
        s = from_[k]
        return F.col("fp") if s == 0 else F.shiftleft("fp", s).bitwiseOR(F.shiftrightunsigned("fp", 64 - s))

    tries = F.explode(
        F.array(*[F.struct(F.lit(k).alias("trie"), turned(k).alias("key"), F.lit(width[k]).alias("depth")) for k in range(n)])
    )
    rows = keys.select("fp", tries.alias("t")).select(
        F.expr("concat_ws('/', t.trie, shiftrightunsigned(t.key, 64 - t.depth))").alias("path"),
        F.lit(0).alias("side"),
        "t.key",
        "fp",
        "t.depth",
        F.lit(0).alias("err"),
    )
    ready = []
    while True:
        sizes = rows.groupBy("path").agg(F.count("*").alias("n"), F.max("depth").alias("d"))
        large = cut(sizes.filter((F.col("n") > node) & (F.col("d") < 64)).select("path"))
        if large.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(large, "path", "left_anti"))
        rows = cut(_split(rows.join(large, "path", "left_semi"), budget))
    nodes = ready[0]
    for more in ready[1:]:
        nodes = nodes.unionByName(more)
    placed = nodes.repartition("path").sortWithinPartitions("path", "side", "key")
    return placed.mapInArrow(lambda b: _join_nodes(b, budget), "u long, v long").distinct()


def _split(rows: DataFrame, budget: int) -> DataFrame:
    """Rows of large node pairs, dealt to the pairs of their children that are still within the budget."""
    masks = [m for m in range(1 << SPLIT_BITS) if m.bit_count() <= budget]
    bits = F.expr(f"least({SPLIT_BITS}, 64 - depth)")
    own_child = F.expr(f"shiftrightunsigned(shiftleft(key, depth), 64 - least({SPLIT_BITS}, 64 - depth))")
    dealt = (
        rows.withColumn("bits", bits)
        .withColumn("child", own_child)
        .withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
        .withColumn("err", F.col("err") + F.bit_count("mask"))
        .filter((F.col("err") <= budget) & F.expr("mask < shiftleft(1L, bits)"))
        .withColumn("other", F.col("child").bitwiseXOR(F.col("mask")))
    )
    # a node with itself gives nodes with themselves, and pairs in which the smaller child is side 1
    side = F.when(F.col("side") > 0, F.col("side")).when(F.col("mask") == 0, 0).when(F.col("child") < F.col("other"), 1).otherwise(2)
    first = F.when(F.col("side") > 0, F.when(F.col("side") == 1, F.col("child")).otherwise(F.col("other"))).otherwise(F.least("child", "other"))
    second = F.when(F.col("side") > 0, F.when(F.col("side") == 1, F.col("other")).otherwise(F.col("child"))).otherwise(F.greatest("child", "other"))
    return dealt.select(
        F.concat_ws("/", "path", F.concat_ws("-", first, second)).alias("path"),
        side.cast("int").alias("side"),
        "key",
        "fp",
        (F.col("depth") + F.col("bits")).cast("int").alias("depth"),
        "err",
    )


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def star_roots(links: DataFrame) -> DataFrame:
    """``u, v``: every linked key above the smallest of its component, with that smallest key."""
    links = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    mark = _mark(links)
    while mark[0]:
        both = links.select("u", "v").union(links.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        links = cut(hung.union(least.select("u", F.col("m").alias("v"))).distinct())
        before, mark = mark, _mark(links)
        if mark == before:
            break
    return links


def _roots(keys: DataFrame, budget: int, node: int) -> DataFrame:
    """``keys`` (distinct ``fp``) with the smallest key of their component as ``root``."""
    roots = star_roots(trie_join(keys.select("fp"), budget, node)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    return keys.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", budget: int = BUDGET, node: int = NODE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed long), component_id."""
    rows = cut(fingerprints(docs, text, doc_id))
    keys = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    rooted = _roots(keys, budget, node)
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = cut(rooted.join(firsts, "root").select("fp", "n", "component_id"))
    total = rows.count()
    return joined_with_hot(rows, labels, "fp", "n", total).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", budget: int = BUDGET, node: int = NODE) -> DataFrame:
    """One row of ``docs`` per component: the one with the smallest id, null ids last, and among equal ids the smallest digest
    of its text.  Of rows that agree in both, one stays, whichever the hash of its columns puts first.
    """
    digest = F.sha2(F.coalesce(own(docs, text).cast("string"), F.lit("")), 256)
    names = {n: spare(docs, n) for n in ("digest", "id", "n")}
    marked = docs.withColumn(names["digest"], digest)
    rows = cut(fingerprints(marked, text, doc_id, also=names["digest"]))
    # one row per fingerprint: its first id and text, and how many rows are equal to that one
    texts = rows.groupBy("fp", "doc_id", F.col("also").alias("digest")).agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest", "n"))
    keys = cut(texts.groupBy("fp").agg(first.alias("first")))
    stays = cut(_roots(keys, budget, node).groupBy("root").agg(F.min("first").alias("first")).select("first.*"))
    of = {"digest": names["digest"], "doc_id": names["id"], "n": names["n"]}
    wanted = stays.select(F.col("digest").alias(f"{of['digest']}_of"), F.col("doc_id").alias(of["doc_id"]), F.col("n").alias(of["n"]))
    met = marked.join(
        wanted, (F.col(of["digest"]) == F.col(f"{of['digest']}_of")) & own(docs, doc_id).eqNullSafe(F.col(of["doc_id"]))
    )
    columns = [own(docs, c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    alone = met.filter(F.col(of["n"]) == 1).select(*[own(docs, c) for c in docs.columns])
    repeated = met.filter(F.col(of["n"]) > 1).groupBy(of["digest"], of["doc_id"]).agg(
        F.min_by(F.struct(*columns), F.xxhash64(*[own(docs, c) for c in docs.columns])).alias("one")
    )
    return alone.union(repeated.select(*[F.col(f"one.c{i}").alias(c) for i, c in enumerate(docs.columns)]))
