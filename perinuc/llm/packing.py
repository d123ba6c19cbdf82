"""Packing of tokenised documents into sequences of fixed size by linear grouping.

Only documents longer than a sequence are cut; full pieces are sequences by themselves.  Of the others, the large ones are
put in falling length and cut into groups of equal cardinality, each rounded up to its largest length, so that few sizes
remain; for those, bins are filled by a few configurations found by column generation.  Actual pieces then take the places
of their group, which leaves some room in every bin, and small pieces go where they fit best, all bins with equal room at
once.  Counts by length and by free room, at most as many as a sequence has tokens, are all that reaches the driver; pieces
are ranked through a range shuffle, and a rank gives the sequence by arithmetic.

Token ids are those of the published vocabulary, with one closing id after each document.  Null texts count as empty and
hold that id alone.  Text that spells a special token becomes that token.  Rows that repeat an id are documents of their
own; with a null id too.  An empty table gives an empty result.  Only the id and text columns are read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from perinuc.llm.bin_plans import Rule, best_fit, configurations, groups, large_rules
from perinuc.llm.bpe import byte_symbols
from perinuc.llm.common import in_a_task, numbered, own
from perinuc.scale import cut

SIZE, END = 1024, 2
# groups of large lengths, and the share of a sequence above which a length is large
GROUPS, LARGE = 320, 4

# fixed value: the split pattern of byte-level vocabularies
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteEncoder:
    """Ids of a byte-level vocabulary file.

    ``tiktoken`` gives the same ids in less time where the file is of the plain kind it knows; it gives up on white space of
    some hundred thousand characters, which the library that reads the file then encodes.
    """

    def __init__(self, file: str | Path):
        spec = json.loads(Path(file).read_text(encoding="utf-8"))
        self.library = Tokenizer.from_file(str(file))
        self.library.no_truncation()
        self.library.no_padding()
        self.quick = None
        ids, cut_, special = spec["model"]["vocab"], spec["pre_tokenizer"] or {}, {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [ids[a + b] for a, b in merges]
        plain = (
            cut_.get("type") == "ByteLevel" and not cut_.get("add_prefix_space") and cut_.get("use_regex", True)
            and spec["normalizer"] is None and not spec["model"].get("ignore_merges")
            # a smaller id is an earlier merge, and every other entry is a byte or special
            and all(a < b for a, b in zip(made, made[1:])) and len(set(ids) - set(special)) == len(made) + 256
        )
        if plain:
            byte = {s: b for b, s in enumerate(byte_symbols())}
            ranks = {bytes(byte[c] for c in name): i for name, i in ids.items() if name not in special}
            self.quick = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> list[int]:
        if self.quick is not None:
            try:
                return self.quick.encode(text, allowed_special="all")
            except ValueError:
                pass
        return self.library.encode(text, add_special_tokens=False).ids


def pieces(
    docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id", size: int = SIZE, end: int = END, tokens: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and with ``tokens`` its ids; the first of a document is the shorter one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found, owner, kept = [], [], []
                for row, text_ in enumerate(part.column(1).to_pylist()):
                    ids = np.array([*encoder.encode(text_ or ""), end], "<u4")
                    first = (len(ids) - 1) % size + 1
                    stops = range(first, len(ids) + 1, size)
                    for piece, stop in enumerate(stops):
                        some = ids[max(0, stop - size) if piece else 0 : stop]
                        found.append((piece, stop - len(some), len(some), zlib.crc32(some.tobytes())))
                        owner.append(row)
                        kept.append(some)
                arrays = [part.column(0).take(pa.array(owner, pa.int64()))]
                arrays += [pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int64(), pa.int32(), pa.int64()))]
                if tokens:
                    arrays.append(pa.array([k.astype(np.int32) for k in kept], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(own(docs, doc_id).alias("doc_id"), own(docs, text).cast("string").alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if tokens else [])
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, piece int, start long, length int, ids_crc32 long" + (", ids array<int>" if tokens else "")
    return rows.mapInArrow(run, schema)


def by_rule(rows: DataFrame, rank: str, rules: list[Rule], base: list[int], name: str) -> DataFrame:
    """Adds the bin of each rank: ``base`` of its rule, and how far the rank lies in the rule."""
    first, start = np.array([r.first for r in rules]), np.array([b + r.bin for r, b in zip(rules, base)])
    each = np.array([r.each for r in rules])
    at = rows.columns.index(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(at).to_numpy()
            rule = np.searchsorted(first, place, side="right") - 1
            yield batch.append_column(name, pa.array(start[rule] + (place - first[rule]) // each[rule], pa.int64()))

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, {name} long")


def pack(found: DataFrame, size: int = SIZE, wanted: int = GROUPS, large: int = LARGE) -> DataFrame:
    """``found`` (from :func:`pieces`) with sequence_id and offset."""
    found = cut(found.withColumn("_row", F.monotonically_increasing_id()))
    counted = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect() if r.length < size}
    lengths = sorted(counted, reverse=True)
    big, little = [n for n in lengths if n * large > size], [n for n in lengths if n * large <= size]
    sizes, demand = groups(big, [counted[n] for n in big], wanted)
    rules, bins = large_rules(demand, in_a_task(found.sparkSession, lambda: configurations(sizes, demand, size)))
    order = [F.col("length").desc(), F.col("doc_id"), F.col("piece"), F.col("_row")]
    ranked = numbered(found.filter(F.col("length") < size).repartitionByRange(*order).sortWithinPartitions(*order), "_rank")
    n_big = sum(demand)
    packed = by_rule(ranked.filter(F.col("_rank") < n_big), "_rank", rules, [0] * len(rules), "sequence_id") if rules else None
    if packed is not None:
        packed = cut(packed)
    filled = new = None
    if little:
        small = ranked.filter(F.col("_rank") >= n_big).withColumn("_rank", F.col("_rank") - n_big)
        room, free_bins = {}, None
        if packed is not None:
            free = packed.groupBy("sequence_id").agg((F.lit(size) - F.sum("length")).alias("free")).filter("free > 0")
            free_bins = numbered(free.repartitionByRange("free", "sequence_id").sortWithinPartitions("free", "sequence_id"), "_target")
            room = {r.free: r.n for r in free_bins.groupBy("free").agg(F.count("*").alias("n")).collect()}
        fits, _ = best_fit(little, [counted[n] for n in little], room, size)
        # bins are named by their number in the order of free room; new ones come after all others
        base, upto = {}, 0
        for r in sorted(room):
            base[r], upto = upto, upto + room[r]
        base[0] = upto
        placed = by_rule(small, "_rank", [r for r, _ in fits], [base[f] for _, f in fits], "_target")
        placed = placed.withColumn("_rank", F.col("_rank") + n_big)
        opened = F.col("_target") >= upto
        new = placed.filter(opened).withColumn("sequence_id", F.col("_target") - upto + bins).drop("_target")
        if free_bins is not None:
            filled = placed.filter(~opened).join(free_bins.select("_target", "sequence_id"), "_target").drop("_target")
    full = found.filter(F.col("length") == size)
    # numbers above all bins: there are never more of them than pieces
    out = full.withColumn("sequence_id", F.col("_row") + bins + sum(counted.values())).withColumn("offset", F.lit(0).cast("long"))
    parts = [p for p in (packed, filled, new) if p is not None]
    if parts:
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        before = W.partitionBy("sequence_id").orderBy("_rank").rowsBetween(W.unboundedPreceding, -1)
        out = out.unionByName(both.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("_rank"))
    return out.drop("_row")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its token ids, from packed pieces that carry ``ids``; a sequence is as small as its size."""
    each = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    return each.select("sequence_id", F.flatten(F.transform("_p", lambda p: p["ids"])).alias("ids"))


def packed_documents(docs: DataFrame, vocabulary: str, size: int = SIZE, **options) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, vocabulary, size=size, **options), size)
