"""Passages of 50 words or more that stand in several places, from sparse suffixes.

Only suffixes that start at a minimiser are kept: of every 26 consecutive places, the one whose next 25 words have the
smallest hash.  Equal passages pick equal places, and each window of 50 words holds a kept suffix with its whole first 25
words.  Suffixes are brought together by those words.  Those that agree on every window around them are one variant, and
all windows of a variant that stands twice repeat.  A variant that stands alone, beside others of its first words, is
extended: its text is read once more and each of its windows is compared with those of the other variants, by every split
of the other 25 words to its left and right.  So exactly the windows of 50 words that occur twice are found, also twice in
one text, and their union are the passages.

Words are stretches between white space, case kept; words, windows and texts are told apart by hashes of 64 bits.  Null
texts count as empty, texts of fewer words give no span.  Each distinct text of an id has a
result row, also where the id is null or repeats; rows that repeat both are separate places and share one.  Only the id and text columns are read, and an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perinuc.llm.common import own
from perinuc.scale import cut

PASSAGE, SUFFIX = 50, 25
PLACES = PASSAGE - SUFFIX + 1
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive words, from their own hashes, by running sums modulo 2**64."""
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(words * _powers(BASE, len(words)), dtype=np.uint64)]
    return _mixed((sums[size:] - sums[:-size]) * _powers(INVERSE, len(words) - size + 1))


def word_hashes(text: str | None) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in (text or "").encode("utf-8", "replace").split()], np.uint64)


def suffixes(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the kept suffixes, the hash of their first words, and of the windows that hold them."""
    hashes = word_hashes(text)
    if len(hashes) < PASSAGE:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, PLACES), np.uint64)
    first = window_hashes(hashes, SUFFIX)
    seen = np.lib.stride_tricks.sliding_window_view(first, PLACES)
    place = np.unique(np.arange(len(seen)) + seen.argmin(axis=1))
    whole = window_hashes(hashes, PASSAGE)
    whole[whole == 0] = 1  # 0 is kept for windows beyond the text's ends
    starts = place[:, None] - np.arange(PLACES)
    inside = (starts >= 0) & (starts < len(whole))
    return place, first[place].view(np.int64), np.where(inside, whole[np.clip(starts, 0, len(whole) - 1)], np.uint64(0))


def splits(text: str | None, places: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the windows around suffixes at ``places``: which suffix, the window's start, a hash of its words and split."""
    whole = window_hashes(word_hashes(text), PASSAGE)
    left = np.arange(PLACES)
    starts = np.array(places, np.int64)[:, None] - left
    which, at = np.nonzero((starts >= 0) & (starts < len(whole)))
    starts = starts[which, at]
    return which, starts, _mixed(whole[starts] + left[at].astype(np.uint64) * np.uint64(BASE)).view(np.int64)


def _joined(starts: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Passages covered by windows that start anywhere from the first to the second of each pair."""
    spans: list[tuple[int, int]] = []
    for a, b in sorted(set(starts)):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], b + PASSAGE))
        else:
            spans.append((a, b + PASSAGE))
    return spans


def repeated_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document that holds a repeated passage: doc_id, n_words in such passages, spans (word from:to)."""
    rows = docs.select(own(docs, doc_id).alias("doc_id"), own(docs, text).cast("string").alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("text_id"))
    kind = dict(rows.dtypes)["doc_id"]

    def keep(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [suffixes(t) for t in part.column(1).to_pylist()]
                key = pa.array(np.concatenate([f[1] for f in found]))
                if not whole:
                    yield pa.RecordBatch.from_arrays([key], ["key"])
                    continue
                owner = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
                place, windows = np.concatenate([f[0] for f in found]), np.concatenate([f[2] for f in found])
                # windows of a suffix start from `back` words before it to `near` words before it
                held = windows != 0
                back = PLACES - 1 - held[:, ::-1].argmax(axis=1) if len(held) else place
                near = held.argmax(axis=1) if len(held) else place
                print_ = np.array([xxhash.xxh64_intdigest(w.tobytes()) for w in windows], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(owner), part.column(2).take(owner), key, pa.array(print_), pa.array(place << 10 | back << 5 | near)],
                    ["doc_id", "text_id", "key", "print", "at"],
                )

    partnered = rows.mapInArrow(lambda b: keep(b, False), "key long").groupBy("key").count().filter("count > 1").select("key")
    every = rows.mapInArrow(lambda b: keep(b, True), f"doc_id {kind}, text_id long, key long, print long, at long")
    near = cut(every.join(partnered, "key", "left_semi"))
    # suffixes whose windows all agree are one variant (its print covers the key's words too); the windows of a variant
    # that stands twice all repeat
    variants = cut(
        near.groupBy("print").agg(
            F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_id", "at", "key")).alias("one")
        ).select("print", "n", "one.doc_id", "one.text_id", "one.at", "one.key")
    )
    place = F.shiftright("at", 10)
    spans = [(place - F.shiftright("at", 5).bitwiseAND(31)).alias("start"), (place - F.col("at").bitwiseAND(31)).alias("stop")]
    whole = near.select("doc_id", "text_id", "print", "at").join(variants.filter("n > 1").select("print"), "print", "left_semi")
    # a variant that stands alone shares single windows with other variants of its first words
    single = variants.filter("n = 1").select("key").distinct()
    asked = variants.join(single, "key", "left_semi").groupBy("text_id").agg(
        F.collect_list(F.struct("doc_id", "at", (F.col("n") == 1).alias("alone"), "text_id")).alias("asked")
    )
    texts = rows.select("text_id", "text").dropDuplicates(["text_id"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                lists = part.column(1)
                ends, flat = lists.offsets.to_numpy(), lists.flatten()
                places = (flat.field(1).to_numpy() >> 10).tolist()
                ends = (ends - ends[0]).tolist()
                found = [splits(t, places[a:b]) for t, a, b in zip(part.column(0).to_pylist(), ends, ends[1:])]
                owner = pa.array(np.concatenate([f[0] + a for f, a in zip(found, ends)]))
                yield pa.RecordBatch.from_arrays(
                    [flat.field(0).take(owner), flat.field(3).take(owner), flat.field(2).take(owner), pa.array(np.concatenate([f[1] for f in found])),
                     pa.array(np.concatenate([f[2] for f in found]))],
                    ["doc_id", "text_id", "alone", "start", "window"],
                )

    each = texts.join(asked, "text_id").select("text", "asked").mapInArrow(
        extend, f"doc_id {kind}, text_id long, alone boolean, start long, window long"
    )
    agreed = each.groupBy("window").count().filter("count > 1").select("window")
    edges = each.filter("alone").join(agreed, "window", "left_semi").select(
        "doc_id", "text_id", "start", F.col("start").alias("stop")
    )
    starts = whole.select("doc_id", "text_id", *spans).union(edges)

    def merge(rows: pa.Table) -> pa.Table:
        spans = _joined(zip(rows.column("start").to_pylist(), rows.column("stop").to_pylist()))
        return pa.table(
            {"doc_id": rows.column("doc_id").slice(0, 1), "n_words": pa.array([sum(b - a for a, b in spans)], pa.int64()),
             "spans": [",".join(f"{a}:{b}" for a, b in spans)]}
        )

    return starts.distinct().groupBy("doc_id", "text_id").applyInArrow(merge, f"doc_id {kind}, n_words long, spans string")
