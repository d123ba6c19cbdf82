"""Language identification by prediction by partial matching.

For each language a byte context tree of variable order is fitted on a bounded sample of labelled rows and then frozen.
A text is coded under every language: each byte costs ``-log2`` of its probability in the longest context that has seen
it, after paying an escape in each longer one (method C), and the language with the shortest code wins.  The trees of
all languages share one table of nodes, so a text walks the tree once whatever the number of languages, and all steps
are array look-ups over whole texts.

Texts are lower-cased.  A text that is null or has no letter is ``und`` with score 0, as is every text if no labelled
row was found; the score of others is the posterior of the winner under equal priors.  Ties go to the first language in
code point order.  Repeated rows get the same answer, an empty table gives an empty result, only the id, text and
language columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perinuc.llm.common import held_out, own, piece, spare, thinned

UNDECIDED = "und"
# longest context in bytes
ORDER = 3
# bound on the fit: rows per language, and characters of a row that may be taken
SAMPLE_ROWS, SAMPLE_CHARS = 400, 8192
# look-ups held at once, positions times languages
BLOCK = 1 << 21


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


@dataclass
class Trees:
    """Frozen trees: node 0 is absent, node 1 the empty context; costs in bits per node and language."""

    languages: list[str]
    symbol: np.ndarray  # byte -> symbol; 0 for bytes that no training text has
    parent: np.ndarray  # node -> node of its string without the last symbol
    last: np.ndarray  # node -> last symbol of its string
    inner: int  # nodes below this number may have children
    cost: np.ndarray  # (node, language): code length of the last symbol after the rest
    escape: np.ndarray  # (node, language): code length of leaving the node as a context
    order: int


def fit(texts: Mapping[str, Sequence[str]], order: int = ORDER) -> Trees:
    """Count every string of up to ``order + 1`` bytes in the texts of each language."""
    languages = sorted(texts)
    if not languages:
        none, root = np.zeros((2, 0), np.float32), np.zeros(2, np.int32)
        return Trees([], np.zeros(256, np.int32), root, root, 2, none, none, order)
    pad = b" " * order
    streams = [
        np.frombuffer(pad + pad.join(map(_bytes, texts[name])) + pad, np.uint8) for name in languages
    ]
    seen = np.unique(np.concatenate([np.unique(s) for s in streams]))
    symbol = np.zeros(256, np.int64)
    symbol[seen] = np.arange(1, len(seen) + 1)
    base = len(seen) + 1
    codes, firsts, parent, last = [], [1], [0, 0], [0, 0]
    counts = np.zeros((2, len(languages)))
    for size in range(1, order + 2):
        found = []
        for s in streams:
            sym = symbol[s]
            code = np.zeros(len(sym) - size + 1, np.int64)
            for k in range(size):
                code = code * base + sym[k : len(sym) - size + 1 + k]
            found.append(np.unique(code, return_counts=True))
        level = np.unique(np.concatenate([f[0] for f in found]))
        at = np.zeros((len(level), len(languages)))
        for k, (code, n) in enumerate(found):
            at[np.searchsorted(level, code), k] = n
        before = np.ones(len(level), np.int64)
        if size > 1:
            up = np.minimum(np.searchsorted(codes[-1], level // base), len(codes[-1]) - 1)
            # the first string of a stream ends where its shorter one does not start
            before = np.where(codes[-1][up] == level // base, firsts[-1] + up, 0)
        firsts.append(firsts[-1] + (len(codes[-1]) if codes else 1))
        codes.append(level)
        counts = np.vstack([counts, at])
        parent, last = np.r_[parent, before], np.r_[last, level % base]
    nodes, inner = len(counts), firsts[-1]
    total, kinds = np.zeros_like(counts), np.zeros_like(counts)
    np.add.at(total, parent[2:], counts[2:])
    np.add.at(kinds, parent[2:], counts[2:] > 0)
    total[0] = kinds[0] = 0
    # a context that a language has not seen is left at no cost
    escape = np.log2(np.where(total > 0, (total + kinds) / np.maximum(kinds, 1), 1.0))
    cost = np.zeros((nodes, len(languages)))
    for size in range(1, order + 2):
        rows = np.arange(firsts[size], firsts[size] + len(codes[size - 1]))
        if size == 1:
            lower = np.full((len(rows), len(languages)), 8.0)
        else:
            short = np.searchsorted(codes[size - 2], codes[size - 1] % base ** (size - 1))
            lower = cost[firsts[size - 1] + np.minimum(short, len(codes[size - 2]) - 1)]
        up = parent[rows]
        with np.errstate(divide="ignore", invalid="ignore"):
            direct = np.log2((total[up] + kinds[up]) / counts[rows])
        cost[rows] = np.where(counts[rows] > 0, direct, escape[up] + lower)
    return Trees(
        languages, symbol.astype(np.int32), parent.astype(np.int32), last.astype(np.int32), inner,
        cost.astype(np.float32), escape.astype(np.float32), order,
    )


class Coder:
    """Code lengths of texts under frozen trees."""

    def __init__(self, trees: Trees):
        self.trees = trees
        self.base = int(trees.symbol.max()) + 1
        child = np.zeros((trees.inner, self.base), np.int32)
        nodes = np.arange(2, len(trees.parent))
        up = trees.parent[2:]
        child[up[up > 0], trees.last[2:][up > 0]] = nodes[up > 0]
        self.child = child.ravel()
        self.pad = b" " * trees.order

    def _costs(self, data: np.ndarray) -> np.ndarray:
        """Bits of each byte after the leading padding, per language."""
        t, order = self.trees, self.trees.order
        sym = t.symbol[data]
        at = [np.ones(len(sym), np.int32)]  # at[k][i]: node of the k symbols that end at i
        for _ in range(order + 1):
            node = np.zeros(len(sym), np.int32)
            node[1:] = self.child[at[-1][:-1] * self.base + sym[1:]]
            if len(at) == 1:
                node[0] = self.child[self.base + sym[0]]
            at.append(node)
        cost = t.cost[at[-1]]
        left = np.flatnonzero(at[-1] == 0)
        left = left[left >= order]
        for size in range(order, -1, -1):  # contexts of this many symbols have not seen the byte
            if not len(left):
                break
            cost[left] += t.escape[at[size][left - 1] if size else 1]
            if size == 0:
                cost[left] += 8.0
                break
            known = at[size][left] > 0
            cost[left[known]] += t.cost[at[size][left[known]]]
            left = left[~known]
        return cost[order:]

    def bits(self, texts: Sequence[str]) -> np.ndarray:
        """Code length of each text under each language."""
        out = np.zeros((len(texts), len(self.trees.languages)))
        block = max(4096, BLOCK // max(1, len(self.trees.languages)))
        held: list[tuple[int, bytes]] = []
        size = 0

        def settle() -> None:
            data = np.frombuffer(b"".join(self.pad + d for _, d in held), np.uint8)
            cost = self._costs(data)
            starts = np.cumsum([0] + [len(d) + len(self.pad) for _, d in held[:-1]])
            ends = starts + [len(d) for _, d in held]
            # the padding of the next text lies between an end and the next start
            sums = np.add.reduceat(cost, np.c_[starts, ends].ravel()[: 2 * len(held) - 1], axis=0, dtype=np.float64)[::2]
            np.add.at(out, [i for i, _ in held], sums)

        for i, text in enumerate(texts):
            data = _bytes(text)
            for from_ in range(0, len(data), block):  # a long text goes on with the context where it was cut
                piece = data[from_ : from_ + block]
                if from_:
                    out[i] += self._costs(
                        np.frombuffer(data[from_ - len(self.pad) : from_ + block], np.uint8)
                    ).sum(axis=0, dtype=np.float64)
                elif piece:
                    held.append((i, piece))
                    size += len(piece)
                    if size >= block:
                        settle()
                        held, size = [], 0
        if held:
            settle()
        return out

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNDECIDED] * len(texts), [0.0] * len(texts)
        asked = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if self.trees.languages and asked:
            bits = self.bits([texts[i] for i in asked])
            best = bits.argmin(axis=1)
            share = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000.0))
            for i, k, p in zip(asked, best.tolist(), (share.max(axis=1) / share.sum(axis=1)).tolist()):
                names[i], scores[i] = self.trees.languages[k], p
        return names, scores


def learn(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS
) -> Trees:
    """Fit on up to ``rows`` rows of each language, and ``chars`` characters of each, chosen by a hash of the id."""
    known = (
        docs.select(own(docs, doc_id).alias("doc_id"), own(docs, lang).alias("lang"), own(docs, text).alias("text"))
        .filter(~held_out() & F.col("lang").isNotNull() & (F.col("text") != ""))
        .withColumn("turn", F.xxhash64("doc_id"))
    )
    # one row per language, as many as the model holds itself; thinning leaves a task a few times `rows` to rank
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    some = known.join(F.broadcast(sizes), "lang").filter(thinned(F.col("turn"), rows, F.col("n")))
    some = some.withColumn("text", piece(F.col("text"), chars, F.xxhash64("doc_id", F.lit("piece"))))
    # at most `rows` texts per language of at most `chars` characters reach the driver
    first = W.partitionBy("lang").orderBy("turn", "text")
    sample = some.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= rows)
    texts: dict[str, list[tuple]] = {}
    for r in sample.select("lang", "turn", "text").collect():
        texts.setdefault(r.lang, []).append((r.turn, r.text))
    return fit({name: [t for _, t in sorted(found)] for name, found in texts.items()})


def identify(docs: DataFrame, trees: Trees, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    rows = docs.select(
        own(docs, doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), own(docs, text).cast("string").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(trees)
        for batch in batches:
            names, scores = coder.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def known_language(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose text has a language, with all their columns; ``und`` rows go."""
    trees = learn(docs, text, lang, doc_id)

    @F.pandas_udf("string")
    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = Coder(trees)
        for batch in texts:
            yield pd.Series(coder.predict([t if isinstance(t, str) else None for t in batch])[0])

    found = spare(docs, "language")
    return docs.withColumn(found, predicted(own(docs, text))).filter(F.col(found) != UNDECIDED).select(
        *[own(docs, c) for c in docs.columns]
    )
