"""Quality classifier: a byte-level convolutional network in numpy.

The text's bytes are cut into overlapping chunks that cover the whole document.  Filters of six bytes, learned as tables
from byte pairs to activations, run over every chunk and are max-pooled in it; a document is described by the mean and
the maximum of its chunks, and a small dense layer combines these into one probability.  Only the positions that win a
pool get a gradient, so training is cheap.

The fit takes a bounded sample of labelled rows, as many of either label, and corrects the probability for the share of
labels among all training rows.  Null texts count as empty; an empty text is one chunk of padding.  Repeated rows score
alike, an empty table gives an empty result, and without labelled rows of both kinds every score is the share of label 1
(1 if there are no labels at all).  Only the id and text columns are inputs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perinuc.llm.common import held_out, own, piece, thinned

# bound on the fit: rows per label, characters of a row that may be taken
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 8192
FILTERS, HIDDEN, PAIRS = 16, 16, 3
# a chunk is two steps long and starts every step
STEP = 128
EPOCHS, BATCH, RATE = 8, 64, 0.004
# bytes convolved at once
BLOCK = 1 << 17
THRESHOLD = 0.7


@dataclass
class Network:
    table: np.ndarray  # (2 * PAIRS, 256, FILTERS): activation of a byte at each place of a filter
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float  # log odds added for the share of labels


def _laid_out(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts behind each other, each filled to whole steps plus one, and the first step of each."""
    sizes = [max(2, -(-len(t) // STEP) + 1) for t in texts]
    first = np.cumsum([0, *sizes])
    data = np.zeros(first[-1] * STEP + 2 * PAIRS, np.uint8)
    for t, at in zip(texts, first):
        data[at * STEP : at * STEP + len(t)] = np.frombuffer(t, np.uint8)
    return data, first


def _pair_tables(net: Network) -> np.ndarray:
    """Activation of each byte pair at each pair of places."""
    t = net.table
    return np.stack([(t[2 * k][:, None] + t[2 * k + 1][None]).reshape(65536, -1) for k in range(PAIRS)])


def _activations(data: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Filters at every place but the last few of padding."""
    n = len(data) - 2 * PAIRS
    code = data[:-1].astype(np.int32) << 8 | data[1:]
    out = np.take(pairs[0], code[:n], axis=0)
    for k in range(1, PAIRS):
        out += np.take(pairs[k], code[2 * k : 2 * k + n], axis=0)
    return out


def _dense(net: Network, described: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(described @ net.w1 + net.b1)
    return hidden, hidden @ net.w2 + net.b2


def _described(pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean and maximum over the chunks of each text; the last step of a text opens no chunk of its own."""
    chunk = np.maximum(pooled[:-1], pooled[1:])
    spans = np.c_[first[:-1], first[1:] - 1].ravel()
    # a span between two texts is the chunk across their border, which belongs to neither
    spans = spans[:-1]
    total = np.add.reduceat(chunk, spans, axis=0)[::2] / (first[1:] - first[:-1] - 1)[:, None]
    most = np.maximum.reduceat(chunk, spans, axis=0)[::2]
    return np.hstack([total, most])


def train(texts: Sequence[bytes], labels: Sequence[int], prior: float, seed: int = 5) -> Network:
    """Fit by Adam on balanced labels; the same rows give the same network."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.1, (2 * PAIRS, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.3, (2 * FILTERS, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32),
        rng.normal(0, 0.3, HIDDEN).astype(np.float32), 0.0, prior,
    )
    names = ["table", "bias", "w1", "b1", "w2", "b2"]
    moment = {n: (np.zeros_like(np.asarray(getattr(net, n))), np.zeros_like(np.asarray(getattr(net, n)))) for n in names}
    labels, step = np.asarray(labels, np.float32), 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            picked = order[at : at + BATCH]
            data, first = _laid_out([texts[i] for i in picked])
            act = _activations(data, _pair_tables(net)).reshape(-1, STEP, FILTERS)
            place = act.argmax(axis=1)
            place[first[1:] - 1] = 0  # the step behind a text holds padding only; its end would see the next text
            raw = np.take_along_axis(act, place[:, None], axis=1)[:, 0] + net.bias
            pooled = np.maximum(raw, 0)
            described = _described(pooled, first)
            hidden, logit = _dense(net, described)
            # gradients, from the loss back to the filters
            d_logit = (1 / (1 + np.exp(-logit)) - labels[picked]) / len(picked)
            d_hidden = np.outer(d_logit, net.w2) * (1 - hidden**2)
            d_described = d_hidden @ net.w1.T
            chunks = first[1:] - first[:-1] - 1
            owner = np.repeat(np.arange(len(picked)), chunks + 1)
            steps = np.arange(len(owner))
            inside = steps < (first[1:] - 1)[owner]
            chunk = np.maximum(pooled, np.r_[pooled[1:], pooled[-1:]])
            d_chunk = d_described[owner, :FILTERS] / chunks[owner, None]
            d_chunk += d_described[owner, FILTERS:] * (chunk == described[owner, FILTERS:])
            d_chunk *= inside[:, None]
            left = pooled >= np.r_[pooled[1:], pooled[-1:]]
            d_pooled = d_chunk * left
            d_pooled[1:] += (d_chunk * ~left)[:-1]
            d_pooled *= raw > 0
            d_table = np.zeros_like(net.table)
            where = (steps[:, None] * STEP + place).ravel()
            col = np.tile(np.arange(FILTERS), len(steps))
            for k in range(2 * PAIRS):
                np.add.at(d_table[k], (data[where + k], col), d_pooled.ravel())
            grads = {
                "table": d_table, "bias": d_pooled.sum(axis=0), "w1": described.T @ d_hidden, "b1": d_hidden.sum(axis=0),
                "w2": hidden.T @ d_logit, "b2": d_logit.sum(),
            }
            step += 1
            for n, g in grads.items():
                m, v = moment[n]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                change = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                setattr(net, n, (getattr(net, n) - change).astype(np.float32) if n != "b2" else float(net.b2 - change))
    return net


class Scorer:
    """Probability of label 1 for whole texts."""

    def __init__(self, net: Network):
        self.net, self.pairs = net, _pair_tables(net)

    def _pooled(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        parts = []
        for at in range(0, len(data) - 2 * PAIRS, BLOCK):
            act = _activations(data[at : min(at + BLOCK, len(data) - 2 * PAIRS) + 2 * PAIRS], self.pairs)
            parts.append(act.reshape(-1, STEP, FILTERS).max(axis=1))
        act = np.concatenate(parts)
        act[first[1:] - 1] = self.pairs[:, 0].sum(axis=0)  # the step behind a text holds padding only
        return np.maximum(act + self.net.bias, 0)

    def scores(self, texts: Sequence[bytes]) -> np.ndarray:
        out, at = np.zeros(len(texts)), 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= 8 * BLOCK):
                size += len(texts[end])
                end += 1
            data, first = _laid_out(texts[at:end])
            logit = _dense(self.net, _described(self._pooled(data, first), first))[1] + self.net.prior
            out[at:end] = 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -500, 500)))
            at = end
        return out


@dataclass
class Model:
    """A network, or a constant where nothing could be learned."""

    net: Network | None
    share: float


def learn(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
    rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS,
) -> Model:
    """Fit on up to ``rows`` rows of each label, and ``chars`` characters of each, chosen by a hash of the id."""
    marked = (
        labels.select(own(labels, doc_id).alias("doc_id"), own(labels, label).alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
        .distinct()
        .withColumn("turn", F.xxhash64("doc_id", F.lit("quality")))
    )
    count = {r.label: r["count"] for r in marked.groupBy("label").count().collect()}
    share = count.get(1, 0) / sum(count.values()) if count else 1.0
    if len(count) < 2:
        return Model(None, share)
    # ids only, a few times `rows` per label, since some may have no text
    of_label = F.when(F.col("label") == 1, F.lit(count[1])).otherwise(F.lit(count[0]))
    by_turn = W.partitionBy("label").orderBy("turn", "doc_id")
    some = marked.filter(thinned(F.col("turn"), 2 * rows, of_label)).withColumn("place", F.row_number().over(by_turn))
    ids = some.filter(F.col("place") <= 4 * rows).select("doc_id", "label", "turn")
    texts = docs.select(own(docs, doc_id).alias("doc_id"), F.coalesce(own(docs, text), F.lit("")).alias("text"))
    met = texts.join(F.broadcast(ids), "doc_id").withColumn(
        "text", piece(F.col("text"), chars, F.xxhash64("doc_id", F.lit("piece")))
    )
    place = F.row_number().over(W.partitionBy("label").orderBy("turn", "doc_id", "text"))
    some = met.withColumn("place", place).filter(F.col("place") <= rows)
    sample = sorted((r.turn, r.text, r.label) for r in some.collect())
    kinds = [r[2] for r in sample]
    if len(set(kinds)) < 2:
        return Model(None, share)
    drawn = math.log(sum(kinds) / (len(kinds) - sum(kinds)))
    prior = math.log(count[1] / count[0]) - drawn
    return Model(train([r[1].encode("utf-8", "replace") for r in sample], kinds, prior), share)


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = docs.select(
        own(docs, doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), own(docs, text).cast("string").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.net) if model.net else None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                if scorer:
                    # the buffer of an Arrow string is UTF-8 already
                    texts = [t or b"" for t in part.column(2).cast(pa.binary()).to_pylist()]
                    p = scorer.scores(texts)
                else:
                    p = np.full(part.num_rows, model.share)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
