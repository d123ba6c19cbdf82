"""Mixing to targets, exact search, and the pipeline."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from perinuc.llm import exact_dedup, language_id, mixing, simhash, top_k
from perinuc.llm.common import joined_with_hot

CLASH = "doc_id long, text string, lang string, source string, size string, taken string, copies string, `row` int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, "a", "b", "c", 1) for i, t, s in rows], CLASH)


def plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    goal, full = Fraction(sum(sizes.values()) * 3, 2), set()
    while True:
        rest = [s for s in names if s not in full]
        left = goal - sum(2 * sizes[s] for s in full)
        per = left / sum(weight[s] for s in rest) if rest else 0
        over = {s for s in rest if per * weight[s] > 2 * sizes[s]}
        if not over:
            return {s: float(2 * sizes[s] if s in full else per * weight[s]) for s in names}
        full |= over


def mix_rows():
    rng = random.Random(1)
    rows = [(k, "w " * rng.randint(0, 40), rng.choice(["a", "a", "a", "B", "c", "é", "", None])) for k in range(3000)]
    return rows + [(None, "x y", "a"), (None, "x y", "a"), (5, "x y z", "a"), (9000, None, "c"), (9001, "big " * 9000, "B")]


@pytest.mark.parametrize("group", [16, 4096])
def test_mix(spark, group):
    rows = mix_rows()
    df = docs(spark, rows)
    got = mixing.mix(df, group=group).collect()
    assert len(got) == len(rows)
    sizes, taken, largest = defaultdict(int), Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    goals = plain_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goals[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        assert abs(r.copies - r.target / r.source_size) < 1
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s, goal in goals.items():
        assert abs(taken[s] - goal) <= largest[s] + 1e-6
    df = df.filter("doc_id is not null")  # without an id, a row is known by its place only
    first, again = mixing.mix(df, group=group).collect(), mixing.mix(df.repartition(3), group=group).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in first) == Counter((r.doc_id, r.size, r.taken) for r in again)


def test_pivot_keeps_words_and_expectations():
    rng = np.random.default_rng(3)
    size, part = [3, 8, 1, 20, 5, 5], [0.25, 0.5, 0.9, 0.1, 0.0, 0.6]
    total, rounds = np.zeros(6), 20_000
    for _ in range(rounds):
        out, held = mixing.pivot(size, part, rng.random(6).tolist())
        assert np.dot(size, out) == pytest.approx(np.dot(size, part))
        assert all(p in (0.0, 1.0) for k, p in enumerate(out) if k != held)
        total += out
    assert total / rounds == pytest.approx(part, abs=0.02)


def test_mixed_documents(spark):
    rows = mix_rows()
    df = docs(spark, rows)
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    want = Counter()
    for r in mixing.mix(df).collect():
        want[(r.doc_id, r.source)] += r.copies
    assert Counter((r.doc_id, r.source) for r in got.collect()) == +want


def test_mix_of_nothing(spark):
    none = docs(spark, [])
    assert mixing.mix(none).count() == mixing.mixed_documents(none).count() == 0
    blank = docs(spark, [(1, None, None), (2, "", "a")])
    assert [(r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0.0, 0)] * 2


def test_mix_query(spark):
    got = entry.queries()["op4_mix_sources"](spark, "/root/testdata/sf0.01").collect()
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    sizes, size = defaultdict(int), {}
    for r in rows:
        size[r.doc_id] = len((r.text or "").split())
        sizes[r.source] += size[r.doc_id]
    goals, source = plain_targets(sizes), {r.doc_id: r.source for r in rows}
    taken = Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.target == pytest.approx(goals[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - goals[s]) <= max(size.values()) for s in goals)


# search


def plain_top(rows, k=5):
    good = [(i, [int(np.floor(256 * x)) for x in map(float, v)], n) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for qi, q, n in good:
        if qi % 50 == 0:
            scores = [(-sum(a * b for a, b in zip(q, v)), i) for i, v, m in good if m != n and len(v) == len(q)]
            out += [(qi, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, label int, dim string, `row` string")


def search_rows(n=1500):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] + rng.normal(0, 0.1, 8)
        v *= rng.choice([0.1, 1.0, 1.0, 5.0]) / np.linalg.norm(v)
        rows.append((i, [float(np.float32(x)) for x in v]))
    rows += [(50 * 40 + k, rows[3][1]) for k in range(0, 300)]  # a large group of equal vectors
    return rows + [
        (5000, None), (5050, [1.0, None, 2.0]), (5100, [float("nan")] * 8), (5150, [float("inf")] * 8), (None, rows[0][1]),
        (5200, [0.0] * 8), (5250, [1.0, 2.0]), (5300, [3.0, -1.0]), (5350, []), (5400, []), (100, rows[100][1]), (5450, [1e6] * 8),
    ]


@pytest.mark.parametrize("block", [64, 4096])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(top_k, "QUERIES", 16)
    rows = search_rows()
    got = sorted(map(tuple, top_k.top_k(vectors(spark, rows), block=block).collect()))
    assert got == plain_top(rows)


def test_top_k_of_values_beyond_64_bits(spark):
    """Components and scores past 63 bits are held at the ends; the others stay exact beside them."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=3) * rng.choice([1, 1e6, 1e12, 1e30])]) for i in range(300)]
    got = sorted(map(tuple, top_k.top_k(vectors(spark, rows), block=64).collect()))
    ends = -(1 << 63), (1 << 63) - 1
    held = lambda s: min(max(s, ends[0]), ends[1])
    data = [(i, [held(int(np.floor(256 * x))) for x in v]) for i, v in rows]
    want = []
    for qi, q in data:
        if qi % 50 == 0:
            best = sorted((-held(sum(a * b for a, b in zip(q, v))), i) for i, v in data if i != qi)[:5]
            want += [(qi, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    assert got == sorted(want) and any(r[3] == ends[1] for r in got)


def test_coordinate_ranges_lose_nothing():
    rng = np.random.default_rng(6)
    q = rng.normal(size=6)
    q /= np.linalg.norm(q)
    x = rng.normal(size=(20_000, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    cosine = x @ q
    for c in (0.2, 0.6, 0.95, -0.5):
        for f in range(6):
            low, high = top_k._range(q[f], c)
            near = x[cosine >= c][:, f]
            assert (near >= low).all() and (near <= high).all()


def test_top_k_of_nothing(spark):
    assert top_k.top_k(vectors(spark, [])).count() == 0
    assert top_k.top_k(vectors(spark, [(50, [1.0])])).count() == 0


# pipeline


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = Counter(r.doc_id for r in docs.select("doc_id").collect())
        if k < 4:
            assert all(tuple(r) == tuple(rows[r.doc_id]) for r in docs.collect())
    # language: texts with a letter
    left = [i for i, r in sorted(rows.items()) if r.text and any(c.isalpha() for c in r.text)]
    assert seen["language"] == Counter(left)
    # exact copies: the smallest id per normalised text
    first = {}
    for i in left:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i].text), i)
    left = sorted(first.values())
    assert seen["exact_dedup"] == Counter(left)
    # near copies: the smallest id per component of fingerprints
    fps, label = [simhash.fingerprint(rows[i].text) for i in left], {i: i for i in left}
    for a, i in enumerate(left):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2 and label[i] != label[left[b]]:
                old, new = sorted((label[i], label[left[b]]), reverse=True)
                label = {j: new if c == old else c for j, c in label.items()}
    left = sorted(i for i in left if label[i] == i)
    assert seen["near_dedup"] == Counter(left)
    # mix: every source's words are within one document of its target
    sizes = defaultdict(int)
    for i in left:
        sizes[rows[i].source] += len(rows[i].text.split())
    for s, goal in plain_targets(sizes).items():
        own = [i for i in left if rows[i].source == s]
        words = {i: len(rows[i].text.split()) for i in own}
        assert abs(sum(words[i] * seen["mix"][i] for i in own) - goal) <= max(words.values())
        assert all(0 <= seen["mix"][i] <= 2 for i in own)
    # tokens: those of the library, once per copy
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(library.encode(rows[i].text, add_special_tokens=False).ids) for i in seen["mix"]}
    assert seen["tokens"] == seen["mix"] and all(r.n_tokens == want[r.doc_id] for r in docs.collect())
    whole = Counter(r.doc_id for r in entry.queries()["pipeline"](spark, sf).select("doc_id").collect())
    assert whole == seen["tokens"]


def test_hot_keys_are_joined_like_others(spark):
    rows = spark.createDataFrame([(k, "hot" if k % 2 else f"k{k % 20}") for k in range(1000)] + [(-1, None)], "n int, key string")
    lookup = spark.createDataFrame([("hot", 500, "a"), ("k0", 50, "b"), ("k2", 50, None), ("x", 1, "c")], "key string, size long, v string")
    got = {r.n: (r.key, r.v) for r in joined_with_hot(rows, lookup, "key", "size", 1001, most=4).collect()}
    known = {"hot": "a", "k0": "b"}
    assert len(got) == 1001 and all(v == known.get(key) for key, v in got.values())


def test_stages_of_empty_and_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, "ein wort", "de", None, 8), (2, "ein wort", "de", "s", 8), (2, "ein  wort", "de", "s", 8)]
    for docs in (spark.createDataFrame([], schema), spark.createDataFrame(rows, schema)):
        for stage in (language_id.known_language, exact_dedup.drop_copies, simhash.one_of_each, mixing.mixed_documents):
            docs = stage(docs)
        docs.collect()
