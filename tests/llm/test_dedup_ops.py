"""Exact and near duplicates against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import __spark_entry__ as entry
from perinuc.llm import exact_dedup, simhash

SCHEMA = "doc_id long, text string, lang string, source string, kept string, digest string, fp string, _row int, `a.b` int"


def docs(spark, rows):
    """Documents with extra columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, "en", "s", "x", "y", "z", 1, 2) for i, t in rows], SCHEMA)


ROWS = [
    (5, "a  b"), (3, "a\tb"), (9, "a b"), (3, "a b"), (None, "a b"), (7, None), (2, ""), (4, " "), (8, "  \n"),
    (None, "only"), (None, "only"), (11, "long " * 50_000), (10, "long\n" * 50_000), (12, "Ä b"), (13, "a\xa0b"),
]


def expected_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        first = sorted(ids, key=lambda i: (i is None, i or 0))
        out += [(i, keep, len(ids), n == 0, digest) for n, i in enumerate(first)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("counters", [1, 2, 4096])
def test_exact_groups(spark, counters):
    df = docs(spark, ROWS).repartition(5)
    got = exact_dedup.exact_groups(df, counters=counters).collect()
    assert sorted(map(tuple, got), key=repr) == expected_groups(ROWS)


def test_hot_group_is_settled_before_the_shuffle(spark):
    rows = [(i, "hot") for i in range(2000)] + [(10_000 + i, f"cold {i // 2}") for i in range(4000)]
    df = docs(spark, rows).repartition(7)
    base = exact_dedup.digest_rows(df, "text", "doc_id")
    found = exact_dedup.winners(base, 6000, counters=10).collect()
    assert [(r["first"].id, r.group_size) for r in found] == [(0, 2000)]
    got = exact_dedup.exact_groups(df, counters=10).collect()
    assert sorted(map(tuple, got), key=repr) == expected_groups(rows)


def test_misra_gries_never_loses_a_heavy_digest():
    rng = random.Random(2)
    for _ in range(50):
        stream = [rng.choice(b"aaaabbbcdefghijkl").to_bytes() for _ in range(500)]
        batches = [pa.RecordBatch.from_arrays([pa.array(stream[k : k + 60])], ["digest"]) for k in range(0, 500, 60)]
        held = exact_dedup.misra_gries(batches, 4)
        assert len(held) <= 4
        for value in set(stream):
            true = stream.count(value)
            assert true - 500 / 5 <= held.get(value, 0) <= true


@pytest.mark.parametrize("counters", [2, 4096])
def test_drop_copies_keeps_one_whole_row(spark, counters):
    df = docs(spark, ROWS)
    got = exact_dedup.drop_copies(df, counters=counters)
    assert got.columns == df.columns
    assert sorted(repr(r.doc_id) for r in got.collect()) == sorted(["3", "None", "2", "4", "10", "12", "13"])


def test_empty_tables(spark):
    none = docs(spark, [])
    assert exact_dedup.exact_groups(none).count() == exact_dedup.drop_copies(none).count() == 0
    assert simhash.near_duplicates(none).count() == simhash.one_of_each(none).count() == 0


# near duplicates


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[k : k + 3]) for k in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(keys, budget=2):
    label = list(range(len(keys)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if (keys[i] ^ keys[j]).bit_count() <= budget:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(keys))]


def test_fingerprints():
    rng = random.Random(4)
    texts = [None, "", " \n", "one", "One two", "a b c", "Ä\xa0b C d", "x " * 700]
    texts += [" ".join(rng.choice(["alpha", "Beta", "gamma", "é"]) for _ in range(rng.randint(1, 900))) for _ in range(30)]
    for text in texts:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def clustered_keys(rng, n):
    keys = {0, 2**64 - 1}
    while len(keys) < n:
        base = rng.choice(list(keys)) if rng.random() < 0.7 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randint(0, 4)):
            base ^= 1 << b
        keys.add(base)
    return sorted(keys)


def test_trie_links_are_all_links():
    rng = random.Random(6)
    for n in (2, 40, 700):
        keys = clustered_keys(rng, n)
        key = np.array(keys, np.uint64)
        zero = np.array([0])
        i, j = simhash.trie_links(key, zero, np.array([n]), np.array([n]), zero, zero)
        got = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
        assert got == {(a, b) for b in range(n) for a in range(b) if (keys[a] ^ keys[b]).bit_count() <= 2}


@pytest.mark.parametrize("node", [3, 4096])
def test_trie_join_reaches_every_component(spark, node):
    keys = clustered_keys(random.Random(8), 300)
    signed = [(k - (k >> 63 << 64),) for k in keys]
    roots = {r.u: r.v for r in simhash.star_roots(simhash.trie_join(spark.createDataFrame(signed, "fp long"), node=node)).collect()}
    got = [roots.get(k[0], k[0]) for k in signed]
    want = plain_components(keys)
    assert len({(a, b) for a, b in zip(got, want)}) == len(set(got)) == len(set(want))


def near_rows():
    rng = random.Random(10)
    words = [f"w{k}" for k in range(400)]
    rows, base = [], [" ".join(rng.choice(words) for _ in range(200)) for _ in range(6)]
    for n in range(120):
        text = rng.choice(base).split(" ")
        if n % 3:
            text[rng.randrange(200)] = "changed"
        rows.append((1000 - n, " ".join(text)))
    return rows + [(2000, None), (1500, ""), (None, base[0]), (None, "alone with null"), (3000, "x"), (3000, "x")]


def test_near_duplicates_against_brute_force(spark):
    rows = near_rows()
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    label = plain_components(fps)
    low = {c: min((i for (i, _), k in zip(rows, label) if k == c and i is not None), default=None) for c in label}
    want = sorted((repr(i), f, repr(low[c])) for (i, _), f, c in zip(rows, fps, label))
    assert sorted((repr(r.doc_id), r.fp % 2**64, repr(r.component_id)) for r in got) == want


def test_one_of_each(spark):
    """One row per component, also with null ids, ids that stand in two components, and rows that are equal throughout."""
    base = near_rows()
    rows = base + [(None, t) for _, t in base[:6]] + [(i, base[k + 9][1]) for k, (i, _) in enumerate(base[:6])] + base[3:5] * 3
    rows += [(None, "only here"), (None, "only here"), (None, "only there, without a like")]
    df = docs(spark, rows).repartition(4)
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    fps = [plain_fingerprint(t) for _, t in rows]
    want = {}
    for (i, t), label in zip(rows, plain_components(fps)):
        order = (i is None, i or 0, hashlib.sha256((t or "").encode()).hexdigest())
        if label not in want or order < want[label][0]:
            want[label] = (order, (i, t or ""))
    kept = sorted(((r.doc_id, r.text or "") for r in got.collect()), key=repr)
    assert kept == sorted((row for _, row in want.values()), key=repr) and len(kept) < len(rows) / 2


def test_registered_near_duplicates(spark):
    got = entry.queries()["op8_simhash"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[i]) for i in ids]
    label = plain_components(fps)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {
        i: (f"{f:016x}", ids[c]) for i, f, c in zip(ids, fps, label)
    }
