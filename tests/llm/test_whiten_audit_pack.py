"""Whitening, filter audit and packing against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from perinuc.llm import bin_plans, filter_audit, packing, whitening

VECTORS = "vec_id long, embedding array<float>, x string, at int, vector int, index string, `a.b` int"


def vectors(spark, rows):
    """Embeddings with extra columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, v, "x", 1, 2, "y", 3) for i, v in rows], VECTORS)


def expected_whitening(rows, components=16):
    """For each length: n, deviation by vector, eigenvalues and unit eigenvectors, by plain whole numbers."""
    out = {}
    for dim in {len(v) for _, v in rows}:
        xs = [tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for _, v in rows if len(v) == dim]
        fit = np.array(sorted(set(xs)), dtype=object)
        n, sums = len(fit), fit.sum(axis=0)
        gap = {x: (n * np.array(x, dtype=object) - sums) for x in xs}
        centred = np.array([gap[tuple(x)] for x in fit]).astype(float) / n
        value, vector = np.linalg.eigh(centred.T @ centred / n)
        out[dim] = (n, gap, value[::-1][:components], vector[:, ::-1][:, :components], value.sum())
    return out


@pytest.mark.parametrize("row_block,column_block", [(4096, 1024), (7, 3)])
def test_whitening_equals_plain_linear_algebra(spark, row_block, column_block):
    rng = np.random.default_rng(3)
    turn = rng.normal(size=(8, 8))
    rows = [(i, (rng.normal(size=8) @ turn).astype(np.float32).tolist()) for i in range(120)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)] + [(7, rows[8][1]), (None, rows[9][1])]
    bad = [(1, None), (2, [1.0] * 7 + [None]), (3, [float("nan")] * 8), (4, [float("inf")] + [0.0] * 7), (5, [])]
    got = whitening.whiten(vectors(spark, rows + bad).repartition(5), row_block=row_block, column_block=column_block).collect()
    n, gap, value, vector, trace = expected_whitening(rows)[8]
    assert len(got) == 8 * len(rows) and {r.n for r in got} == {n}
    by_id = defaultdict(list)
    for r in got:
        by_id[r.vec_id].append(r)
    assert len(by_id[7]) == 16 and len(by_id[None]) == 8
    sign = {}
    for i, v in rows:
        x = tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)
        want = (gap[x].astype(float) / n) @ vector / np.sqrt(value)
        for r in by_id[i]:
            if i == 7:
                continue
            c = r.component - 1
            assert r.deviation == sum(int(g) ** 2 for g in gap[x])
            assert r.explained == pytest.approx(value[c] / trace, rel=1e-9)
            s = sign.setdefault(c, math.copysign(1, r.whitened * want[c]) if abs(want[c]) > 1e-6 else None)
            if s is None:
                del sign[c]
            else:
                assert r.whitened == pytest.approx(s * want[c], abs=1e-8)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whitening_of_lengths_without_variance_and_of_nothing(spark):
    rows = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [1.0, 2.0, 3.0]), (4, [2.0, 2.0, 3.0]), (5, [4.0, 2.0, 3.0]), (6, [9.0])]
    got = {(r.vec_id, r.component): r for r in whitening.whiten(vectors(spark, rows)).collect()}
    assert len(got) == 2 * 2 + 3 * 3 + 1
    # equal vectors, and a single one, have no variance at all
    for key in [(1, 1), (2, 2), (6, 1)]:
        assert got[key].whitened is None and got[key].explained is None and got[key].deviation == 0
    # one dimension varies: the other components have no variance, and count for nothing
    assert got[3, 1].explained == pytest.approx(1.0) and got[3, 2].whitened is None and got[3, 2].explained == pytest.approx(0)
    assert abs(got[5, 1].whitened) == pytest.approx((4 - 7 / 3) / np.std([1, 2, 4]))
    none = whitening.whiten(vectors(spark, []))
    assert none.count() == 0 and none.columns[:2] == ["vec_id", "component"]


def test_whitening_of_large_entries(spark):
    big = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [1e9, 0.5]), (4, [2e9, 0.25])]
    assert {r.deviation for r in whitening.whiten(vectors(spark, big)).collect()} == {None}
    # one entry needs more than 64 bits on the way, the sum of the squares does not fit either; the others are exact
    rows = [(i, [float(i), 1.0]) for i in range(5)] + [(9, [2.0**30, 0.0])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(vectors(spark, rows)).collect()}
    _, gap, *_ = expected_whitening(rows)[2]
    for x, g in gap.items():
        d = sum(int(v) ** 2 for v in g)
        i = next(i for i, v in rows if tuple(math.floor(64 * c) + 1_000_000 for c in v) == x)
        assert got[i] == (d if d < 1 << 63 else None)


# ---- filters ------------------------------------------------------------------------------

DOCS = "doc_id long, text string, source string, part string, row int, fails int, step int, `a.b` int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, "p", 1, 2, 3, 4) for i, t, s in rows], DOCS)


def fails(i, text, rows):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    copies = [j for j, t, _ in rows if (t or "") == text and j is not None]
    return {
        name
        for name, failed in zip(
            "ABCDE",
            (
                len(words) < 200,
                100 * len(set(words)) < 50 * len(words),
                100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
                bool(re.search(r"[#$%&*|]", text)),
                bool(copies) and (i is None or i > min(copies)),
            ),
        )
        if failed
    }


def expected_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for i, t, s in rows:
        parts[s or ""].append((fails(i, t, rows), i in good, i in toxic))
    out = set()
    for part, found in parts.items():
        removed, lines = Counter(), []
        for order in permutations("ABCDE"):
            left = list(found)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                removed[f] += len(gone)
                lines.append((f, ("".join(order), step, len(left), len(gone), sum(f in d[0] for d in found) - len(gone),
                              sum(d[0] == {f} for d in found), sum(d[1] for d in gone), sum(d[2] for d in gone))))
        out |= {(part, *line, removed[f]) for f, line in lines}
    return out


def text_of(rng):
    n = rng.choice([0, 1, 5, 199, 200, 201, 400])
    words = [rng.choice(["word", f"w{rng.randrange(300)}", "Ärger", "x" * 9]) for _ in range(n)]
    if rng.random() < 0.3:
        words = [w.upper() if rng.random() < 0.2 else w for w in words]
    if rng.random() < 0.3:
        words.append(rng.choice("#$%&*|"))
    return rng.choice([" ", "\n", "\x0b "]).join(words)


def test_audit_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    texts = [text_of(rng) for _ in range(60)] + [None, "", " ", "long word " * 40_000, "a\x85b c"]
    sources = ["hot"] * 6 + ["cold", "", None]
    rows = [(rng.choice([None, *range(150)]), rng.choice(texts), rng.choice(sources)) for _ in range(240)]
    labels = [(rng.choice([None, *range(150)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(160)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = expected_audit(rows, labels)
    monkeypatch.setattr(filter_audit, "RANGE", 3)  # ranges of eight rows, so every part has many
    got = filter_audit.audit(documents(spark, rows).repartition(3), table).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(documents(spark, []), labels).count() == 0
    one = filter_audit.audit(documents(spark, [(1, None, None)]), labels).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and {tuple(r) for r in one} == expected_audit([(1, None, None)], [])


def test_galloping_merges():
    rng = random.Random(1)
    for _ in range(300):
        lists = [sorted(rng.sample(range(60), rng.randrange(0, 40))) for _ in range(rng.randrange(0, 6))]
        assert filter_audit.union(lists) == sorted(set().union(*lists))
        a, b = ([*lists, [], []])[:2]
        assert filter_audit.difference(a, b) == sorted(set(a) - set(b))
        assert filter_audit.shared(a, b) == len(set(a) & set(b))


# ---- packing ------------------------------------------------------------------------------

FILE = public_tokenizers.path("byte_bpe_50k.json")


def expected_pieces(texts, size):
    tokenizer = Tokenizer.from_file(FILE)
    out = Counter()
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) if len(ids) <= size else len(ids) % size or size
        start, stop, piece = 0, first, 0
        while start < len(ids):
            out[i, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())] += 1
            start, stop, piece = stop, stop + size, piece + 1
    return out


def held(rows, size):
    """Every sequence is gapless and within the size; returns how many there are."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing_holds_every_piece_once(spark):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice(["the", "Größe", "zebra", "1234", "§$%"]) for _ in range(int(rng.lognormvariate(4, 1.5))))) for i in range(300)]
    texts += [(3, "again"), (None, "no id"), (None, None), (400, ""), (401, "a" * 50_000), (402, "<|endoftext|> x"), (403, "😀  \n\n  end ")]
    texts += [(1000 + i, "copy of a text") for i in range(500)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in texts], "doc_id long, text string, piece int, _row int, `a.b` int").repartition(6)
    got = packing.packed_documents(docs, FILE, size=64).collect()
    want = expected_pieces(texts, 64)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    used = held(got, 64)
    total = sum(k[3] * n for k, n in want.items())
    assert -(-total // 64) <= used <= 1.02 * total / 64 + 2


def test_packed_sequences_hold_the_tokens(spark):
    texts = [(i, "word " * (i * 7 % 50)) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    packed = packing.packed_documents(docs, FILE, size=32, tokens=True)
    rows = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    tokenizer = Tokenizer.from_file(FILE)
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in texts}
    for r in packed.collect():
        assert rows[r.sequence_id][r.offset : r.offset + r.length] == ids[r.doc_id][r.start : r.start + r.length] == r.ids


@pytest.mark.parametrize("texts", [[], [(1, None)], [(1, "a b c d e f g h i j")], [(i, "one two three four five six") for i in range(9)]])
def test_packing_of_few(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = packing.packed_documents(docs, FILE, size=8).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected_pieces(texts, 8)
    held(got, 8)


def test_encoder_gives_the_library_s_ids():
    encoder, library = packing.ByteEncoder(FILE), Tokenizer.from_file(FILE)
    assert encoder.quick is not None
    # one code point of every 64, beside letters, digits and white space, and white space that the quick path gives up on
    texts = [f"a{chr(c)}b {chr(c)}1 {chr(c)}" for c in range(0, 0x110000, 64) if not 0xD800 <= c < 0xE000]
    texts += [" " * 1_000_000, "\n\t" * 1000, "ab" * 30_000, "<|endoftext|>" * 3, " <|endoftext|>\n<|endof", "it's I'LL 's"]
    assert [encoder.encode(t) for t in texts] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def best_number(lengths, size):
    """Fewest bins by trying all ways, for a handful of pieces."""
    best = len(lengths)

    def place(i, free):
        nonlocal best
        if len(free) >= best:
            return
        if i == len(lengths):
            best = len(free)
            return
        for j in sorted(set(free)):
            if j >= lengths[i]:
                k = free.index(j)
                place(i + 1, free[:k] + [j - lengths[i]] + free[k + 1 :])
        place(i + 1, free + [size - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


def test_configurations_are_near_the_best():
    rng = random.Random(9)
    for _ in range(60):
        size, lengths = 20, [rng.randrange(6, 20) for _ in range(rng.randrange(1, 10))]
        count = Counter(lengths)
        order = sorted(count, reverse=True)
        sizes, demand = bin_plans.groups(order, [count[n] for n in order], 100)
        plan = bin_plans.configurations(sizes, demand, size)
        assert sum(p * n for p, n in plan).tolist() == demand
        assert all(int(p @ np.array(sizes)) <= size for p, _ in plan)
        assert best_number(lengths, size) <= sum(n for _, n in plan) <= best_number(lengths, size) + 1


def test_groups_round_up_within_equal_cardinality():
    sizes, demand = bin_plans.groups([9, 8, 7, 5], [1, 4, 2, 3], 4)
    # ten pieces in groups of three: 9 8 8 | 8 8 7 | 7 5 5 | 5
    assert (sizes, demand) == ([9, 8, 7, 5], [3, 3, 3, 1])


@pytest.mark.parametrize("name", ["op11_whitening", "op12_filter_audit", "op13_packing"])
def test_registered(name):
    assert name in entry.queries()
