"""Repeated passages against all windows of 50 words."""

import random
from collections import Counter

from perinuc.llm import repeats


def brute(rows):
    count = Counter()
    for _, t in rows:
        w = (t or "").split()
        count.update(tuple(w[k : k + 50]) for k in range(len(w) - 49))
    out = {}
    for i, t in rows:
        w = (t or "").split()
        starts = [k for k in range(len(w) - 49) if count[tuple(w[k : k + 50])] > 1]
        if starts:
            out.setdefault(i, set()).update(starts)
    return {i: ",".join(f"{a}:{b}" for a, b in repeats._joined((k, k) for k in s)) for i, s in out.items()}


def test_exactly_the_repeated_windows(spark):
    rng = random.Random(4)
    word = lambda n: [rng.choice("abcdefghij") + str(rng.randint(0, 300)) for _ in range(n)]
    rows, shared = [(0, None), (1, ""), (2, "few words"), (3, "x " * 200), (None, "y " * 60)], [word(n) for n in (49, 50, 51, 60, 75, 130)]
    for k in range(40):
        text = word(rng.randint(0, 80))
        for p in rng.sample(shared, rng.randint(0, 2)):
            text += p + word(rng.randint(0, 60))
        rows.append((10 + k, " ".join(text)))
    rows += [(100, rows[20][1]), (101, rows[20][1]), (101, rows[20][1])]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, spans string, key int")
    got = {r.doc_id: r.spans for r in repeats.repeated_passages(df).collect()}
    assert got == brute(rows) and len(got) > 20
    assert repeats.repeated_passages(df.limit(0)).count() == 0


def test_rows_without_an_id_and_with_the_same_id_are_told_apart(spark):
    rng = random.Random(2)
    word = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    one, two = word(50), word(60)
    rows = [(1, " ".join(one)), (2, " ".join(two)), (None, " ".join(word(11) + one)), (None, " ".join(two)), (5, " ".join(word(3) + one)), (5, " ".join(two + word(9)))]
    got = repeats.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.spans) for r in got), key=repr) == sorted(
        [(1, 50, "0:50"), (2, 60, "0:60"), (None, 50, "11:61"), (None, 60, "0:60"), (5, 50, "3:53"), (5, 60, "0:60")], key=repr
    )


def test_long_shared_footers_below_a_passage_give_no_span(spark):
    rng = random.Random(7)
    word = lambda n: [rng.choice("abcdefghij") + str(rng.randint(0, 10**12)) for _ in range(n)]
    footer, passage = word(49), word(50)
    rows = [(k, " ".join(word(40) + footer + word(40))) for k in range(1500)]
    rows += [(k, " ".join(word(40) + passage + word(40))) for k in range(2000, 2100)]
    rows += [(3000, rows[0][1]), (3001, "a " + rows[0][1] + " b"), (None, rows[1501][1])]
    got = {r.doc_id: r.spans for r in repeats.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and sorted(i for i in got if i is not None and i < 2000) == [0]
