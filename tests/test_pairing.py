"""Pairing: ties, competition, missing centroids, long chains, against a plain loop."""

import math
import random

import pytest

from perinuc.operators import pairing as pr
from perinuc.operators import sets as st

BOX = "fov_id string, ne_label string, ord int, final_left int, final_top int, final_right int, final_bottom int, cy double, cx double"


def box(ne, left, top, fov="1", size=75, centroid=True):
    c = (top + size / 2, left + size / 2) if centroid else (None, None)
    return (fov, ne, int(ne[1:]), left, top, left + size, top + size, *c)


def iou(a, b):
    w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
    if w < 0 or h < 0:
        return 0.0
    return w * h / ((a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - w * h)


def loop(a_rows, b_rows, min_iou=0.7, max_dist=10.0):
    pairs, used = [], set()
    for a in a_rows:
        best, top = None, 0.0
        for b in b_rows:
            if b[1] in used or a[7] is None or b[7] is None or a[0] != b[0]:
                continue
            d = math.sqrt((a[7] - b[7]) ** 2 + (a[8] - b[8]) ** 2)
            o = iou(a, b)
            if o >= min_iou and d <= max_dist and o / (1 + d) > top:
                best, top = b[1], o / (1 + d)
        if best:
            pairs.append((a[1], best))
            used.add(best)
    return sorted(pairs)


def test_greedy_pair_equals_the_loop(spark):
    rng = random.Random(5)
    a = [box(f"a{i}", rng.randint(0, 60), rng.randint(0, 60), centroid=i != 4) for i in range(40)]
    b = [box(f"b{i}", rng.randint(0, 60), rng.randint(0, 60)) for i in range(40)]
    got = pr.greedy_pair(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX))
    rows = sorted((r.ch1_label, r.ch2_label) for r in got.collect())
    assert rows == loop(a, b) and len(rows) > 10


def test_two_nuclei_that_want_the_same_partner(spark):
    a = spark.createDataFrame([box("a1", 0, 0), box("a2", 1, 0)], BOX)
    b = spark.createDataFrame([box("b1", 1, 0)], BOX)
    assert [(r.ch1_label, r.ch2_label) for r in pr.greedy_pair(a, b).collect()] == [("a1", "b1")]


def test_best_match_prefers_the_first_of_equals_and_may_repeat(spark):
    a = spark.createDataFrame([box("a1", 0, 0), box("a2", 0, 0), box("a3", 500, 0)], BOX)
    b = spark.createDataFrame([box("b2", 0, 0), box("b1", 0, 0), box("b3", 75, 0)], BOX)
    got = sorted((r.ch1_label, r.ch2_label, r.iou) for r in pr.iou_best_match(a, b, 0.5).collect())
    assert got == [("a1", "b1", 1.0), ("a2", "b1", 1.0)]


def test_touching_boxes_do_not_match(spark):
    a, b = spark.createDataFrame([box("a1", 0, 0)], BOX), spark.createDataFrame([box("b1", 75, 0)], BOX)
    assert pr.iou_best_match(a, b, 0.01).count() == 0
    with pytest.raises(ValueError):
        pr.iou_best_match(a, b, 0.0)


def test_upsert_resume_and_key_sets(spark):
    old = spark.createDataFrame([(1, "x"), (2, "x")], "k int, v string")
    new = spark.createDataFrame([(2, "y"), (3, "y")], "k int, v string")
    assert sorted(map(tuple, st.upsert(old, new, ["k"]).collect())) == [(1, "x"), (2, "y"), (3, "y")]
    assert sorted(map(tuple, st.upsert(old, new, ["k"], add=False).collect())) == [(2, "y"), (3, "y")]
    assert [r.k for r in st.resume(old, new, ["k"]).collect()] == [1]
    assert st.resume(old, new, ["k"], rerun=True).count() == 2
    assert sorted(map(tuple, st.key_sets(old, new, ["k"]).collect())) == [(1, "left"), (2, "both"), (3, "right")]


CANDIDATE = "fov_id string, ch1_label string, a_ord int, ch2_label string, b_ord int, score double"


def test_a_chain_in_which_each_wants_the_partner_of_the_one_before(spark):
    """Every nucleus prefers its predecessor's partner, in one field of 20,000 nuclei: steps grow with the logarithm."""
    n = 10_000
    ids = spark.range(n)
    own = ids.selectExpr("'f' fov_id", "concat('a', id) ch1_label", "int(id) a_ord", "concat('b', id) ch2_label", "int(id) b_ord", "0.5D score")
    other = ids.filter("id > 0").selectExpr(
        "'f' fov_id", "concat('a', id) ch1_label", "int(id) a_ord", "concat('b', id - 1) ch2_label", "int(id - 1) b_ord", "0.9D score"
    )
    rounds = []
    settled = pr._settled
    pr._settled = lambda state: rounds.append(1) or settled(state)
    try:
        got = pr.settle_greedily(own.union(other), walk=1000)
        assert got.filter("substring(ch1_label, 2) = substring(ch2_label, 2)").count() == n == got.count()
    finally:
        pr._settled = settled
    assert len(rounds) <= 17


@pytest.mark.parametrize("seed,n,edges", [(1, 30, 120), (2, 60, 90), (3, 12, 140), (4, 200, 600)])
def test_settled_together_equals_the_walk(spark, seed, n, edges):
    rng = random.Random(seed)
    pairs = {(rng.randrange(3), rng.randrange(n), rng.randrange(n)) for _ in range(edges)}
    rows = [(f"f{f}", f"a{i}", i, f"b{j}", j, rng.choice([0.2, 0.5, 0.9, 0.0])) for f, i, j in pairs]
    df = spark.createDataFrame(rows, CANDIDATE)
    walked = sorted(map(tuple, pr.settle_greedily(df).collect()))
    want = []
    for f in range(3):
        ones, twos = set(), set()
        for _, a, i, b, j, s in sorted((r for r in rows if r[0] == f"f{f}"), key=lambda r: (r[2], -r[5], r[4])):
            if s > 0 and a not in ones and b not in twos:
                ones.add(a)
                twos.add(b)
                want.append((f"f{f}", a, b))
    assert walked == sorted(want) == sorted(map(tuple, pr.settle_greedily(df, walk=0).collect()))


def boxes_of(spark, rows, p):
    columns = "fov_id string, key long, {p}left double, {p}top double, {p}right double, {p}bottom double".format(p=p)
    return spark.createDataFrame(rows, columns.replace("key", f"{p}key"))


@pytest.mark.parametrize("min_iou", [0.05, 0.3, 0.7, 0.95, 1.0])
def test_overlapping_boxes_of_all_sizes_are_met(spark, min_iou):
    rng = random.Random(int(min_iou * 100))

    def some(n):
        out = []
        for i in range(n):
            w, h = rng.choice([1, 3, 7.5, 20, 75, 400]), rng.choice([1, 3, 7.5, 20, 75, 400])
            left, top = rng.uniform(-50, 50), rng.uniform(-50, 50)
            out.append((rng.choice("fg"), i, left, top, left + w * rng.uniform(0.9, 1.1), top + h * rng.uniform(0.9, 1.1)))
        return out

    a = some(150) + [("f", 900, 0.0, 0.0, 0.0, 5.0), ("f", 901, 1.0, 1.0, 11.0, 11.0)]
    b = some(150) + [(f, 500 + i, left + w / 50, top, right, bottom) for f, i, left, top, right, bottom in a[:80] for w in [right - left]]
    b += [("f", 902, 0.0, 0.0, 0.0, 5.0), ("f", 903, 1.0, 1.0, 11.0, 11.0)]

    def overlap(p, q):
        w, h = min(p[4], q[4]) - max(p[2], q[2]), min(p[5], q[5]) - max(p[3], q[3])
        if w < 0 or h < 0:
            return 0.0
        both = (p[4] - p[2]) * (p[5] - p[3]) + (q[4] - q[2]) * (q[5] - q[3]) - w * h
        return w * h / both if both else 0.0

    want = sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and overlap(p, q) >= min_iou)
    got = pr._overlapping(boxes_of(spark, a, "a_"), boxes_of(spark, b, "b_"), min_iou)
    assert sorted((r.a_key, r.b_key) for r in got.collect()) == want and len(want) > 0


def test_a_crowd_of_small_boxes_is_not_compared_with_itself(spark):
    """50,000 boxes of half a pixel within 112 x 112 pixels: comparisons grow with boxes and overlaps, not with their square."""
    n, side = 50_000, 224

    def crowd(p, shift):
        at = spark.range(n)
        place = f"(id % {side}) * 0.5D + {shift}", f"floor(id / {side}) * 0.5D"
        return at.selectExpr("'f' fov_id", f"id {p}key", f"{place[0]} {p}left", f"{place[1]} {p}top", f"{place[0]} + 0.5D {p}right", f"{place[1]} + 0.5D {p}bottom")

    a, b = crowd("a_", 0.0), crowd("b_", 0.05)
    assert pr._near(a, b, 0.7).count() < 12 * n
    assert pr._overlapping(a, b, 0.7).filter("a_key = b_key").count() == n


def test_mask_candidates_from_lines_of_bits(spark):
    from perinuc.operators.pairing import mask_candidates

    def square(label, y, x, side):
        return [("f", label, i, j) for i in range(y, y + side) for j in range(x, x + side)]

    one = square(1, -3, -70, 9) + square(2, 10, 60, 9) + square(3, 40, 120, 9)
    two = square(7, -3, -69, 9) + square(8, 11, 60, 9) + square(9, 80, 120, 9)
    for extra in ([], [("f", 2, 14, 63)]):
        a, b = one + extra, two
        schema = "fov_id string, ne_label long, y long, x long"
        got = mask_candidates(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), min_iou=0.5).collect()
        want = {}
        for la, lb in ((1, 7), (2, 8)):
            pa, pb = [p[2:] for p in a if p[1] == la], [p[2:] for p in b if p[1] == lb]
            inter = sum(pa.count(p) for p in pb)
            want[str(la), str(lb)] = inter / (len(pa) + len(pb) - inter)
        assert {(r.ch1_label, r.ch2_label): r.iou for r in got} == want
        assert max(r.dist for r in got) < 1.2
