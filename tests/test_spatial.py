"""Neighbours and boxes without a fixed radius, against all pairs."""

import math
import random

import pytest

from drawlake.operators import spatial as S


def crowd(seed, n):
    """Points of one crowd, some far from it, some at one place, and a second drawing of a few."""
    r = random.Random(seed)
    rows = [(1, i, r.gauss(0, 1), r.gauss(0, 1)) for i in range(n)]
    rows += [(1, n + i, r.uniform(-1e4, 1e4), r.uniform(-1e4, 1e4)) for i in range(n // 10)]
    rows += [(1, 2 * n + i, 500.0, 500.0) for i in range(40)] + [(2, i, float(i), 0.0) for i in range(5)] + [(3, 0, 1.0, 1.0), (1, 5 * n, None, 2.0)]
    return rows


@pytest.mark.parametrize("metric,k", [("l2", 1), ("l1", 1), ("l2", 3)])
def test_nearest_without_radius(spark, metric, k):
    left, right = crowd(1, 300), [x for x in crowd(2, 400) if x[0] != 3]
    names = "file_id int, seq int, x double, y double"
    got = S.nearest(spark.createDataFrame(left, names), spark.createDataFrame(right, names), ["file_id"], metric=metric, k=k)
    want = []
    for f, s, x, y in left:
        if x is not None:
            d = sorted(((abs(x - u) + abs(y - v) if metric == "l1" else math.sqrt((x - u) ** 2 + (y - v) ** 2)), q) for g, q, u, v in right if g == f and u is not None)[:k]
            want += [(f, s, q, round(e, 9)) for e, q in d]
    assert sorted((r["file_id"], r["l_seq"], r["r_seq"], round(r["dist"], 9)) for r in got.collect()) == sorted(want)


def test_rings_compare_few(spark):
    names = "file_id int, seq int, x double, y double"
    r = random.Random(4)
    right = spark.createDataFrame([(1, i, r.gauss(0, 1), r.gauss(0, 1)) for i in range(4000)], names)
    # all far from a dense crowd
    left = spark.createDataFrame([(1, i, 1e5 + r.gauss(0, 1), r.gauss(0, 1)) for i in range(1000)], names)
    pairs = S.near_candidates(*(d.selectExpr("file_id", "x as _x", "y as _y") for d in (left, right)), ["file_id"], 1, "l2")
    assert pairs.count() < 1000 * 100


def boxes(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y, w, h = r.uniform(-50, 50), r.uniform(-50, 50), r.choice([0, 0.01, 1, 7, 60]), r.choice([0, 0.02, 2, 5, 200])
        out.append((r.randrange(2), i, round(x), y, round(x) + w, y + h))
    return out


def test_box_join_reports_each_pair_once(spark):
    a, b = boxes(1, 150), boxes(2, 120)
    frames = [spark.createDataFrame(rows, f"k int, {p}s int, {p}0 double, {p}1 double, {p}2 double, {p}3 double") for rows, p in (([(*x[:2], *map(float, x[2:])) for x in a], "a"), ([(*x[:2], *map(float, x[2:])) for x in b], "b"))]
    got = S.box_join(*frames, ["k"], ("a0", "a1", "a2", "a3"), ("b0", "b1", "b2", "b3"))
    want = sorted((p[0], p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5])
    assert sorted((r["k"], r["as"], r["bs"]) for r in got.collect()) == want


def test_zones_hold_their_border(spark):
    points = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 5.0, 5.0), (1, 3, 5.0, 5.0), (1, 4, None, 1.0), (2, 1, 5.0, 5.0), (1, 5, 12.0, 3.0)], "file_id int, seq int, x double, y double")
    zones = spark.createDataFrame([(1, 1, "a", 0.0, 0.0, 10.0, 10.0), (1, 0, "b", 4.0, 4.0, 6.0, 6.0)], "file_id int, seq int, zone string, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r["file_id"], r["seq"]) for r in S.exclude_zones(points, zones, ["file_id"]).collect()) == [(1, 1), (1, 4), (1, 5), (2, 1)]
    assert sorted((r["file_id"], r["seq"]) for r in S.exclude_zones(points, zones, ["file_id"], strict=False).collect()) == [(1, 4), (1, 5), (2, 1)]
    assert sorted((r["file_id"], r["seq"], r["zone"]) for r in S.zone_of(points, zones, ["file_id"]).collect()) == [(1, 1, "a"), (1, 2, "b"), (1, 3, "b"), (1, 4, None), (1, 5, "a"), (2, 1, None)]
