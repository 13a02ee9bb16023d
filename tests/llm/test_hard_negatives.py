"""Mined negatives against a plain search in exact integers, and packed products against sums."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from checks.compare import compare
from tests.conftest import SMALL
from tradeloom.llm import hard_negatives as hn
from tradeloom.llm.kronecker import products

SCHEMA = "vec_id long, embedding array<float>, label int"
CLASHING = ["cast(null as string) as chunk", "1 as n", "'k' as kind", "2.5 as score", "1 as rank", "array(1) as ids"]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", *CLASHING)


def brute_force(rows, every=100):
    """The result as a sorted list, by plain search over all rows."""
    taken = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        taken.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    rank = lambda found: sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))[:5]
    out = []
    for i, (anchor, a, label) in enumerate(taken):
        if anchor is None or anchor % every:
            continue
        scored = [(sum(x * y for x, y in zip(a, c)), vec_id, other == label) for j, (vec_id, c, other) in enumerate(taken) if i != j]
        for p, positive, _ in rank([s for s in scored if s[2]]):
            fits = [s for s in scored if not s[2] and 80 * p <= 100 * s[0] <= 100 * p]
            out += [(anchor, positive, k, s[1], p, s[0]) for k, s in enumerate(rank(fits), start=1)]
    return sorted(out, key=str)


def mined(df, **options):
    return sorted((tuple(r) for r in hn.mine(df, **options).collect()), key=str)


def clustered(rng, n, d=8, labels=4, grid=8):
    centres = [[rng.uniform(-1, 1) for _ in range(d)] for _ in range(5)]
    # Few distinct values give many equal scores.
    vector = lambda c: [round((x + rng.uniform(-0.3, 0.3)) * grid) / grid for x in c]
    return [(i, vector(centres[i % 5]), (i + rng.randrange(2)) % labels) for i in range(n)]


@pytest.mark.parametrize("low,high,d", [(-160, 160, 64), (-256, 257, 64), (0, 1, 5), (-5, -4, 7), (-(10**6), 10**6, 64), (-(2**28), 2**28, 9), (7, 8, 3), (-30000, 30000, 1000)])
def test_products_are_exact(low, high, d):
    rng = np.random.default_rng(d)
    for n in (1, 2, 3, 101):
        a, c = rng.integers(low, high, (17, d)), rng.integers(low, high, (n, d))
        assert (products(a, c) == a.astype(object) @ c.astype(object).T).all()


def test_products_of_extreme_values():
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    a, c = np.array([[1e38, -1e38, 3.0], [1.0, 0.0, 0.0]]), np.array([[1e38, 1e38, 2.0], [1.0, 2.0, 3.0]])
    assert products(a, c).tolist() == [[6, least], [most, 1]]
    assert products(a[:, :0], c).tolist() == [[0, 0], [0, 0]]
    corner = np.full((2, 64), -256)
    assert (products(corner, corner) == 64 * 65536).all()


def test_equals_sql(spark):
    assert compare(spark, SMALL, "op13", hn.query, hn.ORACLE) == ""


@pytest.mark.parametrize("grid", [None, (1, 1), (3, 5)])
def test_equals_plain_search(spark, grid):
    rows = clustered(random.Random(4), 900)
    df = frame(spark, rows).repartition(7)
    wanted = brute_force(rows, every=20)
    assert len(wanted) > 300 and mined(df, every=20, grid=grid) == wanted


def test_small_chunks(spark, monkeypatch):
    """Anchors and rows in many blocks."""
    monkeypatch.setattr(hn, "_CHUNK_ROWS", 37)
    monkeypatch.setattr(hn, "_AT_ONCE", 3)
    rows = clustered(random.Random(9), 500, labels=2)
    assert mined(frame(spark, rows), every=10, grid=(2, 3)) == brute_force(rows, every=10)


def test_hot_label_and_vector(spark):
    """One label, one vector and one id hold most rows."""
    rows = [(i, [0.5, 0.25], 1 if i % 10 else 2) for i in range(400)] + [(100, [0.5, 0.25], 1)] * 300
    df = frame(spark, rows)
    out = mined(df)
    assert len(out) == 304 * 25 and {r[5] for r in out} == {128 * 128 + 64 * 64}
    assert mined(df.limit(450)) == brute_force(rows[:450])


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (100, [0.5, 0.5], 1), (101, [0.5, 0.5], 1), (None, [0.5, 0.5], 1), (None, [0.5, 0.49], 3), (102, [0.5], 2), (103, [0.5, 0.49, 9.0], 2),
        (104, [], 2), (105, None, 2), (106, [0.5, None], 2), (107, [nan, 0.5], 2), (108, [0.5, inf], 2), (109, [0.5, 0.45], None),
        (200, [], 5), (201, [], 5), (202, [1.0] * 3000, 6), (300, [0.5, 0.5], 1), (300, [0.5, 0.5], 1), (700, [-0.5, 0.4], 9), (701, [-0.5, 0.4], 0),
        (-100, [0.5, 0.5], 2), (400, [-0.001, -1.0], 4), (401, [1.0, 0.5], 4), (-7, [0.5, 0.48], -1), (500, [3e38], 8), (501, [3e38], 8), (502, [3e38], 7),
    ]
    clamp = lambda v: max(-(2**63), min(2**63 - 1, v))
    wanted = [(*r[:4], clamp(r[4]), clamp(r[5])) for r in brute_force(rows[:-3])]
    got = mined(frame(spark, rows[:-3]))
    assert got == sorted(wanted, key=str) and any(r[1] is None for r in got) and any(r[3] is None for r in got)
    most = 2**63 - 1
    assert mined(frame(spark, rows[-3:])) == [(500, 501, 1, 502, most, most)]


def test_scores_beyond_packing(spark):
    """Components too large for fields of a float64."""
    rng = random.Random(2)
    rows = [(i, [float(np.float32(rng.uniform(-1, 1) * 10**6)) for _ in range(4)], i % 3) for i in range(200)]
    assert mined(frame(spark, rows), every=10) == brute_force(rows, every=10)


def test_empty(spark):
    assert mined(frame(spark, [])) == [] and mined(frame(spark, [(100, [1.0], 1)])) == []
