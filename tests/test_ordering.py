from __future__ import annotations

import random

import pytest

from tests.conftest import as_set
from tradeloom.operators import ordering
from tradeloom.operators.ordering import (
    Order,
    dense_rank_of,
    global_ntile,
    keys_at_ranks,
    tile_ranks,
)
from pyspark.sql import Window
from pyspark.sql import functions as F

class Passes:
    """Counts the passes of a search."""

    def __init__(self, monkeypatch):
        self.made = []
        for name in ("_counted", "_sampled", "_sketched"):
            original = getattr(ordering, name)
            monkeypatch.setattr(ordering, name, lambda *a, name=name, original=original: self.made.append(name) or original(*a))


SCORES = {"up": Order("value", "id"), "down": Order("value", "id", descending=True)}


def local_ntile(df, tiles, scores):
    """The plain window form."""

    def sorting(order):
        value = F.col(order.column)
        value = value.desc_nulls_last() if order.descending else value.asc_nulls_first()
        return value, F.col(order.tie_break).asc_nulls_first()

    tiled = (F.ntile(tiles).over(Window.orderBy(*sorting(o))).alias(n) for n, o in scores.items())
    return df.select("*", *tiled)


def frame(spark, values):
    data = [(f"id{i:05d}", v) for i, v in enumerate(values)]
    random.Random(3).shuffle(data)
    return spark.createDataFrame(data, "id string, value int").repartition(4)


def values(kind: str, n: int) -> list:
    draw = random.Random(n)
    if kind == "tied":
        return [1 if draw.random() < 0.97 else draw.randrange(5) for _ in range(n)]
    if kind == "nulls":
        return [None if draw.random() < 0.4 else draw.randrange(-50, 50) for _ in range(n)]
    return [draw.randrange(10**6) for _ in range(n)]


@pytest.mark.parametrize("kind", ["tied", "nulls", "spread"])
def test_global_ntile_equals_the_window(spark, kind):
    df = frame(spark, values(kind, 3000)).cache()
    found = global_ntile(df, 5, SCORES, sample_rows=400, collect_rows=100)
    assert as_set(found) == as_set(local_ntile(df, 5, SCORES))


@pytest.mark.parametrize("sizes", [{}, {"sample_rows": 100, "collect_rows": 60}])
def test_a_null_id_among_ties(spark, sizes):
    data = [(None if i == 7 else f"id{i:03d}", i % 3) for i in range(300)]
    df = spark.createDataFrame(data, "id string, value int").repartition(3)
    assert as_set(global_ntile(df, 5, SCORES, **sizes)) == as_set(local_ntile(df, 5, SCORES))


@pytest.mark.parametrize("n", [0, 1, 3, 5, 13])
def test_few_rows(spark, n):
    df = frame(spark, values("tied", n))
    assert as_set(global_ntile(df, 5, SCORES)) == as_set(local_ntile(df, 5, SCORES))


def test_tile_sizes():
    assert tile_ranks(13, 5) == [3, 6, 9, 11]
    assert tile_ranks(3, 5) == [1, 2, 3, 3]


def test_keys_at_ranks(spark):
    df = frame(spark, values("spread", 2000))
    ordered = [r.id for r in df.orderBy("value", "id").collect()]
    ranks = [1, 2, 1000, 1999, 2000]
    (found,) = keys_at_ranks(df, [SCORES["up"]], ranks, 2000, sample_rows=200, collect_rows=60)
    assert [key[2] for key in found] == [ordered[r - 1] for r in ranks]


@pytest.mark.parametrize("descending", [False, True])
def test_dense_rank_of_equals_the_window(spark, descending):
    df = frame(spark, values("nulls", 400)).withColumn("value", F.col("value").cast("decimal(20,2)"))
    order = F.desc_nulls_last("value") if descending else F.asc_nulls_first("value")
    ranked = df.withColumn("rank", F.dense_rank().over(Window.orderBy(order)))
    some = df.orderBy("id").limit(60)
    wanted = ranked.join(some.select("id"), "id", "left_semi")
    found = dense_rank_of(some, df, "value", "rank", descending)
    assert [(r.id, r.value, r["rank"]) for r in found.orderBy("id").collect()] == [
        (r.id, r.value, r["rank"]) for r in wanted.orderBy("id").collect()
    ]


@pytest.mark.parametrize("kind", ["tied", "nulls", "spread"])
@pytest.mark.parametrize("sketch_size", [None, 64])
def test_sketches_only_speed_up(spark, kind, sketch_size):
    df = frame(spark, values(kind, 3000)).cache()
    got = global_ntile(df, 5, SCORES, sample_rows=300, collect_rows=200, sketch_size=sketch_size)
    assert as_set(got) == as_set(local_ntile(df, 5, SCORES))


def test_sketched_edges_take_few_passes(spark, monkeypatch):
    """One pass sketches, one counts and one collects, where most people have the same value as well."""
    draw = random.Random(1)
    rows = [(f"{draw.getrandbits(64):016x}", 1 if i % 20 else i, draw.randrange(10**6), draw.randrange(900)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "id string, frequency int, cents int, days int")
    df = df.select("id", "frequency", (F.col("cents") / 100).cast("decimal(12,2)").alias("money"), "days").cache()
    orders = [Order("frequency", "id"), Order("money", "id"), Order("days", "id", descending=True)]
    ranks, passes = tile_ranks(20_000, 5), Passes(monkeypatch)
    wanted = keys_at_ranks(df, orders, ranks, 20_000, collect_rows=10**6)
    assert passes.made == []
    assert keys_at_ranks(df, orders, ranks, 20_000, collect_rows=400) == wanted
    assert passes.made == ["_sketched", "_counted"]
    passes.made.clear()
    assert keys_at_ranks(df, orders, ranks, 20_000, collect_rows=400, sketch_size=None) == wanted
    assert len(passes.made) > 2


@pytest.mark.parametrize("descending", [False, True])
def test_places_never_descend(spark, descending):
    rows = [(i, v) for i in ("", "a", "ab", "abcdefgh", "é", "漢字", None) for v in (None, -5, 0, 3)]
    for kind in ("int", "decimal(8,2)", "double"):
        df = spark.createDataFrame(rows, "id string, v int").select("id", F.col("v").cast(kind).alias("v"))
        order = Order("v", "id", descending)
        found = df.orderBy(*(F.struct(*order.parts()),)).select(ordering.place(df, order).alias("p")).collect()
        at = [r["p"] for r in found]
        assert at == sorted(at)
