"""Exact global order statistics without a global sort.

`ntile` needs only the keys at the tile edges, and a dense rank of a few rows needs only
counts of distinct values around them. Both are found by counting, so no window over the
whole data set (one task) and no shuffle of the whole data set is required.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil, sqrt
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKETCH_SIZE = 32_768  # places are known to about one in ten thousand
SAMPLE_ROWS = 20_000
COLLECT_ROWS = 20_000


@dataclass(frozen=True)
class Order:
    """Order by a numeric column, ties broken by an ascending unique id.

    NULL values come first ascending and last descending; of equal values a NULL id comes first.
    """

    column: str
    tie_break: str
    descending: bool = False

    def parts(self) -> list[Column]:
        """Three columns whose ascending struct order is this order."""
        value = F.col(self.column)
        if self.descending:
            return [value.isNull(), -value, F.col(self.tie_break)]
        return [value.isNotNull(), value, F.col(self.tie_break)]


def place(df: DataFrame, order: Order) -> Column:
    """A number that never descends along the order, so that sketches can tell where rows lie.

    Whole units of the value, and below them the beginning of a text id; rows that it does not tell
    apart share it, which costs a search for a rank more rows to look at.
    """
    kind, tie = df.schema[order.column].dataType, df.schema[order.tie_break].dataType
    value, fraction = F.col(order.column), F.lit(0.0)
    if isinstance(kind, T.DecimalType):
        value = value * 10**kind.scale
    value = value.cast("double")
    if isinstance(tie, T.StringType) and not isinstance(kind, (T.DoubleType, T.FloatType)):
        begins = F.rpad(F.hex(F.substring(F.col(order.tie_break).cast("binary"), 1, 6)), 12, "0")
        fraction = F.coalesce(F.conv(begins, 16, 10).cast("double") / float(1 << 48), fraction)
    end = F.lit(float("inf") if order.descending else float("-inf"))
    return F.coalesce((-value if order.descending else value) + fraction, end)


def _sketched(keyed: DataFrame, places: list[str], shares: list[float], size: int) -> list[list[float]]:
    """One pass that sketches: per column of places, those at the given shares of the rows."""
    made = keyed.agg(*(F.kll_sketch_agg_double(p, F.lit(size)).alias(p) for p in places))
    asked = (F.kll_sketch_get_quantile_double(p, F.lit(x)).alias(f"{p}_{i}") for p in places for i, x in enumerate(shares))
    found = iter(made.select(*asked).first())
    return [[next(found) for _ in shares] for _ in places]


@dataclass
class _Search:
    """The rows in (low, high] of one order still hold the wanted rank; `below` rows precede them.

    after, until  bounds of the same kind on the rows' places
    """

    order: int
    rank: int
    rows: int
    below: int = 0
    low: tuple | None = None
    high: tuple | None = None
    after: float | None = None
    until: float | None = None

    def condition(self, key: Column, literal, place: Column) -> Column:
        inside = F.lit(True)
        if self.after is not None:
            inside = inside & (place > self.after)
        if self.until is not None:
            inside = inside & (place <= self.until)
        if self.low is not None:
            inside = inside & (key > literal(self.low))
        if self.high is not None:
            inside = inside & (key <= literal(self.high))
        return inside

    def covers(self, key: tuple, place: float) -> bool:
        if (self.after is not None and place <= self.after) or (self.until is not None and place > self.until):
            return False
        above = self.low is None or _python_order(key) > _python_order(self.low)
        return above and (self.high is None or _python_order(key) <= _python_order(self.high))


def _python_order(key: tuple) -> tuple:
    flag, value, tie_break = key
    known = tie_break is not None
    return (flag, 0 if value is None else value, known, tie_break if known else "")


def keys_at_ranks(
    df: DataFrame,
    orders: list[Order],
    ranks: list[int],
    total: int,
    sample_rows: int = SAMPLE_ROWS,
    collect_rows: int = COLLECT_ROWS,
    sketch_size: int | None = SKETCH_SIZE,
) -> list[list[tuple]]:
    """The exact sort keys at the given 1-based ranks of each order.

    Each round samples the candidate rows, picks two keys around every wanted rank and
    counts the rows up to them, which narrows the candidates by about sqrt(sample_rows). All
    ranks of all orders share the two passes of a round. Once few enough candidates are left
    they are sorted on the driver. The sample is chosen by a hash, so it steers only how fast
    the search ends, never its result. The first round takes its two keys from quantile sketches of
    the places of the rows instead of a sample, and mostly no other round follows: one pass
    sketches all orders, one counts, one collects.
    """
    names, places = [f"k{i}" for i in range(len(orders))], [f"p{i}" for i in range(len(orders))]
    keyed = df.select(
        *(F.struct(*(c.alias(n) for c, n in zip(o.parts(), "fvt"))).alias(k) for o, k in zip(orders, names)),
        *(place(df, o).alias(p) for o, p in zip(orders, places)),
    )
    types = {k: [field.dataType for field in keyed.schema[k].dataType] for k in names}

    def inside(s: _Search) -> Column:
        return s.condition(F.col(names[s.order]), _literal(types[names[s.order]]), F.col(places[s.order]))

    searches = [_Search(i, rank, total) for i in range(len(orders)) for rank in ranks]
    if sketch_size and total > collect_rows:
        margin = 4 / sketch_size
        shares = [min(1.0, max(0.0, r / total + side * margin)) for r in ranks for side in (-1, 1)]
        seeds = _sketched(keyed, places, shares, sketch_size)
        own = [seeds[s.order][2 * at : 2 * at + 2] for s in searches for at in [ranks.index(s.rank)]]
        counts = iter(_counted(keyed, [F.count_if(F.col(places[s.order]) <= x) for s, pair in zip(searches, own) for x in pair]))
        for search, pair in zip(searches, own):
            _narrow(search, [(x, next(counts)) for x in pair], "after", "until")
    attempt = 0
    while wide := [s for s in searches if s.rows > collect_rows]:
        attempt += 1
        # Every search samples its own candidates, about sample_rows of them.
        picks = []
        for s in wide:
            spread = F.xxhash64(names[s.order], F.lit(attempt))
            picks.append(inside(s) & (F.pmod(spread, F.lit(max(1, s.rows // sample_rows))) == 0))
        sample = _sampled(keyed.select(*names, F.array(*picks).alias("picks")))
        probes = []
        for i, s in enumerate(wide):
            own = sorted((tuple(r[s.order]) for r in sample if r.picks[i]), key=_python_order)
            probes.append(_probe(s, own))
        counters = [
            F.count_if(inside(s) & (F.col(names[s.order]) <= _literal(types[names[s.order]])(edge)))
            for s, edges in zip(wide, probes)
            for edge in edges
        ]
        if not counters:
            continue
        counts = iter(_counted(keyed, counters))
        for search, edges in zip(wide, probes):
            _narrow(search, [(edge, next(counts)) for edge in edges])

    parts = [F.col(f"{k}.{p}").alias(f"{k}{p}") for k in names for p in "fvt"]
    left = keyed.where(reduce(or_, (inside(s) for s in searches))).select(*parts, *places).toArrow()
    found: list[list[tuple]] = [[] for _ in orders]
    for i, keys in enumerate(found):
        own = [s for s in searches if s.order == i]
        columns = [left.column(3 * i + p).to_pylist() for p in range(3)]
        at = left.column(3 * len(orders) + i).to_pylist()
        rows = sorted(zip(zip(*columns, strict=True), at, strict=True), key=lambda r: _python_order(r[0]))
        for s in own:
            keys.append([k for k, x in rows if s.covers(k, x)][s.rank - s.below - 1])
    return found


def _counted(keyed: DataFrame, counters: list[Column]) -> tuple:
    """One pass that counts."""
    return keyed.agg(*(c.alias(f"c{i}") for i, c in enumerate(counters))).first()


def _sampled(picked: DataFrame) -> list:
    """One pass that samples."""
    return picked.where(F.array_contains("picks", True)).collect()


def _literal(types: list):
    def of(values: tuple) -> Column:
        return F.struct(*(F.lit(v).cast(t).alias(n) for v, t, n in zip(values, types, "fvt")))

    return of


def _probe(search: _Search, sample: list[tuple]) -> list[tuple]:
    """Two sampled keys that most likely enclose the wanted rank."""
    if not sample:
        return []
    size = len(sample)
    share = (search.rank - search.below) / search.rows
    margin = 4 * sqrt(size * share * (1 - share)) + 2
    positions = {int(share * size - margin), ceil(share * size + margin)}
    return [sample[p] for p in sorted(positions) if 0 <= p < size]


def _narrow(search: _Search, counted: list[tuple], low: str = "low", high: str = "high") -> None:
    wanted = search.rank - search.below
    passed, end = 0, search.rows
    for edge, rows in counted:
        if rows < wanted:
            setattr(search, low, edge)
            passed = rows
        else:
            setattr(search, high, edge)
            end = rows
            break
    search.below += passed
    search.rows = end - passed


def tile_ranks(total: int, tiles: int) -> list[int]:
    """Rank of the last row of every tile but the last; the first tiles take the rest."""
    size, rest = divmod(total, tiles)
    return [i * size + min(i, rest) for i in range(1, tiles)]


def global_ntile(
    df: DataFrame, tiles: int, scores: dict[str, Order], **search_sizes: int | None
) -> DataFrame:
    """Add NTILE columns by comparing each row with the exact tile edges: no shuffle.

    `df` is scanned several times, so it should be a table on storage.
    """
    total = df.count()
    if total == 0:
        return df.select("*", *(F.lit(1).alias(name) for name in scores))
    ranks = tile_ranks(total, tiles)
    wanted = sorted({r for r in ranks if r > 0})
    orders = list(scores.values())
    edges = keys_at_ranks(df, orders, wanted, total, **search_sizes) if wanted else [[]] * len(orders)
    columns = []
    for name, order, keys in zip(scores, orders, edges):
        parts = order.parts()
        literal = _literal([field.dataType for field in df.select(*parts).schema])
        key = F.struct(*(p.alias(n) for p, n in zip(parts, "fvt")))
        at = dict(zip(wanted, keys))
        tile = F.lit(1)
        for rank in ranks:
            if rank in at:
                tile = tile + (key > literal(at[rank])).cast("int")
        columns.append(tile.alias(name))
    return df.select("*", *columns)


def dense_rank_of(
    rows: DataFrame, population: DataFrame, column: str, name: str, descending: bool = False
) -> DataFrame:
    """Dense rank, within `population`, of the values of a few `rows`.

    Distinct values are counted per gap between the wanted ones, so only as many counts as
    there are `rows` meet in one place. `rows` must be bounded (a top-k result).
    """
    order = Order(column, column, descending)
    key = F.struct(*(part.alias(n) for part, n in zip(order.parts(), "fv")))
    wanted = rows.agg(F.array_sort(F.collect_set(key)).alias("wanted")).scalar()
    values = population.select(key.alias("key")).distinct().select("key", wanted.alias("wanted"))
    gap = F.size(F.filter("wanted", lambda w: w <= F.col("key")))
    gaps = values.groupBy(gap.alias("gap")).agg(F.count("*").alias("n"))
    counts = gaps.agg(F.collect_list(F.struct("gap", "n")).alias("counts")).scalar()
    before = F.aggregate(
        "_counts",
        F.lit(0).cast("long"),
        lambda total, c: total + F.when(c["gap"] < F.col("_position"), c["n"]).otherwise(F.lit(0)),
    )
    return (
        rows.select("*", F.array_position(wanted, key).alias("_position"), counts.alias("_counts"))
        .withColumn(name, before + 1)
        .drop("_position", "_counts")
    )
