"""Hard-negative mining by exact integer inner products.

Rows whose `vec_id` is divisible by 100 are anchors. An anchor's positives are its best `TOP` other
rows of its label; for each positive, the best `TOP` rows of other labels that score no more than
it and at least 80 % of it are the negatives. Scores are inner products of floor(256 x), computed
for blocks of anchors against blocks of rows by Kronecker packing (`kronecker`). Higher scores
come first, then smaller ids.

Anchors and rows are cut into blocks that form a grid: a cell holds at most about `_ANCHORS`
anchors and `_ROWS` rows, and a block of rows meets every group of anchors. A cell returns its best
few per anchor, and windows with Spark's group limit, which cuts on the map side, merge the cells.
Positives use only rows of the anchor's label, negatives all others, so each pair is multiplied
once. A label, an id or a vector that a third of all rows share is spread like any other rows.

Rows with a null label, a null vector or a null or non-finite component take no part. Each row
counts: rows that repeat an id are rows of their own, and each repeated anchor returns its result.
A null `vec_id` is no anchor and ranks after all other ids. Of vectors of different lengths the
missing components count as zero; an empty vector scores 0 with all. Scores beyond 64 bits are
held at the ends of that range. Empty tables give no rows. Other columns play no part. Ids and
labels are cast to long and int; text that is no number raises.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.llm.kronecker import products
from tradeloom.llm.tasks import Batches, importable, map_batches, written

TOP = 5
EVERY = 100
_SCALE = 256
_CHUNK_ROWS, _CHUNK_VALUES = 4096, 1 << 20
_ANCHORS, _ROWS = 65_536, 65_536
_AT_ONCE = 256
_CODES = {"h": np.int16, "i": np.int32, "d": np.float64}
_BLOCKS = "kind int, chunk long, n int, d int, code string, data binary, ids binary, known binary, labels binary, at binary"
_FOUND = "chunk long, at int, id long, known boolean, score long"
_MINED = (
    "chunk long, at int, place int, anchor_id long, positive_id long, positive_known boolean, positive_score long,"
    " id long, known boolean, score long"
)


# Blocks


def _components(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole components, length per row, and which rows have only finite components."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(vectors).cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.unique(np.repeat(np.arange(len(lengths)), lengths)[~np.isfinite(values)])
    sound = np.ones(len(lengths), bool)
    sound[bad] = False
    return np.floor(_SCALE * values), lengths, sound


def _cut(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(matrix, ids, known, labels) of runs of rows of like length, each sorted by id."""
    batch = batch.filter(pc.and_(pc.is_valid(batch.column("label")), pc.is_valid(batch.column("embedding"))))
    if not batch.num_rows:
        return
    values, lengths, sound = _components(batch.column("embedding"))
    known = pc.is_valid(batch.column("vec_id")).to_numpy(zero_copy_only=False)
    ids = batch.column("vec_id").fill_null(0).to_numpy()
    labels = batch.column("label").to_numpy().astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    order = np.lexsort((ids, ~known, lengths))
    order = order[sound[order]]
    at = 0
    while at < len(order):
        # Lengths ascend: a run ends before its longest row would make it too large.
        widest = np.maximum(lengths[order[at : at + _CHUNK_ROWS]], 1)
        size = widest * np.arange(1, len(widest) + 1)
        n = max(1, int(np.searchsorted(size, _CHUNK_VALUES, "right")))
        rows = order[at : at + n]
        rows = rows[np.lexsort((ids[rows], ~known[rows]))]
        matrix = np.zeros((n, int(lengths[rows].max())))
        for length in np.unique(lengths[rows]):
            own = np.flatnonzero(lengths[rows] == length)
            matrix[own, :length] = values[starts[rows[own]][:, None] + np.arange(length)]
        yield matrix, ids[rows], known[rows], labels[rows]
        at += n


def _code(matrix: np.ndarray) -> str:
    most = np.abs(matrix).max(initial=0)
    return "h" if most < 1 << 15 else "i" if most < 1 << 31 else "d"


def blocks(vectors: DataFrame, every: int = EVERY) -> DataFrame:
    """Blocks of rows (kind 0) and, per block, of the anchors among them (kind 1), written.

    `at` of an anchor is its place in the block of rows that it belongs to.
    """

    def run(batches: Batches) -> Batches:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for matrix, ids, known, labels in _cut(batch):
                number += 1
                anchors = np.flatnonzero(known & (ids % every == 0))
                for kind, rows in ((0, np.arange(len(ids))), (1, anchors)):
                    if len(rows):
                        code = _code(matrix[rows])
                        row = {
                            "kind": kind, "chunk": number, "n": len(rows), "d": matrix.shape[1], "code": code,
                            "data": matrix[rows].astype(_CODES[code]).tobytes(), "ids": ids[rows].tobytes(),
                            "known": known[rows].tobytes(), "labels": labels[rows].tobytes(), "at": rows.astype(np.int32).tobytes(),
                        }
                        yield pa.RecordBatch.from_pylist([row], _ARROW_BLOCKS)

    label, vec_id = F.col("label").cast("int"), F.col("vec_id").cast("long")
    own = vectors.select(
        vec_id.alias("vec_id"), "embedding", F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label")
    )
    return written(map_batches(own, ["vec_id", "embedding", "label"], run, _BLOCKS), "vector_blocks")


_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in ddl.split(","))])


_ARROW_BLOCKS, _ARROW_FOUND, _ARROW_MINED = map(_arrow, (_BLOCKS, _FOUND, _MINED))


@dataclass
class _Block:
    """One block of rows or anchors, decoded."""

    chunk: np.ndarray
    matrix: np.ndarray
    ids: np.ndarray
    known: np.ndarray
    labels: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, row: dict) -> _Block:
        matrix = np.frombuffer(row["data"], _CODES[row["code"]]).reshape(row["n"], row["d"])
        array = lambda name, kind: np.frombuffer(row[name], kind)
        return cls(
            np.full(row["n"], row["chunk"]), matrix, array("ids", np.int64), array("known", bool),
            array("labels", np.int64), array("at", np.int32),
        )

    def take(self, rows: np.ndarray) -> _Block:
        return _Block(*(v[rows] for v in vars(self).values()))


def _joined(rows: list[dict]) -> list[tuple[_Block, list]]:
    """Anchors of equal length as one block, with the other columns of their rows."""
    by_length: dict[int, list] = {}
    for row in rows:
        by_length.setdefault(row["d"], []).append(row)
    result = []
    for group in by_length.values():
        parts = [_Block.of(row) for row in group]
        whole = _Block(*(np.concatenate([vars(p)[name] for p in parts]) for name in vars(parts[0])))
        result.append((whole, group))
    return result


# Best rows in a cell


def _first(groups: np.ndarray, *keys: np.ndarray, top: int = TOP) -> np.ndarray:
    """Places of the first `top` entries of each group in the order of the keys."""
    order = np.lexsort((*keys[::-1], groups))
    ordered = groups[order]
    start = np.r_[True, ordered[1:] != ordered[:-1]] if len(ordered) else np.zeros(0, bool)
    begun = np.maximum.accumulate(np.where(start, np.arange(len(ordered)), 0)) if len(ordered) else ordered
    return order[np.arange(len(ordered)) - begun < top]


def _best_columns(scores: np.ndarray, barred: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the TOP highest scores of each row; columns are in the order of ties."""
    n = scores.shape[1]
    if np.abs(scores).max(initial=0) < 1 << 48:
        # One key per entry, without ties: the score, then the earlier column.
        key = scores * n + np.arange(n - 1, -1, -1)
        key[barred] = np.iinfo(np.int64).min
        best = np.argpartition(key, max(0, n - TOP), axis=1)[:, max(0, n - TOP) :]
        row = np.repeat(np.arange(len(scores)), best.shape[1])
        column = best.ravel()
        real = key[row, column] > np.iinfo(np.int64).min
        return row[real], column[real]
    row, column = np.nonzero(~barred)
    found = _first(row, -(scores[row, column] // 2), -scores[row, column] % 2, column)
    return row[found], column[found]


def _positives(anchors: _Block, rows: _Block) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, id, known, score) of the best rows of each anchor's own label."""
    for label in np.intersect1d(anchors.labels, rows.labels):
        own = rows.take(np.flatnonzero(rows.labels == label))
        members = np.flatnonzero(anchors.labels == label)
        for at in range(0, len(members), _AT_ONCE):
            some = members[at : at + _AT_ONCE]
            scores = products(anchors.matrix[some], own.matrix)
            itself = (anchors.chunk[some, None] == own.chunk[None]) & (anchors.at[some, None] == own.at[None])
            row, column = _best_columns(scores, itself)
            yield some[row], own.ids[column], own.known[column], scores[row, column]


def find_positives(rows: list[dict], anchor_rows: list[dict]) -> pa.Table:
    """The best rows of its label for each anchor of a cell."""
    out = []
    for anchors, _ in _joined(anchor_rows):
        found = [np.zeros(0, kind) for kind in (np.int64, np.int64, bool, np.int64)]
        for row in rows:
            more = [*_positives(anchors, _Block.of(row))]
            found = [np.concatenate([f, *(m[i] for m in more)]) for i, f in enumerate(found)]
            anchor, ids, known, scores = found
            best = _first(anchor, _descending(scores), ~known, ids)
            found = [f[best] for f in found]
        anchor, ids, known, scores = found
        out.append(pa.table([anchors.chunk[anchor], anchors.at[anchor], ids, known, scores], schema=_ARROW_FOUND))
    return pa.concat_tables(out) if out else _ARROW_FOUND.empty_table()


def _descending(scores: np.ndarray) -> np.ndarray:
    """Keys that ascend where the scores descend; negation would overflow at the least score."""
    return ~scores


def find_negatives(rows: list[dict], anchor_rows: list[dict]) -> pa.Table:
    """For each anchor of a cell and each of its positives, the best rows of other labels whose
    score is from 80 to 100 % of the positive's."""
    out = []
    for anchors, sources in _joined(anchor_rows):
        known_at = {key: i for i, key in enumerate(zip(anchors.chunk.tolist(), anchors.at.tolist(), strict=True))}
        given = [(known_at[s["chunk"], p["at"]], p) for s in sources for p in s["positives"] if p["score"] >= 0]
        if not given:
            continue
        of = np.array([i for i, _ in given])
        place = np.array([p["place"] for _, p in given])
        high = np.array([p["score"] for _, p in given], np.int64)
        low = np.array([-(-4 * p["score"] // 5) for _, p in given], np.int64)
        members, local = np.unique(of, return_inverse=True)
        most, least = np.full(len(members), -1), np.full(len(members), np.iinfo(np.int64).max)
        np.maximum.at(most, local, high)
        np.minimum.at(least, local, low)
        table = np.full((TOP + 1, len(members)), -1)  # the entry of `given` by place and member
        table[place, local] = np.arange(len(given))
        found = [np.zeros(0, kind) for kind in (np.int64, np.int64, bool, np.int64)]
        for row in rows:
            block, parts = _Block.of(row), []
            for at in range(0, len(members), _AT_ONCE):
                some = slice(at, at + _AT_ONCE)
                scores = products(anchors.matrix[members[some]], block.matrix)
                near = (scores >= least[some, None]) & (scores <= most[some, None])
                near &= anchors.labels[members[some], None] != block.labels[None]
                r, c = np.nonzero(near)
                score = scores[r, c]
                order = np.lexsort((c, ~score, r))
                r, c, score = r[order] + at, c[order], score[order]
                for p in range(1, TOP + 1):
                    entry = table[p][r]
                    fits = np.flatnonzero((entry >= 0) & (score <= high[entry]) & (score >= low[entry]))
                    fits = fits[_leading(r[fits])]
                    parts.append((entry[fits], block.ids[c[fits]], block.known[c[fits]], score[fits]))
            found = [np.concatenate([f, *(m[i] for m in parts)]) for i, f in enumerate(found)]
            entry, ids, known, scores = found
            best = _first(entry, ~scores, ~known, ids)
            found = [f[best] for f in found]
        entry, ids, known, scores = found
        owner = of[entry]
        positive = [given[e][1] for e in entry.tolist()]
        out.append(
            pa.table(
                [
                    anchors.chunk[owner], anchors.at[owner], place[entry], anchors.ids[owner],
                    [p["id"] for p in positive], [p["known"] for p in positive], high[entry], ids, known, scores,
                ],
                schema=_ARROW_MINED,
            )
        )
    return pa.concat_tables(out) if out else _ARROW_MINED.empty_table()


def _leading(groups: np.ndarray, top: int = TOP) -> np.ndarray:
    """Which entries are among the first `top` of their run of equal groups."""
    if not len(groups):
        return np.zeros(0, bool)
    start = np.r_[True, groups[1:] != groups[:-1]]
    return np.arange(len(groups)) - np.maximum.accumulate(np.where(start, np.arange(len(groups)), 0)) < top


# The grid


def _cells(rows: DataFrame, anchors: DataFrame, grid: tuple[int, int], work, ddl: str) -> DataFrame:
    """`work` on every pair of a group of anchors and a group of rows."""
    across, down = grid
    share = lambda name, n: F.pmod(F.xxhash64("chunk"), F.lit(n)).cast("int").alias(name)
    every = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = rows.select("*", share("g", down), every("a", across))
    right = anchors.select("*", share("a", across), every("g", down))

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        return work(mine.to_pylist(), theirs.to_pylist())

    importable(rows.sparkSession)
    return left.groupBy("a", "g").cogroup(right.groupBy("a", "g")).applyInArrow(run, ddl)


def _top(found: DataFrame, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("known").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def mine(vectors: DataFrame, every: int = EVERY, grid: tuple[int, int] | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    table = blocks(vectors, every)
    size = {r["kind"]: r for r in table.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("chunks")).collect()}
    if grid is None:
        rows, anchors = (size[k]["n"] if k in size else 0 for k in (0, 1))
        tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        down = max(math.ceil(rows / _ROWS), min(tasks, size[0]["chunks"] if size else 1))
        grid = max(1, math.ceil(anchors / _ANCHORS)), down
    rows, anchors = table.where("kind = 0"), table.where("kind = 1")
    found = _cells(rows, anchors, grid, find_positives, _FOUND)
    best = _top(found, "chunk", "at").withColumnRenamed("rank", "place")
    by_chunk = best.groupBy("chunk").agg(
        F.collect_list(F.struct("at", "place", "id", "known", "score")).alias("positives")
    )
    served = written(anchors.join(by_chunk, "chunk"), "anchors_with_positives")
    mined = _top(_cells(rows, served, grid, find_negatives, _MINED), "chunk", "at", "place")
    real = lambda name, known: F.when(F.col(known), F.col(name))
    return mined.select(
        "anchor_id", real("positive_id", "positive_known").alias("positive_id"), "rank",
        real("id", "known").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )


def query(spark, folder: str) -> DataFrame:
    return mine(spark.read.parquet(f"{folder}/embeddings.parquet"))


ORACLE = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({_SCALE} * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.e, r.e)::BIGINT AS score
  FROM v a, v r WHERE a.vec_id % {EVERY} = 0 AND a.vec_id <> r.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {TOP}
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY rank <= {TOP}
"""
