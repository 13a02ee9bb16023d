"""CSV files whose quoted fields may hold line breaks, read by many tasks per file.

A byte range of such a file cannot tell whether it begins inside a quoted field. Each range
therefore says in a first pass what it does to either answer: where the text stands after it if it
was entered outside of quotes, and if inside. Chaining these over the ranges of a file (a prefix
xor, where a range without a decided answer keeps or swaps the state) gives every range's true
entry. In the second pass all records inside a range are cut in place, without a shuffle; only
the pieces of records that cross a border are shuffled, by the range in which the record began.

Fields, quotes, empty lines and malformed rows come out as from Spark's own reader of whole files
(`multiLine`): a quote opens a field only at its start, and a field that goes on after its closing
quote ends at the next comma. Lines end in "\\n" or "\\r\\n", whichever the header line ends in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradeloom.operators.scratch import written
from tradeloom.operators.sizing import within

Batches = Iterator[pa.RecordBatch]

_RANGE = ["file", "block"]
_QUOTED = rb'[^"]*+(?:""[^"]*+)*+'  # what may stand between the quotes of a field
_AFTER = rb'(?:[^",][^,]*+)?+'  # text that follows a closing quote in the same field
_FIELD = rb'(?:(?:[^",][^,]*+)?+|"' + _QUOTED + rb'"' + _AFTER + rb")"
#: A line entered outside of quotes that ends inside.
_OPENS = re.compile(rb"(?:" + _FIELD + rb",)*+\"" + _QUOTED, re.DOTALL)
#: A line entered inside of quotes that ends inside: no quote ends the field, or a later one opens another.
_STAYS = re.compile(_QUOTED + rb"(?:\Z|\"" + _AFTER + rb",(?:" + _FIELD + rb",)*+\"" + _QUOTED + rb")", re.DOTALL)


def inside_after(line: bytes, inside: bool) -> bool:
    """Whether the end of the line is inside of quotes."""
    if b'"' not in line:
        return inside
    return (_STAYS if inside else _OPENS).fullmatch(line) is not None


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, block, line): the lines in their order, with the byte range that they were read by."""
    text = spark.read.format("text").option("lineSep", "\n").load(files)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"),
    )


def _runs(batches: Batches) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Parts of the batches that belong to one byte range, with that range."""
    for batch in batches:
        files, blocks = batch.column("file"), batch.column("block")
        at = 0
        while at < batch.num_rows:
            file, block = files[at].as_py(), blocks[at].as_py()
            same = pc.and_(pc.equal(files.slice(at), file), pc.equal(blocks.slice(at), block))
            n = pc.index(same, False).as_py()
            n = len(same) if n < 0 else n
            yield (file, block), batch.slice(at, n)
            at += n


_EFFECT = "file string, block long, out0 boolean, out1 boolean, starts1 boolean, cr boolean"


def _effects(batches: Batches) -> Batches:
    """Per byte range: the state after it by the state before it, whether a record starts in it if
    it is entered inside of quotes, and whether its first line ends in a carriage return."""
    key, state = None, None
    done = []
    for found, part in _runs(batches):
        lines = part.column("line")
        if found != key:
            key, state = found, [False, True, False, lines[0].as_py().endswith(b"\r")]
            done.append((key, state))
        before = 0
        for i in pc.indices_nonzero(pc.match_substring(lines, '"')).to_pylist():
            state[2] |= not state[1]
            line, before = lines[i].as_py(), i + 1
            state[0], state[1] = inside_after(line, state[0]), inside_after(line, state[1])
        state[2] |= before < len(lines) and not state[1]
        if len(done) > 1000:
            yield _effect_batch(done[:-1])
            done = done[-1:]
    if done:
        yield _effect_batch(done)


def _effect_batch(done: list) -> pa.RecordBatch:
    rows = [(*key, *state) for key, state in done]
    return pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=["file", "block", "out0", "out1", "starts1", "cr"])


def entries(effects: DataFrame) -> DataFrame:
    """(file, block, inside, exits, owner, cr) per byte range: whether it is entered inside of
    quotes and left so, the range in which the record it is entered in began, and the line ends.

    A window per file over one row per byte range.
    """
    in_order = Window.partitionBy("file").orderBy("block")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    decided = F.col("out0") == F.col("out1")
    swaps = (F.col("out0") & ~F.col("out1")).cast("int")
    marked = effects.withColumn("turns", F.sum(swaps).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    last = lambda value: F.last(F.when(decided, value), ignorenulls=True).over(earlier)
    turned = F.coalesce(F.last("turns").over(earlier), F.lit(0)) - F.coalesce(last(F.col("turns")), F.lit(0))
    base = F.coalesce(last(F.col("out0").cast("int")), F.lit(0))
    entered = marked.withColumn("inside", (base + turned) % 2 == 1)
    starts = F.when(~F.col("inside") | F.col("starts1"), F.col("block"))
    return entered.select(
        *_RANGE, "inside", F.when(F.col("inside"), F.col("out1")).otherwise(F.col("out0")).alias("exits"),
        F.last(starts, ignorenulls=True).over(earlier).alias("owner"), F.first("cr").over(in_order).alias("cr"),
    )


_RECORDS = "file string, block long, row long, text binary, owner long, cr boolean"


def _cut(whole: bool):
    """The records that lie inside their byte range, or else the pieces of those that do not."""

    def run(batches: Batches) -> Batches:
        key, record, rows = None, None, []
        number = 0

        def close(owner: int | None) -> None:
            start, lines = record
            if whole == (owner is None):
                rows.append((*key, start, b"\n".join(lines), owner, cr))

        def leave() -> None:
            # What is open at the end of a range goes on in the next one.
            if record is not None:
                close(owner if record[0] < 0 else key[1])

        for found, part in _runs(batches):
            if found != key:
                leave()
                key, number = found, 0
                inside, owner, cr = (part.column(c)[0].as_py() for c in ("inside", "owner", "cr"))
                record = (-1, []) if inside else None
            for line in part.column("line").to_pylist():
                if record is None:
                    record, inside = (number, []), False
                record[1].append(line)
                inside = inside_after(line, inside)
                if not inside:
                    close(None if record[0] >= 0 else owner)
                    record = None
                number += 1
            if len(rows) >= 10_000:
                yield _record_batch(rows)
                rows = []
        leave()
        if rows:
            yield _record_batch(rows)

    return run


_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()]
_NAMES = ["file", "block", "row", "text", "owner", "cr"]


def _record_batch(rows: list) -> pa.RecordBatch:
    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), _KINDS, strict=True)]
    return pa.record_batch(columns, names=_NAMES)


def _in_ranges(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """The lines of the given byte ranges, in order, with what `entries` says of the range."""
    if within(ranges, "spark.tradeloom.broadcastBytes"):
        return lines.join(F.broadcast(ranges), _RANGE)
    numbered = lines.withColumn("line_no", F.monotonically_increasing_id())
    joined = numbered.join(ranges.hint("merge"), _RANGE)
    return joined.repartition(*_RANGE).sortWithinPartitions(*_RANGE, "line_no").drop("line_no")


def records(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, block, row, text): every record but the header of each file, as text.

    (block, row) orders the records of a file: the byte range and the line in it where one starts.
    """
    lines = _lines(spark, files)
    ranges = written(entries(lines.mapInArrow(_effects, _EFFECT)), "csv_ranges")
    cut = _in_ranges(lines, ranges).mapInArrow(_cut(whole=True), _RECORDS).drop("owner")
    crossed = ranges.where("inside or exits")
    if crossed.take(1):
        pieces = _in_ranges(lines, crossed).mapInArrow(_cut(whole=False), _RECORDS)
        piece = F.struct("block", "row", F.col("text").cast("string").alias("text"))
        joined = pieces.groupBy("file", F.col("owner").alias("from"), "cr").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
        text = F.array_join(F.transform("pieces", lambda p: p["text"]), "\n").cast("binary")
        cut = cut.unionByName(
            joined.select("file", F.col("from").alias("block"), F.col("pieces")[0]["row"].alias("row"), text.alias("text"), "cr")
        )
    text = F.col("text").cast("string")
    text = F.when(F.col("cr"), F.replace(F.regexp_replace(text, "\r$", ""), F.lit("\r\n"), F.lit("\n"))).otherwise(text)
    body = cut.where("block <> 0 or row <> 0").select("file", "block", "row", text.alias("text"))
    return body.where("text <> ''")


def fields(text: Column, names: list[str], malformed: str) -> Column:
    """The record's fields by name, with the whole record in `malformed` if their number is another."""
    quoted = ["`" + name.replace("`", "``") + "` string" for name in [*names, malformed]]
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": malformed}
    return F.from_csv(text, ", ".join(quoted), options)
