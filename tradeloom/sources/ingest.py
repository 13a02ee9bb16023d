"""CSV files into typed tables: text read, projection, casts, key and reference checks.

A load has insert-ignore semantics: the first row of a key wins, keys already stored are
left alone, and loading the same file again changes nothing. Every row that is read is accounted
for: loaded, malformed, without a key, a duplicate, an orphan or already stored.
"""

from __future__ import annotations

import csv
import logging
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeloom.operators.bitmaps import may_be_among
from tradeloom.operators.scratch import discard, scratch_path, written
from tradeloom.operators.sizing import dealt, tasks_for, within
from tradeloom.operators.skew import SALT, HotKeys, find_hot_keys, spread_join
from tradeloom.schemas import TABLES, TableSpec
from tradeloom.sources import csv_records, snapshots
from tradeloom.sources.files import find, is_stored, read_table, stored_schema, table_path, write_load
from tradeloom.sources.snapshots import FATE, LOADED

_CONCURRENT = 4
_OPEN_AT_ONCE = 32
POSITION = "_position"
REJECTED = "_rejected"
MALFORMED = "_malformed"
_HASH, _REPEATED = "_key_hash", "_repeated"
_MANY_COPIES = 100_000  # of one key, which a task can hold
_LOG = logging.getLogger(__name__)


def _first_line(spark: SparkSession, path: str) -> str:
    """The header line of one file, on whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        reader = spark._jvm.java.io.InputStreamReader(stream, "UTF-8")
        return (spark._jvm.java.io.BufferedReader(reader).readLine() or "").removeprefix("\ufeff")
    finally:
        stream.close()


def _part_files(spark: SparkSession, path: str) -> list[str]:
    """The data files behind a file, a folder of part files, or a pattern."""
    found = []
    for p in find(spark, path):
        inside = find(spark, f"{p.rstrip('/')}/*")
        found += [f for f in inside if not f.rpartition("/")[2].startswith(("_", "."))] if inside else [p]
    return found


def read_text(spark: SparkSession, path: str | list[str], multiline: bool = False) -> DataFrame:
    """All columns as text under their header names; quotes are doubled inside quotes.

    Part files may order their columns differently: files are read by groups of equal headers.
    A row whose number of fields is not that of its header is marked in `MALFORMED`. Files with
    free text need `multiline`: their quoted fields may hold line breaks, and a first pass over
    them finds where records begin (see `csv_records`).
    """
    files = [f for one in ([path] if isinstance(path, str) else path) for f in _part_files(spark, one)]
    groups: dict[str, list[str]] = {}
    with ThreadPoolExecutor(_OPEN_AT_ONCE) as pool:
        for file, header in zip(files, pool.map(lambda f: _first_line(spark, f), files), strict=True):
            groups.setdefault(header, []).append(file)
    frames = []
    for header, members in groups.items():
        names = next(csv.reader([header]), [])
        if names:
            frames.append((_read_records if multiline else _read_lines)(spark, members, names))
    if not frames:
        return spark.createDataFrame([], T.StructType([T.StructField(MALFORMED, T.StringType())]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _read_lines(spark: SparkSession, files: list[str], names: list[str]) -> DataFrame:
    fields = [T.StructField(name, T.StringType()) for name in [*names, MALFORMED]]
    return with_position(
        spark.read.csv(
            files, schema=T.StructType(fields), header=True, enforceSchema=True, quote='"', escape='"',
            encoding="UTF-8", mode="PERMISSIVE", columnNameOfCorruptRecord=MALFORMED,
        )
    )


def _read_records(spark: SparkSession, files: list[str], names: list[str]) -> DataFrame:
    found = csv_records.records(spark, files)
    parsed = found.select(csv_records.fields(F.col("text"), names, MALFORMED).alias("fields"), F.struct("file", "block", "row").alias(POSITION))
    return parsed.select("fields.*", POSITION)


def with_position(raw: DataFrame) -> DataFrame:
    """Add the place of each row in its files, which orders rows as they were written."""
    return raw.select(
        "*",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias(POSITION),
    )


def project(raw: DataFrame, spec: TableSpec) -> DataFrame:
    """The declared columns that the file has, in declared order, under their file names."""
    file_names = {column: name for name, column in spec.renames.items()}
    declared = (file_names.get(column, column) for column in spec.columns)
    return raw.select([name for name in declared if name in raw.columns])


def rename(df: DataFrame, spec: TableSpec) -> DataFrame:
    return df.withColumnsRenamed(spec.renames)


def empty_to_null(df: DataFrame) -> DataFrame:
    """Empty text becomes NULL; any other text, `NA` included, stays."""
    return df.select(
        *(
            F.nullif(F.col(f.name), F.lit("")).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in df.schema
        )
    )


def typed(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Cast text to the declared types. Text that does not fit becomes NULL and its column
    is listed in the row's `REJECTED` array; columns the file lacks are NULL."""

    def cast(field: T.StructField) -> Column:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        return value.try_cast(field.dataType).alias(field.name)

    def reject(field: T.StructField) -> Column:
        text = F.col(field.name)
        failed = text.isNotNull() & text.try_cast(field.dataType).isNull()
        return F.when(failed, F.lit(field.name))

    checked = [f for f in spec.schema if f.name in df.columns]
    extra = [c for c in df.columns if c not in spec.columns]
    rejected = F.array_compact(F.array(*(reject(f) for f in checked))).alias(REJECTED)
    return df.select(*(cast(f) for f in spec.schema), rejected, *extra)


def first_per_key(df: DataFrame, key: tuple[str, ...], order: Column | None = None) -> DataFrame:
    """The first row of each key by `order`, or the least row if there is no order.

    Rows are not moved to find out that their key is theirs alone: hashes of the keys are counted,
    and only rows of a repeated hash are moved and chosen from (two keys of one hash cost a choice,
    nothing more). With too many repeated hashes for a lookup a bitmap tells most rows that are not
    among them; those it does not tell are moved for nothing. The choice is an aggregate rather than
    a numbering window: copies of a key collapse on the map side where a key has very many.
    """
    hashed = df.withColumn(_HASH, F.xxhash64(*key))
    counts = hashed.groupBy(_HASH).agg(F.count("*").alias("rows"))
    repeated = written(counts.where("rows > 1"), "repeated_keys")
    found = repeated.agg(F.count("*").alias("hashes"), F.max("rows").alias("most")).first()
    if not found["hashes"]:
        return df
    if within(repeated, "spark.tradeloom.broadcastBytes"):
        known = F.broadcast(repeated.select(_HASH, F.lit(True).alias(_REPEATED)))
        marked = hashed.join(known, _HASH, "left").withColumn(_REPEATED, F.col(_REPEATED).isNotNull())
    else:
        marked = may_be_among(hashed, repeated, _HASH, found["hashes"], _REPEATED)
    alone = marked.where(~F.col(_REPEATED)).select(df.columns)
    some = marked.where(_REPEATED).select(*df.columns, _HASH)
    if found["most"] <= _MANY_COPIES:
        some = dealt(some, tasks_for(some), _HASH)
    return alone.unionByName(_chosen(some, key, order).select(df.columns))


def _chosen(df: DataFrame, key: tuple[str, ...], order: Column | None) -> DataFrame:
    """Grouped by the hash too, by which rows may have been dealt."""
    row = F.struct(*(c for c in df.columns if c not in key and c != _HASH))
    first = F.min(row) if order is None else F.min_by(row, order)
    grouped = df.groupBy(_HASH, *key).agg(first.alias("row"))
    return grouped.select(*(F.col(c) if c in key else F.col(f"row.{c}") for c in df.columns if c != _HASH))


def _marked(
    df: DataFrame, parents: DataFrame, column: str, id_column: str, hot: HotKeys | None
) -> DataFrame:
    if hot is None:
        hot = find_hot_keys(df, column)
    known = parents.select(column).distinct().withColumn("_known", F.lit(True))
    return spread_join(df, known, column, hot, [id_column], "left").drop(SALT)


def with_parent(
    df: DataFrame, parents: DataFrame, column: str, id_column: str, hot: HotKeys | None = None
) -> DataFrame:
    """Rows whose `column` is in `parents`, or NULL (a missing reference breaks no rule).

    `hot` may come from an input of `df`, which is cheaper to look through.
    """
    kept = F.col("_known").isNotNull() | F.col(column).isNull()
    return _marked(df, parents, column, id_column, hot).where(kept).select(df.columns)


def orphans(
    df: DataFrame, parents: DataFrame, column: str, id_column: str, hot: HotKeys | None = None
) -> DataFrame:
    lost = F.col("_known").isNull() & F.col(column).isNotNull()
    return _marked(df, parents, column, id_column, hot).where(lost).select(df.columns)


def stage(raw: DataFrame, spec: TableSpec) -> DataFrame:
    """Typed rows with their position, rejects and whether they are malformed, for the key checks."""
    positions = raw if POSITION in raw.columns else with_position(raw)
    extra = [c for c in (POSITION, MALFORMED) if c in positions.columns]
    named = project(raw, spec).columns
    return typed(empty_to_null(rename(positions.select(*named, *extra), spec)), spec)


def bulk_read(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    """Fields by position instead of by header name; the header line is passed over."""
    text = T.StructType([T.StructField(c, T.StringType()) for c in spec.columns])
    return spark.read.csv(
        path,
        schema=text,
        header=True,
        enforceSchema=True,
        quote='"',
        escape='"',
        multiLine=spec.multiline,
    )


def bulk_load(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    return typed(empty_to_null(bulk_read(spark, path, spec)), spec).drop(REJECTED)


@dataclass
class LoadStatus:
    """rows_read is the sum of the other rows_ counts; rejects lists column:values that did not fit."""

    table_name: str
    status: str
    rows_read: int = 0
    rows_malformed: int = 0
    rows_without_key: int = 0
    rows_duplicate: int = 0
    rows_orphan: int = 0
    rows_stored: int = 0
    rows_loaded: int = 0
    values_rejected: int = 0
    rejects: str = ""


_STATUS_TYPES = (
    "table_name string, status string, rows_read bigint, rows_malformed bigint,"
    " rows_without_key bigint, rows_duplicate bigint, rows_orphan bigint, rows_stored bigint,"
    " rows_loaded bigint, values_rejected bigint, rejects string"
)


def load_table(spark: SparkSession, source: str, target: str, spec: TableSpec) -> LoadStatus:
    """Load one file, or one folder of part files, into the table's folder."""
    paths = find(spark, f"{source}/{spec.file_glob}")
    if not paths:
        return LoadStatus(spec.name, "skipped: no file")
    raw = read_text(spark, paths, spec.multiline)
    if raw.isEmpty():
        return LoadStatus(spec.name, "skipped: empty")
    # Parsed once; the counts and the checks below read the staged columns they need.
    path = scratch_path(spark, f"stage_{spec.name}")
    stage(raw, spec).write.option("compression", "zstd").parquet(path)
    try:
        return _load_staged(spark, spark.read.parquet(path), target, spec)
    finally:
        discard(spark, path)


def _load_staged(spark: SparkSession, staged: DataFrame, target: str, spec: TableSpec) -> LoadStatus:
    sound = F.col(MALFORMED).isNull()
    has_key = sound & reduce(and_, (F.col(c).isNotNull() for c in spec.key))
    rejects = [F.count_if(has_key & F.array_contains(REJECTED, c)).alias(f"reject_{c}") for c in spec.columns]
    own_key = F.when(has_key, F.col(spec.key[0]))
    counts = staged.agg(
        F.count("*").alias("read"),
        F.count_if(~sound).alias("malformed"),
        F.count_if(sound & ~has_key).alias("without_key"),
        F.min(own_key).alias("least"),
        F.max(own_key).alias("greatest"),
        *rejects,
    ).first()
    rejected = {c: counts[f"reject_{c}"] for c in spec.columns if counts[f"reject_{c}"]}
    keyed = counts["read"] - counts["malformed"] - counts["without_key"]

    keyed_rows = staged.where(has_key)
    first = first_per_key(keyed_rows.select(*spec.columns, POSITION), spec.key, F.col(POSITION)).select(spec.columns)
    fate = first.withColumn(FATE, F.lit(LOADED))
    if spec.parent is not None:
        column, parent = spec.parent
        parents = spark.createDataFrame([], TABLES[parent].schema)
        if is_stored(spark, target, parent):
            parents = read_table(spark, target, parent)
        # Only ids are moved to find the lost ones, which are few in a sound file.
        asked = keyed_rows.select(column).where(F.col(column).isNotNull()).distinct()
        unknown = written(asked.join(parents.select(column).distinct(), column, "left_anti"), "unknown_parents")
        if within(unknown, "spark.tradeloom.broadcastBytes"):
            marked = first.join(F.broadcast(unknown.withColumn("_lost", F.lit(True))), column, "left")
            lost = F.col("_lost").isNotNull()
        else:
            marked = _marked(first, parents, column, spec.key[0], find_hot_keys(staged, column))
            lost = F.col("_known").isNull() & F.col(column).isNotNull()
        fate = marked.select(*spec.columns, F.when(lost, "orphan").otherwise(LOADED).alias(FATE))
    table = table_path(target, spec.name)
    seen = snapshots.current(spark, table)
    stored = stored_keys(spark, target, spec, (counts["least"], counts["greatest"]))
    if stored is not None:
        # Stored keys are reduced by the new ones first, so a small file moves few of them.
        there = stored.join(fate.select(*spec.key), list(spec.key), "left_semi").distinct().withColumn("_there", F.lit(True))
        met = F.when((F.col(FATE) == LOADED) & F.col("_there").isNotNull(), "stored").otherwise(F.col(FATE))
        fate = fate.join(there, list(spec.key), "left").select(*spec.columns, met.alias(FATE))

    # The checked rows are written once, each with what became of it, and counted from the files'
    # footers. What is not loaded keeps no values and goes before the load is published.
    loaded = F.col(FATE) == LOADED
    lean = fate.select(*(F.when(loaded, F.col(c)).alias(c) for c in spec.columns), FATE)
    path = snapshots.new_load(table, seen)
    write_load(lean, path, spec.name)
    written_rows = snapshots.read_load(spark, path, stored_schema(spec.name))
    fates = {r[FATE]: r["count"] for r in written_rows.groupBy(FATE).count().collect()}
    for other in fates:
        if other != LOADED:
            discard(spark, f"{path}/{FATE}={other}")
    if fates.get(LOADED) or stored is None:
        load = snapshots.described(spark, path, stored_schema(spec.name), spec.key[0])
        snapshots.publish(spark, table, seen, (*(seen.loads if seen else ()), load))
    else:
        discard(spark, path)
    return LoadStatus(
        spec.name, "loaded", counts["read"], counts["malformed"], counts["without_key"],
        keyed - sum(fates.values()), fates.get("orphan", 0), fates.get("stored", 0), fates.get(LOADED, 0),
        sum(rejected.values()), ",".join(f"{c}:{n}" for c, n in rejected.items()),
    )


def stored_keys(spark: SparkSession, target: str, spec: TableSpec, between: tuple[str | None, str | None]) -> DataFrame | None:
    """Stored keys that can meet new ones of this range, None if there is no such table yet.

    Loads whose key range lies elsewhere are not read, nor are row groups inside the others.
    """
    table = table_path(target, spec.name)
    seen = snapshots.current(spark, table)
    if seen is None:
        if snapshots.is_plain(spark, table):
            raise ValueError(f"{table} has no versions; store its rows with files.replace_table elsewhere first")
        return None
    keys = snapshots.read(spark, table, seen, spec.schema, between).select(*spec.key)
    return keys.where(F.col(spec.key[0]).between(*between)) if between[0] is not None else keys.limit(0)


def load_folder(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Load every known file; one table's failure leaves the others alone.

    Tables are independent jobs but for their parents, so those without one go first and a
    few tables load at a time.
    """

    def load(spec: TableSpec) -> LoadStatus:
        try:
            return load_table(spark, source, target, spec)
        except Exception as error:
            _LOG.exception("loading %s failed", spec.name)
            return LoadStatus(spec.name, f"error: {type(error).__name__}: {error}"[:500])

    found: dict[str, LoadStatus] = {}
    with ThreadPoolExecutor(_CONCURRENT) as pool:
        for children in (False, True):
            wave = [s for s in TABLES.values() if (s.parent is not None) == children]
            found |= {status.table_name: status for status in pool.map(load, wave)}
    rows = [tuple(vars(found[name]).values()) for name in TABLES]
    return spark.createDataFrame(rows, _STATUS_TYPES)
