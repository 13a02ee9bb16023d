"""CSV records with line breaks, cut by byte ranges, against Spark's reader of whole files."""

from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import rows
from tradeloom.sources import csv_records, ingest

NAMES = ["a", "b", "c"]


def whole(spark, path):
    """The same files, each read by one task."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*NAMES, ingest.MALFORMED]])
    return spark.read.csv(
        path, schema=schema, header=True, enforceSchema=True, quote='"', escape='"', multiLine=True, encoding="UTF-8",
        mode="PERMISSIVE", columnNameOfCorruptRecord=ingest.MALFORMED,
    )


def taken(df):
    """Fields of sound rows, and how many rows are malformed."""
    bad = F.col(ingest.MALFORMED).isNotNull()
    found = df.select(*NAMES, bad.alias("bad")).collect()
    return sorted((tuple(r[:3]) for r in found if not r.bad), key=str), sum(r.bad for r in found)


@pytest.fixture
def ranges_of(spark):
    """Set how many bytes a task reads."""

    def set_to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield set_to
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def reviews(rng, n, newline="\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=newline)
    writer.writerow(NAMES)
    for i in range(n):
        text = "".join(rng.choice(['"', ",", "\n", "word ", "é ", "", '""', '",', ',"', '\n"', '"\n']) for _ in range(rng.randrange(12)))
        writer.writerow([f"r{i}", text, rng.choice(["", "x", "long " * rng.randrange(40), "\n" * rng.randrange(1, 60)])])
    return out.getvalue()


def reference_states(text):
    """Whether each line of the text ends inside of quotes, letter by letter."""
    state, out = "start", []
    for char in text:
        if char == "\n" and state != "in":
            out.append(False)
            state = "start"
        elif char == "\n":
            out.append(True)
        elif state == "in":
            state = "quote" if char == '"' else "in"
        elif char == ",":
            state = "start"
        elif state == "quote" and char == '"':
            state = "in"
        elif state == "start" and char == '"':
            state = "in"
        else:
            state = "plain"
    return out


@pytest.mark.parametrize("seed", range(30))
def test_states_letter_by_letter(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice('",\nab') for _ in range(400)) + "\n"
    state, got = False, []
    for line in text.encode().split(b"\n")[:-1]:
        state = csv_records.inside_after(line, state)
        got.append(state)
    # A quote that ends a line inside a field is the close of it only if the next line is outside.
    assert got == reference_states(text)


@pytest.mark.parametrize("size", [40, 111, 1000, 1 << 20])
@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_equals_reading_whole_files(spark, tmp_path, ranges_of, size, newline):
    for part in range(3):
        text = reviews(random.Random(part), 120, newline)
        (tmp_path / f"{part}.csv").write_bytes(text.encode().removesuffix(newline.encode()) if part == 1 else text.encode())
    wanted = taken(whole(spark, str(tmp_path)))
    ranges_of(size)
    got = ingest.read_text(spark, str(tmp_path), multiline=True)
    assert taken(got) == wanted and len(wanted[0]) == 360


def test_one_file_is_read_by_several_tasks(spark, tmp_path, ranges_of):
    (tmp_path / "one.csv").write_text(reviews(random.Random(7), 400))
    ranges_of(2000)
    got = ingest.read_text(spark, str(tmp_path / "one.csv"), multiline=True)
    assert got.rdd.getNumPartitions() > 4 and got.count() == 400
    # Positions follow the file.
    in_order = [r["a"] for r in got.orderBy(ingest.POSITION).collect()]
    assert in_order == [f"r{i}" for i in range(400)]


def test_a_field_longer_than_many_ranges(spark, tmp_path, ranges_of):
    long = "line, with \"\" quotes\n" * 300
    (tmp_path / "x.csv").write_text(f'a,b,c\n1,"{long}",y\n2,,\n\n3,"z","{long}"\n4,5,6\n')
    ranges_of(64)
    got = {r["a"]: r for r in rows(ingest.read_text(spark, str(tmp_path), multiline=True))}
    plain = long.replace('""', '"')
    assert got["1"]["b"] == plain and got["3"]["c"] == plain and got["4"]["c"] == "6" and set(got) == {"1", "2", "3", "4"}


@pytest.mark.parametrize("size", [7, 1 << 20])
def test_malformed_rows_and_odd_quotes(spark, tmp_path, ranges_of, size):
    text = 'a,b,c\n1,2\n5" wide,"a"b,c\n  \n1,2,3,4\n"q\nq",x"y,""\n"open,1,2\nto the end'
    (tmp_path / "x.csv").write_text(text)
    wanted = taken(whole(spark, str(tmp_path)))
    ranges_of(size)
    assert taken(ingest.read_text(spark, str(tmp_path), multiline=True)) == wanted


def test_ranges_too_many_to_broadcast(spark, tmp_path, ranges_of, forced):
    (tmp_path / "x.csv").write_text(reviews(random.Random(5), 200))
    wanted = taken(whole(spark, str(tmp_path)))
    ranges_of(150)
    assert taken(ingest.read_text(spark, str(tmp_path), multiline=True)) == wanted


def test_header_only_and_header_over_lines(spark, tmp_path, ranges_of):
    ranges_of(6)
    (tmp_path / "x.csv").write_text('a,b,c')
    assert ingest.read_text(spark, str(tmp_path / "x.csv"), multiline=True).count() == 0
