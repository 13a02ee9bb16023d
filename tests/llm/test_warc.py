"""Packages against the standard library's ZIP reader, and records against what was written."""

from __future__ import annotations

import io
import os
import struct
import zipfile

import pytest

from checks.compare import compare
from tests.conftest import SMALL
from tradeloom.llm import warc, zip_archive

LONG = "<p>" + "long é 漢 " * 300_000
CLASHING = ["cast(null as string) as payload", "cast(null as long) as row", "cast(1 as long) as first_id", "'x' as digest"]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", *CLASHING)


def reader(data):
    return lambda at, n: data[at : at + n]


@pytest.mark.parametrize("zip64", [False, True])
def test_archive_equals_standard_reader(zip64):
    members = [("a/é.txt", b"one"), ("b", b""), ("c", bytes(range(256)) * 900)]
    data = zip_archive.pack(members, b"\n", zip64)
    with zipfile.ZipFile(io.BytesIO(data)) as known:
        assert known.testzip() is None and [(i.filename, known.read(i)) for i in known.infolist()] == members
    found = zip_archive.directory(reader(data), len(data))
    assert [m.name for m in found] == [n for n, _ in members]
    for member, (_, content) in zip(found, members, strict=True):
        at = zip_archive.data_at(reader(data), member)
        assert data[at : at + member.packed] == content


def test_archive_of_another_writer():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as known:
        with known.open(zipfile.ZipInfo("wide"), "w", force_zip64=True) as member:
            member.write(b"w" * 500)
        known.writestr("packed", b"p" * 500, zipfile.ZIP_DEFLATED)
        known.comment = b"PK\x05\x06 a comment that looks like an end record" * 3
    data = out.getvalue()
    wide, packed = zip_archive.directory(reader(data), len(data))
    at = zip_archive.data_at(reader(data), wide)
    assert data[at : at + wide.packed] == b"w" * 500
    with pytest.raises(zip_archive.BadArchive, match="not stored"):
        zip_archive.data_at(reader(data), packed)


def test_many_members_need_zip64():
    data = zip_archive.pack([(str(i), b"") for i in range(70_000)])
    assert data[-zip_archive.END.size - 20 :][:4] == zip_archive.LOCATOR64_SIGN
    assert len(zip_archive.directory(reader(data), len(data))) == 70_000


@pytest.mark.parametrize("cut", [0, 10, 60])
def test_broken_archives_are_named(cut):
    data = zip_archive.pack([("a", b"one")])[:cut]
    with pytest.raises(zip_archive.BadArchive):
        zip_archive.directory(reader(data), len(data))


def test_only_ranges_are_read():
    members = [(warc.DATA, b"\0" * 5_000_000), (warc.INDEX, b"")]
    data, read = zip_archive.pack(members), 0

    def counted(at, n):
        nonlocal read
        read += min(n, len(data) - at)
        return data[at : at + n]

    for member in zip_archive.directory(counted, len(data)):
        zip_archive.data_at(counted, member)
    assert read < 70_000


def test_equals_sql(spark):
    assert compare(spark, SMALL, "op11", warc.query, warc.ORACLE) == ""


def edge_pages():
    shared = "s" * 100
    return [
        (5, "http://a/5", shared), (3, "http://a/3", shared), (3, "http://a/3", shared), (None, "http://a/n", shared),
        (1, None, "x" * 99), (2, "http://b/ \n%20", "x" * 99), (7, "http://c", None), (8, "http://c", ""), (9, "", LONG),
        (10, "http://ü ", "\r\n\r\nWARC/1.1\r\n\r\n" * 9), (11, "u", LONG), (None, "u", "é" * 50), (None, "u", "é" * 50), (None, None, None),
    ]


def test_edges(spark):
    out = [tuple(r) for r in warc.round_trip(pages(spark, edge_pages())).select("page_id", "payload_bytes", "record_type", "refers_to").collect()]
    n = len(LONG.encode())
    assert sorted(out, key=str) == sorted([
        (5, 100, "revisit", 3), (3, 100, "response", None), (3, 100, "revisit", 3), (None, 100, "revisit", 3),
        (1, 99, "response", None), (2, 99, "response", None), (7, 0, "response", None), (8, 0, "response", None),
        (9, n, "response", None), (11, n, "revisit", 9), (10, 144, "response", None),
        (None, 100, "response", None), (None, 100, "revisit", None), (None, 0, "response", None),
    ], key=str)


@pytest.mark.parametrize("zip64", [False, True])
def test_payloads_come_back(spark, tmp_path, zip64):
    """Small packages: many files, every payload as written, by ranges or from whole contents."""
    rows = [(i, f"http://h/{i}", f"<html>{i}" + "y" * (i * 37 % 500)) for i in range(400)]
    folder = str(tmp_path / "out")
    warc.write_packages(pages(spark, rows), folder, 2_000, zip64)
    names = [n for n in os.listdir(folder) if n.startswith("part-")]
    assert len(names) > 5
    for name in names:
        assert zipfile.ZipFile(f"{folder}/{name}").testzip() is None
    got = warc.read_packages(spark, folder).collect()
    assert sorted((r["page_id"], r["url"], r["payload"].decode()) for r in got) == rows
    for name in names[:3]:
        with open(f"{folder}/{name}", "rb") as file:
            whole = file.read()
        for r in got:
            if r["path"].endswith(name):
                assert warc.parsed(whole[r["offset"] : r["offset"] + r["length"]])[-1] == r["payload"]


def test_package_without_index():
    one, two = warc._Package(), warc._Package()
    for i in range(20):
        for package in (one, two):
            package.add("u", "d", "response", b"r%d" % i * (i * 997))
    data = zip_archive.pack([(warc.DATA, bytes(two.data))])
    plain = one.close(False)
    found = [list(warc._index(reader(d), zip_archive.directory(reader(d), len(d)))) for d in (plain, data)]
    assert len(found[0]) == 20 and [n for _, n in found[0]] == [n for _, n in found[1]] and found[0] == found[1]


def test_damage_is_reported():
    import hashlib

    whole = warc.record(1, 0, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    import gzip

    assert warc.parsed(gzip.compress(whole))[:2] == ("response", 1)
    with pytest.raises(zip_archive.BadArchive, match="damaged"):
        warc.parsed(gzip.compress(whole.replace(b"payload\r\n", b"paXload\r\n")))
    place = b'u 1 {"offset": 0, "length": 9, "filename": "%s"}\n' % warc.DATA.encode()
    data = zip_archive.pack([(warc.DATA, b"short"), (warc.INDEX, place)])
    with pytest.raises(zip_archive.BadArchive, match="outside"):
        list(warc._index(reader(data), zip_archive.directory(reader(data), len(data))))


def test_empty(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_wide_tables_of_shared_payloads(spark, forced):
    """The plan for tables of shared payloads that are too large to broadcast."""
    rows = [(i, "u", ("hot" if i % 3 else f"p{i % 50} ") * 60) for i in range(600)]
    first = {}
    for i, _, html in rows:
        first.setdefault(html, i)
    got = {r["page_id"]: r["refers_to"] for r in warc.round_trip(pages(spark, rows)).collect()}
    assert got == {i: None if first[h] == i else first[h] for i, _, h in rows}


def test_end_fields_are_little_endian():
    data = zip_archive.pack([("a", b"one")], b"\n")
    assert struct.unpack_from("<H", data, len(data) - 3)[0] == 1
