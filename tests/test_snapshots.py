"""Loads are seen whole or not at all."""

from __future__ import annotations

import glob
import json
import os

import pytest

from tests.conftest import rows
from tests.test_skew import plan
from tradeloom.schemas import TABLES
from tradeloom.sources import files, ingest, snapshots

SELLERS = TABLES["sellers"]
HEADER = "seller_id,seller_zip_code_prefix,seller_city,seller_state\n"


def load(spark, tmp_path, ids, name="in", city="x"):
    folder = tmp_path / f"{name}-{len(os.listdir(tmp_path))}"
    folder.mkdir()
    (folder / "a_sellers_dataset.csv").write_text(HEADER + "".join(f"{i},1,{city},AA\n" for i in ids))
    return ingest.load_table(spark, str(folder), str(tmp_path / "out"), SELLERS)


def stored(spark, tmp_path):
    return {r["seller_id"]: r["seller_city"] for r in rows(files.read_table(spark, str(tmp_path / "out"), "sellers"))}


def names(first, last):
    return [f"s{i:04}" for i in range(first, last)]


def table(tmp_path):
    return str(tmp_path / "out" / "sellers")


@pytest.mark.parametrize("step", ["described", "publish"])
def test_a_load_that_dies_before_the_switch_changes_nothing(spark, tmp_path, monkeypatch, step):
    with monkeypatch.context() as broken:
        broken.setattr(snapshots, step, lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            load(spark, tmp_path, names(0, 5))
    assert not files.is_stored(spark, str(tmp_path / "out"), "sellers")
    with pytest.raises(FileNotFoundError):
        files.read_table(spark, str(tmp_path / "out"), "sellers")
    assert load(spark, tmp_path, names(0, 3)).rows_loaded == 3
    with monkeypatch.context() as broken:
        broken.setattr(snapshots, step, lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            load(spark, tmp_path, names(0, 9))
    assert set(stored(spark, tmp_path)) == set(names(0, 3))
    status = load(spark, tmp_path, names(0, 9))
    assert (status.rows_stored, status.rows_loaded) == (3, 6)
    assert set(stored(spark, tmp_path)) == set(names(0, 9))
    # What the dead loads left goes with a clean, and the table stays.
    gone = snapshots.clean(spark, table(tmp_path))
    assert sum(n.startswith("load=") for n in gone) == 2 and len(glob.glob(f"{table(tmp_path)}/load=*")) == 2
    assert set(stored(spark, tmp_path)) == set(names(0, 9)) and snapshots.clean(spark, table(tmp_path)) == []


def test_a_reader_keeps_its_version(spark, tmp_path):
    load(spark, tmp_path, names(0, 4))
    before = files.read_table(spark, str(tmp_path / "out"), "sellers")
    load(spark, tmp_path, names(4, 8))
    assert before.count() == 4 and len(stored(spark, tmp_path)) == 8


def test_of_two_writers_one_publishes(spark, tmp_path):
    load(spark, tmp_path, names(0, 4))
    seen = snapshots.current(spark, table(tmp_path))
    load(spark, tmp_path, names(4, 8))
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark, table(tmp_path), seen, seen.loads)
    assert len(stored(spark, tmp_path)) == 8
    assert all(n.endswith((".json", ".json.crc")) for n in os.listdir(f"{table(tmp_path)}/_snapshots"))


def test_versions_say_what_they_hold(spark, tmp_path):
    load(spark, tmp_path, names(0, 4))
    load(spark, tmp_path, [*names(2, 4), *names(6, 9)])
    seen = snapshots.current(spark, table(tmp_path))
    assert (seen.version, seen.rows) == (2, 7)
    assert [(e.rows, e.least, e.greatest) for e in seen.loads] == [(4, "s0000", "s0003"), (3, "s0006", "s0008")]
    for entry in seen.loads:
        found = [os.path.getsize(f) for f in glob.glob(f"{table(tmp_path)}/{entry.folder}/**/*.parquet", recursive=True)]
        assert entry.bytes >= sum(found) > 0 and entry.files >= len(found)
    with open(sorted(glob.glob(f"{table(tmp_path)}/_snapshots/*.json"))[-1]) as file:
        assert json.load(file)["version"] == 2


def test_an_idle_reload_publishes_nothing(spark, tmp_path):
    load(spark, tmp_path, names(0, 4))
    assert load(spark, tmp_path, names(0, 4)).rows_stored == 4
    assert snapshots.current(spark, table(tmp_path)).version == 1 and len(glob.glob(f"{table(tmp_path)}/load=*")) == 1


def test_key_ranges_cut_the_stored_keys_that_are_read(spark, tmp_path):
    for first in (0, 100, 200):
        load(spark, tmp_path, names(first, first + 50))
    seen = snapshots.current(spark, table(tmp_path))
    some = ingest.stored_keys(spark, str(tmp_path / "out"), SELLERS, ("s0120", "s0130"))
    text = plan(some)
    assert seen.loads[1].folder in str(some.inputFiles()) and len(some.inputFiles()) < len(seen.loads) * 8
    assert not any(e.folder in str(some.inputFiles()) for e in (seen.loads[0], seen.loads[2]))
    assert "GreaterThanOrEqual(seller_id,s0120)" in text and "LessThanOrEqual(seller_id,s0130)" in text
    assert {r["seller_id"] for r in rows(some)} == set(names(120, 131))
    assert ingest.stored_keys(spark, str(tmp_path / "out"), SELLERS, ("s0060", "s0070")).count() == 0
    status = load(spark, tmp_path, ["s0010", "s0075", "s0249"])
    assert (status.rows_stored, status.rows_loaded) == (2, 1) and len(stored(spark, tmp_path)) == 151


def test_a_table_is_replaced_in_one_step(spark, tmp_path):
    load(spark, tmp_path, names(0, 4))
    old = files.read_table(spark, str(tmp_path / "out"), "sellers")
    files.replace_table(old.limit(2), str(tmp_path / "out"), "sellers")
    assert old.count() == 4 and len(stored(spark, tmp_path)) == 2
    assert load(spark, tmp_path, names(0, 4)).rows_loaded == 2


def test_plain_folders_are_read_but_not_loaded_onto(spark, tmp_path):
    load(spark, tmp_path, names(0, 2))
    files.read_table(spark, str(tmp_path / "out"), "sellers").write.parquet(str(tmp_path / "plain" / "sellers"))
    assert files.read_table(spark, str(tmp_path / "plain"), "sellers").count() == 2
    folder = tmp_path / "more"
    folder.mkdir()
    (folder / "a_sellers_dataset.csv").write_text(HEADER + "z,1,x,AA\n")
    with pytest.raises(ValueError, match="no versions"):
        ingest.load_table(spark, str(folder), str(tmp_path / "plain"), SELLERS)
