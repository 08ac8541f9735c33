"""Deleting an asset takes its rows out of four stored tables, file by file."""

from __future__ import annotations

import glob
import os

import pytest

from tests.helpers import assets, at, candle_rows, candles
from wickmill.plans import purge
from wickmill.plans.refresh import base_path, refresh_coverage, staging_path
from wickmill.plans.repair import repair_ledger
from wickmill.schemas import REPAIR_JOB
from wickmill.sources.ledgers import append_states, read_ledger
from wickmill.sources.tables import read_candles, stored_days, write_candles

DAY = 24 * 60


def files_of(folder):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


@pytest.fixture()
def store(spark, folder):
    spark.conf.set("wickmill.asset.slots", "4")
    rows = [r for a in (1, 2, 3, 99) for r in candle_rows(range(0, 2 * DAY, 60), asset_id=a)]
    write_candles(candles(spark, rows), base_path(folder))
    write_candles(candles(spark, candle_rows([-9 * DAY], asset_id=99) + candle_rows([-9 * DAY], asset_id=1)), staging_path(folder))
    refresh_coverage(spark, folder, [*stored_days(spark, base_path(folder)), *stored_days(spark, staging_path(folder))])
    jobs = [(k, a, "X", at(0), at(5), "pending", 0, 5, None, None, None, at(0)) for k, a in ((1, 1), (2, 99))]
    append_states(spark.createDataFrame(jobs, REPAIR_JOB), REPAIR_JOB, repair_ledger(folder), "r", at(0))
    yield folder
    spark.conf.unset("wickmill.asset.slots")


def held(spark, root):
    return {n: sorted({r.asset_id for r in purge.read_table(spark, p, s).collect()}) for n, (p, s, _) in purge.stored_tables(root).items()}


def test_only_files_with_orphans_are_replaced(spark, store):
    before, count = files_of(store), read_candles(spark, base_path(store)).where("asset_id <> 99").count()
    replaced = purge.purge_assets(spark, store, assets(spark))
    assert all(replaced.values())
    after = files_of(store)
    gone = {p for p in before if p not in after}
    assert gone == {n.split("file:", 1)[-1].replace("///", "/") for names in replaced.values() for n in names}
    assert all(after[p] == before[p] for p in before if p not in gone)
    # Asset 99 shares its slot with asset 3 alone: the files of the other slots stay.
    assert not any("slot=1" in p or "slot=2" in p for p in gone if "tier=1m" in p)
    assert held(spark, store) == {"candles": [1, 2, 3], "staging": [1], "coverage": [1, 2, 3], "repair_jobs": [1]}
    assert read_candles(spark, base_path(store)).count() == count
    assert [r.asset_id for r in read_ledger(spark, repair_ledger(store), REPAIR_JOB).collect()] == [1]
    assert not any(purge.purge_assets(spark, store, assets(spark)).values())


def test_a_purge_that_died_is_finished_or_dropped(spark, store):
    path, schema, folders = purge.stored_tables(store)["candles"]
    whole = sorted(map(tuple, read_candles(spark, path).where("asset_id <> 99").collect()))
    # Died before the list was written: the change was not decided.
    os.makedirs(f"{path}/{purge.ASIDE}/day=2026-01-01/slot=3")
    open(f"{path}/{purge.ASIDE}/day=2026-01-01/slot=3/half.parquet", "w").close()
    # Died after it: files are moved and removed by the next run.
    finish, purge.finish_purge = purge.finish_purge, lambda *_: None
    try:
        purge.purge_table(spark, path, schema, folders, assets(spark))
    finally:
        purge.finish_purge = finish
    assert 99 in held(spark, store)["candles"]
    assert purge.purge_table(spark, path, schema, folders, assets(spark)) == []
    assert sorted(map(tuple, read_candles(spark, path).collect())) == whole
    assert not os.path.exists(f"{path}/{purge.ASIDE}")
