"""Random cases against plain Python. Each case is one asset, so a run checks many at once."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest

from tests.helpers import BASE, at, candle_rows, candles, minutes_of, ranges, requests
from wickmill.operators import coverage as C
from wickmill.operators.intervals import overlapping_pairs, points_in_windows
from wickmill.operators.series import growth_rate

CASES = 150


def random_ranges(seed: int, long_ranges: bool):
    rng = random.Random(seed)
    out = []
    for asset in range(CASES):
        horizon = rng.choice([60, 3000, 20000])
        for _ in range(rng.randint(1, 25)):
            start = rng.randint(-horizon, horizon)
            length = rng.choice([0, 1, 5, 200, 6000]) if long_ranges else rng.choice([0, 1, 5, 30])
            out.append((asset, start, start + length))
    return out


def merged(rows):
    out = {}
    for asset, start, end in sorted(rows):
        runs = out.setdefault(asset, [])
        if runs and start <= runs[-1][1] + 1:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    return sorted((a, s, e) for a, runs in out.items() for s, e in runs)


@pytest.mark.parametrize("seed, long_ranges", [(1, True), (2, False), (3, True)])
def test_merge_and_islands(spark, seed, long_ranges):
    rows = random_ranges(seed, long_ranges)
    given = ranges(spark, rows)
    expected = merged(rows)
    assert minutes_of(C.merge_ranges(given), "asset_id", "start_timestamp", "end_timestamp") == expected
    islands = C.with_island_id(given).groupBy("asset_id", "island_start").agg({"end_timestamp": "max"})
    assert minutes_of(islands, "asset_id", "island_start", "max(end_timestamp)") == expected


@pytest.mark.parametrize("seed", [4, 5])
def test_gaps_and_coverage_tile_the_request(spark, seed):
    rows = random_ranges(seed, True)
    rng = random.Random(seed)
    asked = [(a, s, s + rng.choice([0, 1, 500, 9000])) for a in range(CASES + 5) for s in [rng.randint(-9000, 9000)]]
    expected = []
    for asset, qs, qe in asked:
        pointer = qs
        for _, s, e in (r for r in merged(rows) if r[0] == asset):
            if e >= qs and s <= qe:
                if pointer < s:
                    expected.append((asset, pointer, s))
                pointer = max(pointer, e)
        if pointer < qe:
            expected.append((asset, pointer, qe))
    given, wanted = ranges(spark, rows), requests(spark, asked)
    got = minutes_of(C.coverage_gaps(given, wanted), "asset_id", "gap_start", "gap_end")
    assert got == sorted(expected)
    again = C.coverage_gaps(C.merge_ranges(given), wanted, distinct_starts=True)
    assert minutes_of(again, "asset_id", "gap_start", "gap_end") == got


@pytest.mark.parametrize("seed", [6, 7])
def test_blocks_are_disjoint_and_cover_every_row(spark, seed):
    rng = random.Random(seed)
    times = {(a, m) for a in range(CASES) for m in (rng.choice([rng.randint(0, 40), rng.randint(800, 900), rng.randint(0, 9000)]) for _ in range(60))}
    df = spark.createDataFrame([(a, at(m)) for a, m in times], "asset_id int, timestamp timestamp")
    expected = []
    for asset in range(CASES):
        for m in sorted(m for a, m in times if a == asset):
            if expected and expected[-1][0] == asset and expected[-1][2] == m - 1:
                expected[-1][2:] = [m, expected[-1][3] + 1]
            else:
                expected.append([asset, m, m, 1])
    got = minutes_of(C.contiguous_blocks(df), "asset_id", "start_timestamp", "end_timestamp", "candles")
    assert got == [tuple(x) for x in expected]
    blocks = C.with_block_id(df).groupBy("asset_id", "block_start").count()
    assert minutes_of(blocks, "asset_id", "block_start", "count") == [(a, s, n) for a, s, _, n in expected]
    steps = minutes_of(C.with_step(df), "asset_id", "timestamp", "step_seconds")
    for (a, m, step), previous in zip(steps, [None, *steps]):
        same = previous is not None and previous[0] == a
        assert step == ((m - previous[1]) * 60 if same else None)


def test_interval_joins(spark):
    rows = random_ranges(8, True)
    given = ranges(spark, rows)
    asked = [(a, s, s + 700) for a in range(CASES) for s in (-3000, 0, 100, 2500)]
    wanted = requests(spark, asked)
    pairs = overlapping_pairs(wanted, given, ["asset_id"], ("request_start", "request_end"), ("start_timestamp", "end_timestamp"))
    expected = sorted((a, s, e, qs, qe) for a, qs, qe in asked for b, s, e in rows if a == b and e >= qs and s <= qe)
    assert minutes_of(pairs, "asset_id", "start_timestamp", "end_timestamp", "request_start", "request_end") == expected
    points = given.select("asset_id", given.start_timestamp.alias("timestamp"))
    inside = points_in_windows(points, wanted, ["asset_id"], "timestamp", "request_start", "request_end")
    expected = sorted((a, s, qs) for a, qs, qe in asked for b, s, _ in rows if a == b and qs <= s < qe)
    assert minutes_of(inside, "asset_id", "timestamp", "request_start") == expected


def test_overlap_audit(spark):
    rows = [(1, 0, 10), (1, 5, 7), (1, 11, 12), (1, 12, 13), (2, 0, 4000), (2, 3000, 3001), (3, 0, 1), (3, 0, 1)]
    got = C.overlap_audit(ranges(spark, rows))
    assert minutes_of(got, "asset_id", "start_timestamp", "copies") == [(1, 5, 1), (1, 12, 1), (2, 3000, 1), (3, 0, 2)]


def test_growth_across_hours(spark):
    rng = random.Random(9)
    seconds = sorted(rng.sample(range(0, 4 * 3600), 900))
    data = [(BASE + timedelta(seconds=s), float(rng.randint(0, 100))) for s in seconds]
    df = spark.createDataFrame([("m", t, v) for t, v in data], "metric string, ts timestamp, value double")
    got = [r.growth_per_minute for r in growth_rate(df).orderBy("ts").collect()]
    for i, (t, v) in enumerate(data):
        t0, v0 = next((a, b) for a, b in data if t - timedelta(seconds=300) <= a)
        want = None if t0 == t else (v - v0) / ((t - t0).total_seconds() / 60)
        assert got[i] == pytest.approx(want) if want is not None else got[i] is None


def test_coverage_report_counts_whole_days_and_ragged_ends(spark):
    rng = random.Random(10)
    midnight = 840
    # Midnights, a minute around them, and any other minute of six days.
    marks = [midnight + 1440 * d + k for d in range(-1, 5) for k in (-1, 0, 1)]
    held = sorted({rng.randrange(-700, 7200) for _ in range(900)} | {m for m in marks if rng.random() < 0.7})
    edges = marks + [rng.randrange(-700, 7200) for _ in range(12)]
    windows = sorted({(1, a, b) for a, b in (rng.sample(edges, 2) for _ in range(150))} | {(1, 0, 0), (2, 0, 5000)})
    rows = candle_rows(held)
    wanted = sorted((a, s, e, sum(s <= m < e for m in held) if a == 1 else 0, e - s) for a, s, e in windows)
    for unique in (True, False):
        got = C.coverage_report(candles(spark, rows if unique else rows * 2), requests(spark, windows), unique=unique)
        assert minutes_of(got, "asset_id", "request_start", "request_end", "candles", "expected") == wanted
