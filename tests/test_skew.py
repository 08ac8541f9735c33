"""One asset with nine tenths of the rows: same results as the plain form, and no task gets the asset whole."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.helpers import BASE, at, candle_rows, candles, minutes_of
from wickmill.operators import coverage as C
from wickmill.operators.dedup import absent_rows, dedup_first
from wickmill.operators.ingest import hot_keys, page_order
from wickmill.operators.ordered import CHUNK, with_bounded_chunk, with_time_chunk
from wickmill.operators.rollup import all_tiers
from wickmill.operators.series import growth_rate, sustained_alerts
from wickmill.session import INITIAL_PARTS, configure
from wickmill.sources.tables import read_candles, write_candles

ROWS = 90_000


@pytest.fixture(scope="module")
def skewed(spark):
    """Asset 1: 90,000 rows; assets 2 and 3: 5,000 each. Every 997th minute is missing."""
    base = int(BASE.timestamp())
    rows = spark.range(ROWS + 10_000).select(
        F.when(F.col("id") < ROWS, 1).otherwise(2 + F.col("id") % 2).cast("int").alias("asset_id"),
        F.timestamp_seconds(F.lit(base) + F.col("id") * 60).alias("timestamp"),
        F.col("id").alias("arrival_seq"),
    )
    return rows.where(F.col("arrival_seq") % 997 != 0)


def windows(df) -> list[tuple[str, str]]:
    """Partitioning and ordering columns of every window in the optimized plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    found = []
    for line in plan.splitlines():
        if re.search(r"\bWindow \[", line):
            parts = line.rstrip().rstrip("]").split("], [")[1:]
            # A window without an order prints none.
            order = parts.pop() if parts and re.search(r" (ASC|DESC) ", parts[-1]) else ""
            found.append((parts.pop() if parts else "", order))
    return found


def assert_no_whole_key(df) -> None:
    """Rows are windowed within slices; a window over a whole key orders slices or edge pieces only."""
    found = windows(df)
    assert found
    for partition, order in found:
        assert "_chunk" in partition or "_slot" in partition or order.startswith("_chunk")


def test_blocks_equal_the_plain_window(spark, skewed):
    window = Window.partitionBy("asset_id").orderBy("timestamp")
    step = F.unix_seconds("timestamp") - F.unix_seconds(F.lag("timestamp").over(window))
    plain = (
        skewed.withColumn("_n", F.when(step == 60, 0).otherwise(1))
        .withColumn("_b", F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("asset_id", "_b")
        .agg(F.min("timestamp"), F.max("timestamp"), F.count("*"))
        .drop("_b")
    )
    got = C.contiguous_blocks(skewed)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    assert_no_whole_key(got)
    assert with_time_chunk(skewed, "timestamp").groupBy("asset_id", CHUNK).count().agg(F.max("count")).first()[0] <= 1440


def test_no_window_orders_rows_by_asset_alone(spark, skewed):
    """Row-level windows are partitioned by a slice as well; only summaries are windowed per asset."""
    ranges = skewed.select("asset_id", F.col("timestamp").alias(C.START), F.col("timestamp").alias(C.END))
    for df in (C.contiguous_blocks(skewed), C.merge_ranges(ranges), C.with_block_id(skewed), C.inner_gaps(ranges)):
        assert_no_whole_key(df)


# -- one hot hour, one hot day ------------------------------------------------------------------------------------

HOT, PART = 30_000, 2_000


@pytest.fixture(scope="module")
def hot_hour(spark):
    """Metric a: 30,000 samples within 25 minutes of one hour and one a minute for two days around it; metric b: sparse, with a long hole."""
    base = int(BASE.timestamp())
    dense = spark.range(HOT).select(F.lit("a").alias("metric"), (F.col("id") * 50_000 + F.lit(7)).alias("_us"))
    sparse = spark.range(-1440, 1440).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("metric"), (F.col("id") * 60_000_000).alias("_us"))
    hole = (F.col("metric") == "b") & F.col("_us").between(100 * 60_000_000, 700 * 60_000_000)
    rows = dense.unionByName(sparse.where(~hole))
    value = F.pmod(F.hash("metric", F.floor(F.col("_us") / 400_000_000)), F.lit(50)).cast("double")
    return rows.select("metric", F.timestamp_micros(F.lit(base * 1_000_000) + F.col("_us")).alias("ts"), value.alias("value"))


def largest_part(df, keys, time, seconds, rows) -> int:
    return with_bounded_chunk(df, keys, time, seconds, rows).groupBy(*keys, CHUNK).count().agg(F.max("count")).first()[0]


def test_a_hot_hour_is_cut_by_its_rows(hot_hour):
    # 20 samples a second.
    assert largest_part(hot_hour, ["metric"], "ts", 3600, PART) <= PART + 21
    assert largest_part(hot_hour, ["metric"], "ts", 3600, 10**9) >= 24_000
    # Chunks ascend with time and equal times share one.
    chunked = with_bounded_chunk(hot_hour, ["metric"], "ts", 3600, PART)
    spans = chunked.groupBy("metric", CHUNK).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    behind = F.lag("hi").over(Window.partitionBy("metric").orderBy(CHUNK))
    assert spans.withColumn("_behind", behind).where(F.col("_behind") >= F.col("lo")).isEmpty()
    assert chunked.count() == hot_hour.count()


def test_growth_over_a_hot_hour_equals_the_plain_window(hot_hour):
    got = growth_rate(hot_hour, rows=PART)
    assert_no_whole_key(got)
    trailing = Window.partitionBy("metric").orderBy(F.unix_micros("ts")).rangeBetween(-300_000_000, Window.currentRow)
    oldest = F.first(F.struct("ts", "value")).over(trailing)
    minutes = (F.unix_micros("ts") - F.unix_micros("_o.ts")) / F.lit(60_000_000.0)
    plain = hot_hour.withColumn("_o", oldest).select(
        "metric", "ts", "value", F.when(F.col("_o.ts") < F.col("ts"), (F.col("value") - F.col("_o.value")) / minutes).alias("growth_per_minute")
    )
    key = lambda r: (r[0], r[1], r[2], None if r[3] is None else round(r[3], 9))
    assert sorted(map(key, got.collect()), key=str) == sorted(map(key, plain.collect()), key=str)


def test_growth_skips_null_times_and_keeps_null_metrics(spark):
    rows = [(None, at(0), 1.0), (None, at(4), 9.0), ("a", None, 5.0), ("a", at(0), None), ("a", at(70), 3.0)]
    df = spark.createDataFrame(rows, "metric string, ts timestamp, value double")
    got = sorted((r.metric or "", r.value is None, r.growth_per_minute) for r in growth_rate(df, rows=1).orderBy("ts").collect() if r.growth_per_minute is not None)
    assert got == [("", False, 2.0)]
    assert growth_rate(df).count() == 4
    assert growth_rate(df.limit(0)).count() == 0


def test_alerts_over_a_hot_hour_equal_the_plain_window(hot_hour):
    rules = (("Low", "a", 10.0, 5), ("High", "a", 30.0, 5), ("Other", "b", 0.0, 15))
    got = sustained_alerts(hot_hour, rules, rows=PART)
    assert_no_whole_key(got)
    limits = {name: (metric, limit, minutes) for name, metric, limit, minutes in rules}
    samples = sorted((r.metric, r.ts, r.value) for r in hot_hour.collect())
    want = []
    for name, (metric, limit, minutes) in limits.items():
        run = []
        for _, ts, value in [s for s in samples if s[0] == metric] + [(metric, None, -1.0)]:
            if value > limit:
                run.append(ts)
                continue
            if run and (run[-1] - run[0]).total_seconds() >= minutes * 60:
                want.append((name, run[0], run[-1], len(run)))
            run = []
    assert want
    assert sorted((r.alert, r.started_at, r.ended_at, r.samples) for r in got.collect()) == sorted(want)


def test_a_hot_day_of_ranges_equals_the_plain_window(spark):
    """20,000 raw ranges of one asset within a day, and a few long ones across days."""
    base = int(BASE.timestamp())
    dense = spark.range(20_000).select((F.col("id") * 2 + F.lit(base)).alias("s"), (F.col("id") % 97 * 3).alias("n"))
    long = spark.range(-3, 3).select((F.col("id") * 86_400 + F.lit(base)).alias("s"), F.lit(90_000).alias("n"))
    raw = dense.unionByName(long).select(
        F.lit(1).alias("asset_id"), F.timestamp_seconds("s").alias(C.START), F.timestamp_seconds(F.col("s") + F.col("n")).alias(C.END)
    )
    raw = raw.unionByName(raw.where(F.col("asset_id") == 1).limit(50))
    assert largest_part(raw, ["asset_id"], C.START, 86_400, PART) <= PART + 60
    plain = Window.partitionBy("asset_id").orderBy(C.START, C.END)
    ahead = F.max(C.END).over(plain.rowsBetween(Window.unboundedPreceding, -1))
    audit = C.overlap_audit(raw, rows=PART)
    assert_no_whole_key(audit)
    folded = raw.groupBy("asset_id", C.START, C.END).agg(F.count("*").alias("copies")).withColumn("previous_end", ahead)
    wanted = folded.where(F.coalesce(F.col(C.START) <= F.col("previous_end"), F.lit(False)) | (F.col("copies") > 1))
    assert sorted(map(tuple, audit.select(*wanted.columns).collect()), key=str) == sorted(map(tuple, wanted.collect()), key=str)
    islands = C.with_island_id(raw, rows=PART)
    assert_no_whole_key(islands)
    whole = C.with_island_id(raw, rows=10**9)
    assert sorted(map(tuple, islands.collect())) == sorted(map(tuple, whole.select(*islands.columns).collect()))


def test_running_maxima_scan_their_input_once(spark, skewed, tmp_path):
    skewed.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    for df in (C.with_step(rows), C.with_block_id(rows)):
        assert len(df.collect()) == rows.count()
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert final.count("FileScan") == 1
        assert "ReusedExchange" in final


def test_copies_of_one_key(spark):
    """A key with 50,000 copies is one partial row per task after the map side."""
    rows = spark.range(50_000).select(
        F.lit(1).alias("asset_id"), F.lit(BASE).alias("timestamp"), F.col("id").alias("arrival_seq"), (F.col("id") * 1.5).alias("open")
    )
    one = dedup_first(rows)
    assert [(r.open, r.arrival_seq) for r in one.collect()] == [(0.0, 0)]
    assert "partial_min_by" in one._jdf.queryExecution().executedPlan().toString()


def test_small_assets_keep_every_row(spark, skewed):
    counts = {r.asset_id: r["sum(candles)"] for r in C.contiguous_blocks(skewed).groupBy("asset_id").agg(F.sum("candles")).collect()}
    expected = {r.asset_id: r["count"] for r in skewed.groupBy("asset_id").count().collect()}
    assert counts == expected
    symbols = skewed.select(F.col("asset_id").cast("string").alias("symbol"))
    assert {r.symbol for r in hot_keys(symbols, cap=5000).collect()} == {"1"}


def test_order_check_over_a_huge_page(spark, skewed):
    page = skewed.withColumn("batch_id", F.lit("p"))
    assert [r.disordered for r in page_order(page).collect()] == [False]
    late = page.withColumn("timestamp", F.when(F.col("arrival_seq") == 80_001, F.lit(BASE)).otherwise(F.col("timestamp")))
    assert [r.disordered for r in page_order(late).collect()] == [True]


def test_tiers_are_cut_finely_whatever_the_session_says(spark):
    """Each tier is folded in a table of its own in the same task, so few shuffle partitions would make a task's memory grow with the input."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        plan = all_tiers(candles(spark, candle_rows(range(3))))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    exchanges = re.findall(r"hashpartitioning\(.*, (\d+)\)", plan)
    assert exchanges and set(exchanges) == {"240"}


def test_a_session_with_more_parts_keeps_them(spark):
    """Beyond 240 x 8 MB of shuffle a part grows with the input unless the session may ask for more parts."""
    before = {key: spark.conf.get(key) for key in ("spark.sql.shuffle.partitions", INITIAL_PARTS)}
    found = []
    try:
        for parts, initial in (("500", "240"), ("8", "700"), ("8", "240")):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set(INITIAL_PARTS, initial)
            plan = all_tiers(candles(configure(spark), candle_rows(range(3))))._jdf.queryExecution().executedPlan().toString()
            found.append(set(re.findall(r"hashpartitioning\(.*, (\d+)\)", plan)))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert found == [{"500"}, {"700"}, {"240"}]


def test_a_task_reads_sixteen_megabytes(spark, folder):
    """What a task reads is folded ahead of the first exchange, in a table that grows with the rows of the split."""
    spark.range(0, 3_000_000, 1, 1).write.option("compression", "none").parquet(f"{folder}/t")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        parts = configure(spark).read.parquet(f"{folder}/t").rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert parts == 2


def test_an_insert_broadcasts_no_stored_keys(spark, folder):
    """The planner judges stored keys by their compressed files; a broadcast of them is whole in every task."""
    write_candles(candles(spark, candle_rows(range(5))), folder)
    absent = absent_rows(candles(spark, candle_rows(range(3, 8))), read_candles(spark, folder))
    plan = absent._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert minutes_of(absent, "timestamp") == [(5,), (6,), (7,)]
