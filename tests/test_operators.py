"""Operators on timelines against plain Python, queries against DuckDB, streams against batches."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from busloom.operators import enrich, evaluation, ranges, rules
from busloom.operators.timeline import Timeline
from busloom.plans import catalogue
from busloom.streaming import latch

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data, ts = [], 0
    for i in range(400):
        ts += rng.randrange(1, 60)
        data.append((i, rng.choice([1, 1, 1, 2, None]), ts, rng.choice([None, rng.randrange(9)]), rng.random() < 0.4))
    return data, spark.createDataFrame(data, "ord long, id long, ts long, v long, bad boolean").repartition(5).cache()


@pytest.mark.parametrize("width", [1, 7, 100, 10**9])
def test_timeline_matches_a_plain_walk(rows, width):
    data, df = rows
    line = Timeline(("id",), ("ord",), f"floor(ts / {width})")
    want = {}
    state = {}
    for i, key, ts, v, bad in data:
        s = state.setdefault(key, {"prev": None, "sum": 0, "last": None, "max": None, "bad": False, "run": 0})
        before = s["prev"]
        s["sum"] += v or 0
        s["last"] = v if v is not None else s["last"]
        top = s["max"]
        s["max"] = v if s["max"] is None else max(s["max"], v) if v is not None else s["max"]
        s["run"] = s["run"] + 1 if bad else 0
        want[i] = (None if before is None else ts - before, s["sum"], s["last"], top, s["run"], bad and not s["bad"])
        s["prev"], s["bad"] = ts, bad
    out = enrich.intervals(df, line, "ts", "dt")
    out = line.running_sum(out, F.col("v"), "sum")
    out = line.last_known(out, F.col("v"), "last")
    out = line.running_max(out, F.col("v"), "top", inclusive=False)
    out = line.run_position(out, F.col("bad"), "run")
    onsets = {r.ord for r in line.onsets(df, F.col("bad")).collect()}
    assert {r.ord: (r.dt, r.sum, r["last"], r.top, r.run, r.ord in onsets) for r in out.collect()} == want


def test_restored_time_golden_cases(spark):
    df = spark.createDataFrame([(0x20, 0xFFFFFFF0), (999_950, 1_000_000), (2**31, 2**32), (5, None)], "ts32 long, sync long")
    loose = [r[0] for r in df.select(enrich.restore_time(F.col("ts32"), F.col("sync"))).collect()]
    strict = [r[0] for r in df.select(enrich.restore_time(F.col("ts32"), F.col("sync"), True)).collect()]
    assert loose == [0x100000020, 999_950, 2**32 - 2**31, None] and strict == [0x100000020, 999_950, None, None]


def test_gaps_and_wraps(spark):
    line = Timeline((), ("o",), "0")
    df = spark.createDataFrame([(0, 65534, 2**32 - 1), (1, 65535, 2**32 - 1), (2, 0, 0), (3, 3, 10), (4, 2, 11)], "o int, seq int, c long")
    assert [r.missing for r in enrich.sequence_gaps(df, line, "seq").orderBy("o").collect()] == [0, 0, 0, 2, 65534]
    assert [r.missing for r in enrich.sequence_gaps(df, line, "seq", 32768).orderBy("o").collect()] == [0, 0, 0, 2, 0]
    assert [(r.c_delta, r.c_wrapped) for r in enrich.counter_deltas(df, line, ["c"]).orderBy("o").collect()] == [(None, None), (0, False), (1, True), (10, False), (1, False)]


def test_outage_is_one_row_and_arms_again(spark):
    df = spark.createDataFrame([(0, 1, 0), (1, 2, 5), (2, 1, 1000), (3, 1, 1100), (4, 2, 9000)], "ord long, can_id long, ts_us long")
    clock = df.agg(F.max("ts_us").alias("last_us"))
    out = rules.outages(df, F.lit(True), F.lit(300), Timeline(("can_id",), ("ord",), "floor(ts_us / 100)"), clock)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 0, 1000), (1, 1100, None), (2, 5, 9000)], key=str)


def test_range_join_matches_pairs(spark):
    rng = random.Random(4)
    points = [(i, rng.randrange(1000)) for i in range(80)]
    spans = [(i, a, a + rng.randrange(200)) for i in range(30) for a in [rng.randrange(1000)]]
    p, s = spark.createDataFrame(points, "i int, at long"), spark.createDataFrame(spans, "s int, lo long, hi long")
    want = {(i, k) for i, at in points for k, lo, hi in spans if lo <= at <= hi}
    for bucket in (1, 50, 5000):
        got = ranges.in_ranges(p, "at", s, F.col("lo"), F.col("hi"), bucket).select("i", "s").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    free = {r.i for r in ranges.in_ranges(p, "at", s, F.col("lo"), F.col("hi"), 50, how="left_anti").collect()}
    assert free == {i for i, _ in points} - {i for i, _ in want}


def test_metrics_and_differences(spark):
    r = evaluation.scores(spark.createDataFrame([(3, 1, 2), (0, 0, 0)], "tp long, fp long, fn long")).collect()
    assert (r[0].precision, r[0].recall, round(r[0].f1, 6)) == (0.75, 0.6, round(6 / 9, 6)) and r[1].f1 == 0
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,)], "x int")
    assert {tuple(r) for r in evaluation.differences(a, b).collect()} == {(1, 1), (2, 1), (3, -1)}
    assert evaluation.differences(a, a).count() == 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    sql = duck.sql(catalogue.ORACLES[name]) if name in catalogue.ORACLES else None
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    if sql is not None:
        assert sorted(sql.columns) == cols
        assert got == sorted((tuple(dict(zip(sql.columns, r))[c] for c in cols) for r in sql.fetchall()), key=str)


def test_streamed_latch_equals_batch(spark, tmp_path):
    frames = catalogue._frames(spark, DATA)
    profile = catalogue._profile(frames).filter("period_us is not null")
    want = {(r.ord, r.can_id) for r in catalogue.period_onsets(spark, DATA).collect()}
    b = catalogue.bus(spark, DATA).select("ord", "can_id", "ts_us")
    for k in range(3):  # three micro-batches in order
        b.filter((F.col("ord") >= k * 400) & (F.col("ord") < (k + 1) * 400)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = latch.period_onsets(latch.file_stream(spark, str(tmp_path / "in"), b.schema), profile, catalogue.TOLERANCE, F.col("ts_us") >= catalogue.TEST)
    q = stream.writeStream.format("memory").queryName("latched").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.ord, r.can_id) for r in spark.sql("select * from latched").collect()}
    assert got == want and want


def test_streamed_overdue(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(1, 0), (2, 0), (1, 1), (2, 1), (2, 2), (2, 9), (2, 10), (1, 11), (2, 30)]
    df = spark.createDataFrame([(c, s * 1_000_000) for c, s in rows], "can_id long, ts_us long").withColumn("ts", F.timestamp_micros("ts_us"))
    for k in range(len(rows)):
        s = rows[k][1] * 1_000_000
        df.filter((F.col("ts_us") == s) & (F.col("can_id") == rows[k][0])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    profile = spark.createDataFrame([(1, 1e6), (2, 1e6)], "can_id long, period_us double")
    out = latch.overdue(latch.file_stream(spark, str(tmp_path / "in"), df.schema), profile, 3.0)
    q = out.writeStream.format("memory").queryName("overdue").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.can_id, r.last_us) for r in spark.sql("select * from overdue").collect()}
    assert {(1, 1_000_000), (2, 2_000_000), (1, 11_000_000)} <= got
