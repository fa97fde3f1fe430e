"""Ranges, matches and rates where many rows fall together, against plain loops."""

import random
import time

from pyspark.sql import functions as F

from busloom.operators import audit, campaign, evaluation, ranges
from busloom.plans import campaign as plans
from busloom.plans import catalogue


def test_islands_of_equal_intervals(spark):
    """Two windows may sort equal intervals differently; none may fall to the island before."""
    rows = [(k * 100, k * 100 + 40 + (n % 2) * 30) for k in range(60) for n in range(80)] + [(250, 330)] * 50
    random.Random(3).shuffle(rows)
    spans = spark.createDataFrame(rows, "a long, b long").repartition(7)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a join that deals and sorts the rows anew, as on larger tables
    try:
        got = {tuple(r) for r in ranges.islands(spans, (), "a", "b", ("a", "b"), "floor(a / 1000)").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(k * 100, k * 100 + 70, 80) for k in range(60) if k not in (2, 3)} | {(200, 370, 210)}


def test_rate_where_more_is_masked_than_there_is_time(spark):
    matched = spark.createDataFrame([("a", None), ("a", None), ("a", 1), ("b", 2)], "type string, episode long")
    rates = lambda us: {tuple(r) for r in campaign.background_rates(matched, spark.createDataFrame([(us,)], "clean_us long")).collect()}
    assert rates(-60_000_000) == {("a", 2, -1.0, -2.0), ("b", 0, -1.0, 0.0)}
    assert rates(0) == {("a", 2, 0.0, None), ("b", 0, 0.0, None)}


def nearest_pairs(tx, rx, residual):
    """Brute force: pairs of frames that are each other's nearest; ties: smaller id."""
    def best(a, others):
        near = [(abs(t - a[2]), i) for i, s, t in others if s == a[1] and t is not None and abs(t - a[2]) <= residual] if a[2] is not None else []
        return min(near)[1] if near else None

    to_rx, to_tx = {a[0]: best(a, rx) for a in tx}, {b[0]: best(b, tx) for b in rx}
    at, got = {a[0]: a[2] for a in tx}, {b[0]: b[2] for b in rx}
    return {(i, j, got[j] - at[i]) for i, j in to_rx.items() if j is not None and to_tx[j] == i}


def test_match_by_time_is_each_others_nearest(spark):
    rng = random.Random(5)
    side = lambda n: [(i, rng.choice([1, 2, None]), rng.choice([None, *range(-400, 400)])) for i in range(n)]
    table = lambda rows, n: spark.createDataFrame(rows, f"{n}_id long, sig int, {n}_us long").repartition(5)
    for residual in (0, 3, 50):
        tx, rx = side(250), side(250)
        got = [tuple(r) for r in audit.match_by_time(table(tx, "tx"), table(rx, "rx"), ["sig"], residual).collect()]
        assert len(got) == len(set(got)) and set(got) == nearest_pairs(tx, rx, residual)


def test_match_by_time_without_all_pairs(spark):
    """1.6 billion pairs lie within the residual."""
    n, start = 40_000, time.monotonic()
    tx, rx = spark.range(n).selectExpr("id AS tx_id", "1 AS sig", "10 * id AS tx_us"), spark.range(n).selectExpr("id AS rx_id", "1 AS sig", "10 * id + 3 AS rx_us")
    assert audit.match_by_time(tx, rx, ["sig"], 10 * n).filter("tx_id = rx_id and residual_us = 3").count() == n and time.monotonic() - start < 30


def test_counts_in_ranges(spark):
    rng = random.Random(8)
    points = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-60, 60)])) for _ in range(300)]
    spans = [(i, rng.choice(["a", "b", "c", None]), low, low + rng.randrange(-2, 40)) for i, low in enumerate(rng.choices(range(-70, 70), k=120))]
    p, s = spark.createDataFrame(points, "k string, t long"), spark.createDataFrame(spans, "id long, k string, a long, b long")
    for width in (1, 16, 1000):
        got = {r.id: r.n for r in ranges.count_in_ranges(p, "t", s, F.col("a"), F.col("b"), ["k"], ["id"], width).collect()}
        assert all(got.get(i, 0) == sum(x == k and t is not None and a <= t <= b for x, t in points) for i, k, a, b in spans)


def crowd(spark, path, n, k=6):
    """A folder whose events all fall into one hour after the learning time; every one is an event and an episode, of any identifier if 3 divides ``k``."""
    ts = "timestamp_ntz'2024-01-20 00:00:00' + make_dt_interval(0, 0, 0, id * 3600.0 / {n})".format(n=n)
    rows = spark.range(n).selectExpr("id AS event_id", f"{ts} AS ts", "id % 7 AS user_id", "'purchase' AS event_type", "400.0D AS value", f"'{{\"k\": {k}}}' AS props")
    rows.write.parquet(f"{path}/events.parquet")
    return str(path)


def test_achieved_intensity_without_all_pairs(spark, tmp_path):
    """Each of 200,000 episodes lasts until the end of the hour: 20 billion pairs."""
    n, start = 200_000, time.monotonic()
    got = catalogue.QUERIES["achieved_intensity"](spark, crowd(spark, tmp_path, n))
    assert got.filter(F.col("n") == n - F.col("episode")).count() == n and time.monotonic() - start < 30


def test_match_episodes_is_the_nearest_start(spark):
    """Episodes of all lengths, so that the newest may have ended while an earlier one lasts; also some that end before they start."""
    rng = random.Random(13)
    events = [(f"e{i}", rng.choice([1, 2, 3, None]), rng.choice([None, *range(-30, 130)])) for i in range(400)]
    episodes = [(i, a, a + rng.choice([-4, 0, 3, 9, 60]), rng.choice([1, 2, None])) for i, a in enumerate(rng.choices(range(-20, 120), k=60))]
    e = spark.createDataFrame(events, "event_id string, can_id long, ts_us long")
    p = spark.createDataFrame(episodes, "episode long, start_us long, end_us long, episode_can_id long")
    for tolerance, bucket in ((0, 7), (3, 30), (-2, 11)):
        got = {r.event_id: r.episode for r in evaluation.match_episodes(e, p, tolerance, bucket).collect()}
        for i, c, t in events:
            held = [(abs(t - a), n) for n, a, b, k in episodes if t is not None and (k is None or k == c) and a - tolerance <= t <= b + tolerance]
            assert got[i] == (min(held)[1] if held else None), (i, tolerance)


def test_match_episodes_without_all_pairs(spark, tmp_path):
    """Every one of 200,000 events lies in or near every one of 200,000 episodes; the nearest is its own."""
    n, start = 200_000, time.monotonic()
    got = catalogue.QUERIES["match_episodes"](spark, crowd(spark, tmp_path, n))
    assert got.filter("event_id = episode").count() == n and time.monotonic() - start < 40


def test_latency_stats_without_all_pairs(spark, tmp_path):
    n, start = 200_000, time.monotonic()
    got = catalogue.QUERIES["latency_stats"](spark, crowd(spark, tmp_path, n)).collect()
    assert [tuple(r) for r in got] == [("signal_out_of_range", n, 0, 0.0, 0)] and time.monotonic() - start < 40


def test_medians_by_running_sums(spark):
    """Odd and even numbers of values, below zero, repeated, null keys and values, as percentile gives them."""
    rng = random.Random(17)
    rows = [(k, rng.choice([None, *range(-40, 60)])) for k in ("a", "b", None) for _ in range({"a": 31, "b": 80, None: 9}[k])] + [("one", 7), ("two", -3), ("two", 4), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(5)
    want = {r.k: r.m for r in df.filter("v is not null").groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("m")).collect()}
    for width in (1, 16, 1000):
        assert {r.k: r.m for r in evaluation.medians(df, ["k"], "v", "m", width).collect()} == want


def test_validation_checks_without_all_pairs(spark, tmp_path):
    """Silence of 200,000 episodes of seven identifiers, each broken by the frame that begins it."""
    n, start = 200_000, time.monotonic()
    got = plans.QUERIES["validation_checks"](spark, crowd(spark, tmp_path, n, 7)).groupBy("check", "passed").count().collect()
    assert {tuple(r) for r in got} == {("silence", False, n), ("detected", True, n), ("ordered_times", True, 7)} and time.monotonic() - start < 50
