"""Queries over the tables of a folder, and the same in DuckDB SQL.

The events table stands in for bus records: user_id is the identifier, event_id the record
order, value a signal, event_type a state, and the numbers in props counters and masks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busloom.operators import audit, enrich, evaluation, features, profiles, ranges, rules
from busloom.operators.timeline import Timeline
from busloom.sources.streams import stored

DAY = 86_400_000_000
START = 1_704_067_200_000_000  # 2024-01-01
TEST = START + 10 * DAY
END = START + 30 * DAY
MIN_INTERVALS, TOLERANCE, SIGMAS, BURST, BURST_FRAMES, MISSING = 5, 0.3, 1.5, 0.5, 3, 3.0
LOW, HIGH = 20.0, 300.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers the decorated (spark, sf_dir) function and its DuckDB counterpart."""

    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = COMMON + sql
        return f

    return register


def bus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as bus records; only the columns that a query uses are read."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").alias("ord"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("ts_us"), F.col("user_id").alias("can_id"),
        F.col("event_type").alias("kind"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"), (1 + F.pmod("event_id", F.lit(2))).cast("int").alias("channel"),
        F.length("props").alias("len"),
    )


COMMON = f"""
WITH RECURSIVE bus AS (SELECT event_id AS ord, epoch_us(ts) AS ts_us, user_id AS can_id, event_type AS kind, value,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(1 + event_id % 2 AS INTEGER) AS channel, length(props) AS len FROM events),
frames AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY can_id ORDER BY ord) AS dt_us FROM bus),
prof AS (SELECT can_id, count(*) AS frame_count, count(CASE WHEN dt_us > 0 THEN 1 END) AS interval_count,
  CASE WHEN count(CASE WHEN dt_us > 0 THEN 1 END) >= {MIN_INTERVALS} THEN avg(CASE WHEN dt_us > 0 THEN dt_us END) END AS period_us,
  coalesce(stddev_pop(CASE WHEN dt_us > 0 THEN dt_us END), 0) AS std_us FROM frames WHERE ts_us < {TEST} GROUP BY can_id),
tested AS (SELECT f.*, p.period_us, p.std_us FROM frames f JOIN prof p USING (can_id) WHERE f.ts_us >= {TEST} AND p.period_us IS NOT NULL AND f.dt_us IS NOT NULL)
"""

DAYS = f"floor(ts_us / {DAY})"
BY_ID = Timeline(("can_id",), ("ord",), DAYS)
BY_CHANNEL = Timeline(("channel",), ("ord",), DAYS)
ALL = Timeline((), ("ord",), DAYS)


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.intervals(bus(spark, sf_dir), BY_ID)


def _profile(frames: DataFrame) -> DataFrame:
    return profiles.latched_profile(frames.filter(F.col("ts_us") < TEST), MIN_INTERVALS)


def _tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir)
    known = _profile(frames).filter("period_us is not null").select("can_id", "period_us", "std_us")
    return frames.filter((F.col("ts_us") >= TEST) & F.col("dt_us").isNotNull()).join(known, "can_id")


@query(f"""SELECT ord, can_id, ts_us, dt_us, round(period_us, 3) AS period_us FROM (SELECT *, lag(bad) OVER (PARTITION BY can_id ORDER BY ord) AS was FROM
  (SELECT *, abs(dt_us - period_us) > period_us * {TOLERANCE} AS bad FROM tested)) WHERE bad AND NOT coalesce(was, false)""")
def period_onsets(spark, sf_dir):
    rows = BY_ID.onsets(_tested(spark, sf_dir), rules.period_bad(F.col("dt_us"), F.col("period_us"), TOLERANCE))
    return rows.select("ord", "can_id", "ts_us", "dt_us", F.round("period_us", 3).alias("period_us"))


@query("SELECT ord, can_id, dt_us FROM frames")
def frame_intervals(spark, sf_dir):
    return _frames(spark, sf_dir).select("ord", "can_id", "dt_us")


@query("SELECT can_id, frame_count, interval_count, round(period_us, 3) AS period_us, round(std_us / 1e6, 3) AS std_s FROM prof")
def profile_latched(spark, sf_dir):
    return _profile(_frames(spark, sf_dir)).select("can_id", "frame_count", "interval_count", F.round("period_us", 3).alias("period_us"), F.round(F.col("std_us") / 1e6, 3).alias("std_s"))


@query(f""", a AS (SELECT can_id, min(ts_us) AS f, max(ts_us) AS l FROM bus GROUP BY can_id),
g AS (SELECT can_id, unnest(generate_series(0, CAST(floor((l - f) / {DAY}) AS BIGINT))) AS w FROM a),
c AS (SELECT can_id, CAST(floor((ts_us - f) / {DAY}) AS BIGINT) AS w, count(*) AS n FROM bus JOIN a USING (can_id) GROUP BY 1, 2),
s AS (SELECT can_id, count(*) AS windows, avg(coalesce(n, 0)) AS mean_count, stddev_pop(coalesce(n, 0)) AS std_count, min(coalesce(n, 0)) AS min_count, max(coalesce(n, 0)) AS max_count FROM g LEFT JOIN c USING (can_id, w) GROUP BY can_id),
i AS (SELECT can_id, count(*) AS frame_count, count(dt_us) AS interval_count, avg(dt_us) AS mean_us, stddev_pop(dt_us) AS std_us, min(dt_us) AS min_us, max(dt_us) AS max_us FROM frames GROUP BY can_id)
SELECT can_id, frame_count, interval_count, round(mean_us, 3) AS mean_us, round(std_us / 1e6, 3) AS std_s, min_us, max_us, windows, round(mean_count, 6) AS mean_count, round(std_count, 6) AS std_count, min_count, max_count FROM i JOIN s USING (can_id)""")
def profile_full(spark, sf_dir):
    out = profiles.full_profile(_frames(spark, sf_dir), DAY)
    digits = {"mean_us": 3, "mean_count": 6, "std_count": 6}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()}).withColumn("std_s", F.round(F.col("std_us") / 1e6, 3)).drop("std_us")


@query(f"""SELECT ord, can_id, dt_us FROM (SELECT *, lag(bad) OVER (PARTITION BY can_id ORDER BY ord) AS was FROM
  (SELECT *, std_us > 0 AND abs(dt_us - period_us) > std_us * {SIGMAS} AS bad FROM tested)) WHERE bad AND NOT coalesce(was, false)""")
def sigma_onsets(spark, sf_dir):
    return BY_ID.onsets(_tested(spark, sf_dir), rules.sigma_bad(F.col("dt_us"), F.col("period_us"), F.col("std_us"), SIGMAS)).select("ord", "can_id", "dt_us")


@query(f"""SELECT ord, can_id FROM (SELECT *, row_number() OVER (PARTITION BY can_id, grp, short ORDER BY ord) AS n FROM
  (SELECT *, sum(CASE WHEN short THEN 0 ELSE 1 END) OVER (PARTITION BY can_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS grp FROM
  (SELECT *, dt_us < period_us * {BURST} AS short FROM tested))) WHERE short AND n = {BURST_FRAMES - 1}""")
def burst_onsets(spark, sf_dir):
    return rules.bursts(_tested(spark, sf_dir), BY_ID, F.col("dt_us") < F.col("period_us") * BURST, BURST_FRAMES).select("ord", "can_id")


@query(f""", w AS (SELECT can_id, w.w AS win, period_us FROM prof, (SELECT unnest(generate_series(0, {(END - TEST) // DAY - 1})) AS w) w WHERE period_us IS NOT NULL),
c AS (SELECT can_id, (ts_us - {TEST}) // {DAY} AS win, count(*) AS n FROM bus WHERE ts_us >= {TEST} AND ts_us < {END} GROUP BY 1, 2),
j AS (SELECT can_id, win, coalesce(n, 0) AS n, {DAY} / period_us AS expected FROM w LEFT JOIN c USING (can_id, win)),
k AS (SELECT *, n > expected + greatest(1.0, 0.5 * expected) AS up, n < expected - greatest(1.0, 0.5 * expected) AS down FROM j),
l AS (SELECT *, lag(up) OVER o AS was_up, lag(down) OVER o AS was_down FROM k WINDOW o AS (PARTITION BY can_id ORDER BY win))
SELECT can_id, win AS "window", n, CASE WHEN up THEN 'frequency_increase' ELSE 'frequency_decrease' END AS type FROM l
WHERE (up AND NOT coalesce(was_up, false)) OR (down AND NOT coalesce(was_down, false))""")
def frequency_onsets(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    ids = _profile(frames).filter("period_us is not null").select("can_id", "period_us")
    grid = rules.window_grid(bus(spark, sf_dir), ids, TEST, END, DAY).withColumn("expected", DAY / F.col("period_us"))
    margin = F.greatest(F.lit(1.0), 0.5 * F.col("expected"))
    line = Timeline(("can_id",), ("window",), "floor(window / 100)")
    up = line.onsets(grid, F.col("n") > F.col("expected") + margin).withColumn("type", F.lit("frequency_increase"))
    down = line.onsets(grid, F.col("n") < F.col("expected") - margin).withColumn("type", F.lit("frequency_decrease"))
    return up.unionByName(down).select("can_id", "window", "n", "type")


@query(f""", nxt AS (SELECT f.can_id, f.ts_us AS last_us, lead(f.ts_us) OVER (PARTITION BY f.can_id ORDER BY f.ord) AS next_us, p.period_us * {MISSING} AS lim FROM bus f JOIN prof p USING (can_id) WHERE p.period_us IS NOT NULL)
SELECT can_id, last_us, next_us FROM nxt WHERE coalesce(next_us, (SELECT max(ts_us) FROM bus)) - last_us > lim""")
def missing_outages(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    known = _profile(frames).filter("period_us is not null").select("can_id", "period_us")
    rows = bus(spark, sf_dir).join(known, "can_id")
    clock = bus(spark, sf_dir).agg(F.max("ts_us").alias("last_us"))
    return rules.outages(rows, F.lit(True), F.col("period_us") * MISSING, BY_ID, clock)


@query(f"""SELECT ord, can_id, kind, value FROM (SELECT *, lag(bad) OVER (PARTITION BY can_id, kind ORDER BY ord) AS was FROM
  (SELECT *, value < {LOW} - 1e-9 OR value > {HIGH} + 1e-9 OR isnan(value) AS bad FROM bus WHERE len >= 8)) WHERE bad AND NOT coalesce(was, false)""")
def signal_range_onsets(spark, sf_dir):
    rows = bus(spark, sf_dir).filter("len >= 8")  # frames of another length keep the latch
    bad = (F.col("value") < LOW - 1e-9) | (F.col("value") > HIGH + 1e-9) | F.isnan("value")
    return Timeline(("can_id", "kind"), ("ord",), DAYS).onsets(rows, bad).select("ord", "can_id", "kind", "value")


@query(f"""SELECT ord, channel, can_id FROM (SELECT *, lag(unknown) OVER o AS was, lag(can_id) OVER o AS before FROM
  (SELECT *, can_id NOT IN (SELECT s_suppkey FROM supplier) AS unknown FROM bus) WINDOW o AS (PARTITION BY channel ORDER BY ord))
  WHERE unknown AND NOT coalesce(was AND before = can_id, false)""")
def unknown_id_runs(spark, sf_dir):
    known = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("can_id"))
    return rules.unknown_runs(bus(spark, sf_dir), known, BY_CHANNEL).select("ord", "channel", "can_id")


@query("""SELECT ord, can_id, kind, len, expected FROM bus JOIN (SELECT kind, max(len) AS expected FROM bus GROUP BY kind) USING (kind) WHERE len <> expected""")
def length_mismatch(spark, sf_dir):
    b = bus(spark, sf_dir).select("ord", "can_id", "kind", "len")
    expected = b.groupBy("kind").agg(F.max("len").alias("expected"))  # one row per kind
    return b.join(expected, "kind").filter("len <> expected")


_RESET = "kind = 'error' AND value > 200"


@query(f"SELECT ord, CAST(sum(CASE WHEN {_RESET} THEN 1 ELSE 0 END) OVER (ORDER BY ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_index FROM bus")
def session_index(spark, sf_dir):
    return enrich.session_index(bus(spark, sf_dir), ALL, F.expr(_RESET)).select("ord", "session_index")


@query(f""", e AS (SELECT *, CAST(sum(CASE WHEN {_RESET} THEN 1 ELSE 0 END) OVER (ORDER BY ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch,
  CAST(sum(CASE WHEN {_RESET} AND k > 50 THEN 1 ELSE 0 END) OVER (ORDER BY ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS learning_epoch FROM bus)
SELECT ord, can_id, epoch, learning_epoch, ts_us - lag(ts_us) OVER (PARTITION BY can_id, epoch ORDER BY ord) AS dt_us FROM e""")
def epoch_intervals(spark, sf_dir):
    rows = enrich.reset_epochs(bus(spark, sf_dir), ALL, F.expr(_RESET), F.col("k") > 50)
    return enrich.intervals(rows, Timeline(("can_id", "epoch"), ("ord",), DAYS)).select("ord", "can_id", "epoch", "learning_epoch", "dt_us")


@query("SELECT ord, channel, last_value(CASE WHEN kind = 'purchase' THEN ts_us END IGNORE NULLS) OVER (PARTITION BY channel ORDER BY ord ROWS UNBOUNDED PRECEDING) AS sync_us FROM bus")
def asof_sync(spark, sf_dir):
    return BY_CHANNEL.last_known(bus(spark, sf_dir), F.when(F.col("kind") == "purchase", F.col("ts_us")), "sync_us").select("ord", "channel", "sync_us")


@query("""SELECT ord, CASE WHEN sync IS NULL THEN NULL WHEN d >= 2147483648 THEN sync + d - 4294967296 ELSE sync + d END AS ts64,
  CASE WHEN d = 2147483648 OR sync IS NULL THEN NULL WHEN d > 2147483648 THEN sync + d - 4294967296 ELSE sync + d END AS ts64_strict
  FROM (SELECT *, ((ts_us % 4294967296 - sync % 4294967296) % 4294967296 + 4294967296) % 4294967296 AS d FROM
  (SELECT *, last_value(CASE WHEN kind = 'purchase' THEN ts_us END IGNORE NULLS) OVER (PARTITION BY channel ORDER BY ord ROWS UNBOUNDED PRECEDING) AS sync FROM bus))""")
def restore_time(spark, sf_dir):
    rows = BY_CHANNEL.last_known(bus(spark, sf_dir), F.when(F.col("kind") == "purchase", F.col("ts_us")), "sync")
    low = F.pmod("ts_us", F.lit(enrich.U32))
    return rows.select("ord", enrich.restore_time(low, F.col("sync")).alias("ts64"), enrich.restore_time(low, F.col("sync"), True).alias("ts64_strict"))


_GAPS = """SELECT ord, channel, CASE WHEN g IS NULL OR g > {most} THEN 0 ELSE g END AS missing FROM (SELECT *, ((seq - lag(seq) OVER (PARTITION BY channel ORDER BY ord) - 1) % 65536 + 65536) % 65536 AS g FROM
  (SELECT *, (ord * 7) % 65536 AS seq FROM bus WHERE kind <> 'error'))"""


def _gaps(spark, sf_dir, most):
    rows = bus(spark, sf_dir).filter("kind <> 'error'").withColumn("seq", F.pmod(F.col("ord") * 7, F.lit(65536)))
    return enrich.sequence_gaps(rows, BY_CHANNEL, "seq", most)


@query(_GAPS.format(most=65535))
def sequence_gaps(spark, sf_dir):
    return _gaps(spark, sf_dir, 65535).select("ord", "channel", "missing")


_DELTAS = """SELECT ord, can_id, channel, ts_us, ((c - lag(c) OVER o) % 4294967296 + 4294967296) % 4294967296 AS c_delta, c < lag(c) OVER o AS c_wrapped FROM
  (SELECT *, (ord * 40000000 + k) % 4294967296 AS c FROM bus) WINDOW o AS (PARTITION BY channel ORDER BY ord)"""


def _deltas(spark, sf_dir):
    rows = bus(spark, sf_dir).withColumn("c", F.pmod(F.col("ord") * 40000000 + F.col("k"), F.lit(enrich.U32)))
    return enrich.counter_deltas(rows, BY_CHANNEL, ["c"])


@query(_DELTAS)
def counter_deltas(spark, sf_dir):
    return _deltas(spark, sf_dir).select("ord", "can_id", "channel", "ts_us", "c_delta", "c_wrapped")


@query("SELECT ord, can_id, kind, before FROM (SELECT *, lag(kind) OVER (PARTITION BY can_id ORDER BY ord) AS before FROM bus) WHERE kind <> before")
def state_transitions(spark, sf_dir):
    return enrich.transitions(bus(spark, sf_dir), BY_ID, "kind").select("ord", "can_id", "kind", "before")


@query(f""", g AS ({_GAPS.format(most=32768)}), s AS (SELECT *, CAST(sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS interval_no FROM bus)
SELECT channel, interval_no, min(ts_us) AS start_us, max(ts_us) AS end_us, CAST(sum(coalesce(missing, 0)) AS BIGINT) AS missing, sum(CASE WHEN kind = 'view' AND value > 480 THEN 1 ELSE 0 END)::BIGINT AS losses,
  sum(coalesce(missing, 0)) < 400 AND sum(CASE WHEN kind = 'view' AND value > 480 THEN 1 ELSE 0 END) = 0 AS complete FROM s LEFT JOIN g USING (ord, channel) GROUP BY channel, interval_no""")
def incomplete_intervals(spark, sf_dir):
    rows = BY_CHANNEL.running_sum(bus(spark, sf_dir), F.col("kind").eqNullSafe("error").cast("long"), "interval_no")
    gaps = _gaps(spark, sf_dir, 32768).select("ord", "channel", "missing")
    rows = rows.join(gaps, ["ord", "channel"], "left").withColumn("_loss", ((F.col("kind") == "view") & (F.col("value") > 480)).cast("long"))
    out = rows.groupBy("channel", "interval_no").agg(
        F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.sum(F.coalesce("missing", F.lit(0))).alias("missing"), F.sum("_loss").alias("losses")
    )
    return out.withColumn("complete", (F.col("missing") < 400) & (F.col("losses") == 0))


_WINDOWS = f"""win AS (SELECT can_id, channel, (ts_us - {START}) // {DAY} AS w, count(*) AS frames, count(dt) AS intervals, avg(dt) AS mean_us, stddev_pop(dt) AS jitter_us, min(dt) AS min_us, max(dt) AS max_us
  FROM (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY channel, can_id ORDER BY ord) AS dt FROM bus) GROUP BY 1, 2, 3)"""


def _windowed(spark, sf_dir):
    rows = enrich.intervals(bus(spark, sf_dir), Timeline(("channel", "can_id"), ("ord",), DAYS))
    return features.windowed(rows, START, DAY)


@query(f", {_WINDOWS} SELECT can_id, channel, w AS \"window\", frames, intervals, round(mean_us, 3) AS mean_us, round(jitter_us / 1e6, 3) AS jitter_s, min_us, max_us FROM win")
def feature_windows(spark, sf_dir):
    out = features.feature_windows(_windowed(spark, sf_dir), ["can_id", "channel"])
    return out.withColumn("mean_us", F.round("mean_us", 3)).withColumn("jitter_s", F.round(F.col("jitter_us") / 1e6, 3)).drop("jitter_us")


_SPANS = f"""spans AS (SELECT can_id, min(dt_us) * 2 AS low_us, max(dt_us) * 0.5 AS high_us, avg(dt_us) AS mean_us, stddev_pop(dt_us) AS std_us FROM frames WHERE ts_us < {TEST} GROUP BY can_id)"""


def _spans(frames):
    learnt = frames.filter(F.col("ts_us") < TEST).groupBy("can_id")
    return learnt.agg((F.min("dt_us") * 2).alias("low_us"), (F.max("dt_us") * 0.5).alias("high_us"), F.avg("dt_us").alias("mean_us"), F.stddev_pop("dt_us").alias("std_us"))


@query(f", {_SPANS} SELECT ord, can_id, (ts_us - {START}) // {DAY} AS \"window\", dt_us FROM frames JOIN spans USING (can_id) WHERE ts_us >= {TEST} AND (dt_us < low_us OR dt_us > high_us)")
def window_period(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    rows = features.windowed(frames.filter(F.col("ts_us") >= TEST), START, DAY)
    return features.outside(rows, _spans(frames), "can_id", "dt_us", "low_us", "high_us").select("ord", "can_id", "window", "dt_us")


@query(f""", c AS (SELECT can_id, (ts_us - {START}) // {DAY} AS w, count(*) AS n FROM bus GROUP BY 1, 2),
b AS (SELECT can_id, min(n) AS lo, max(n) AS hi FROM c WHERE w < 10 GROUP BY can_id)
SELECT can_id, w AS "window", n, CASE WHEN n > hi THEN 'frequency_increase' ELSE 'frequency_decrease' END AS type FROM c JOIN b USING (can_id) WHERE w >= 10 AND (n < lo OR n > hi)""")
def window_frequency(spark, sf_dir):
    counts = features.windowed(bus(spark, sf_dir), START, DAY).groupBy("can_id", "window").agg(F.count("*").alias("n"))
    base = counts.filter("window < 10").groupBy("can_id").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    out = features.outside(counts.filter("window >= 10"), base, "can_id", "n", "lo", "hi")
    return out.select("can_id", "window", "n", F.when(F.col("n") > F.col("hi"), "frequency_increase").otherwise("frequency_decrease").alias("type"))


@query(f", {_SPANS} SELECT ord, can_id, (ts_us - {START}) // {DAY} AS \"window\", dt_us FROM frames JOIN spans USING (can_id) WHERE ts_us >= {TEST} AND std_us > 0 AND abs(dt_us - mean_us) > std_us * {SIGMAS}")
def window_sigma(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    rows = features.windowed(frames.filter(F.col("ts_us") >= TEST), START, DAY).join(_spans(frames), "can_id")
    return rows.filter(rules.sigma_bad(F.col("dt_us"), F.col("mean_us"), F.col("std_us"), SIGMAS)).select("ord", "can_id", "window", "dt_us")


@query(f""", t AS (SELECT *, (ts_us - {START}) // {DAY} AS w, dt_us < period_us * {BURST} AS short FROM tested),
g AS (SELECT *, sum(CASE WHEN short THEN 0 ELSE 1 END) OVER (PARTITION BY can_id, w ORDER BY ord ROWS UNBOUNDED PRECEDING) AS grp FROM t)
SELECT can_id, w AS "window", min(ord) AS first_ord, count(*) AS n FROM g WHERE short GROUP BY can_id, w, grp HAVING count(*) >= 2""")
def window_bursts(spark, sf_dir):
    rows = features.windowed(_tested(spark, sf_dir), START, DAY).withColumn("_short", F.col("dt_us") < F.col("period_us") * BURST)
    rows = Timeline(("can_id", "window"), ("ord",), "0").running_sum(rows, (~F.col("_short")).cast("long"), "_run")
    runs = rows.filter("_short").groupBy("can_id", "window", "_run").agg(F.min("ord").alias("first_ord"), F.count("*").alias("n"))
    return runs.filter("n >= 2").select("can_id", "window", "first_ord", "n")


@query(f", d AS (SELECT can_id, kind, stddev_pop(k % 2) AS sd, count(*) AS n FROM bus WHERE ts_us < {TEST} GROUP BY 1, 2) SELECT DISTINCT can_id, kind, n FROM d WHERE n > 1 AND sd = 0")
def sigma_disabled(spark, sf_dir):
    learnt = bus(spark, sf_dir).filter(F.col("ts_us") < TEST).groupBy("can_id", "kind").agg(F.stddev_pop(F.col("k") % 2).alias("sd"), F.count("*").alias("n"))
    return learnt.filter("n > 1 and sd = 0").select("can_id", "kind", "n")


@query("SELECT ord, can_id, channel, kind, value FROM bus WHERE kind IN ('error', 'signup') AND value > 100")
def controller_events(spark, sf_dir):
    return bus(spark, sf_dir).filter(F.col("kind").isin("error", "signup") & (F.col("value") > 100)).select("ord", "can_id", "channel", "kind", "value")


@query("SELECT channel, kind, count(*) AS records, CAST(sum(1 + k) AS BIGINT) AS occurrences FROM bus WHERE kind IN ('error', 'click') GROUP BY channel, kind")
def rejected_frames(spark, sf_dir):
    rows = bus(spark, sf_dir).filter(F.col("kind").isin("error", "click"))
    return rows.groupBy("channel", "kind").agg(F.count("*").alias("records"), F.sum(1 + F.col("k")).alias("occurrences"))


_PERIOD = f"SELECT ord, can_id, ts_us, CAST(dt_us AS DOUBLE) AS measured FROM (SELECT *, lag(bad) OVER (PARTITION BY can_id ORDER BY ord) AS was FROM (SELECT *, abs(dt_us - period_us) > period_us * {TOLERANCE} AS bad FROM tested)) WHERE bad AND NOT coalesce(was, false)"
_UNION = f"""ev AS (SELECT 0 AS stage, 'signal_out_of_range' AS type, ord, can_id, ts_us, value AS measured FROM bus WHERE ts_us >= {TEST} AND value > {HIGH}
UNION ALL SELECT 1, 'controller_event', ord, can_id, ts_us, NULL FROM bus WHERE ts_us >= {TEST} AND kind = 'error' AND value > 100
UNION ALL SELECT 2, 'period_violation', * FROM ({_PERIOD}))"""


def _events(spark, sf_dir):
    late = bus(spark, sf_dir).filter(F.col("ts_us") >= TEST)
    period = BY_ID.onsets(_tested(spark, sf_dir), rules.period_bad(F.col("dt_us"), F.col("period_us"), TOLERANCE))
    parts = [
        ("signal_out_of_range", late.filter(F.col("value") > HIGH).withColumn("measured", F.col("value"))),
        ("controller_event", late.filter("kind = 'error' and value > 100")),
        ("period_violation", period.withColumn("measured", F.col("dt_us").cast("double"))),
    ]
    return rules.union_events(parts, ["ord", "can_id", "ts_us", "measured"])


@query(f", {_UNION} SELECT * FROM ev")
def unified_events(spark, sf_dir):
    return _events(spark, sf_dir)


@query(f", {_UNION} SELECT t.type, count(ev.type) AS n FROM (VALUES ('signal_out_of_range'), ('controller_event'), ('period_violation'), ('burst')) t(type) LEFT JOIN ev USING (type) GROUP BY t.type")
def event_counts(spark, sf_dir):
    counts = _events(spark, sf_dir).groupBy("type").agg(F.count("*").alias("_n"))
    kinds = spark.createDataFrame([("signal_out_of_range",), ("controller_event",), ("period_violation",), ("burst",)], "type string")
    return kinds.join(counts, "type", "left").select("type", F.coalesce("_n", F.lit(0)).alias("n"))


_EPISODES = f"""episodes AS (SELECT ord AS episode, ts_us AS start_us, ts_us + {DAY} // 24 AS end_us, CASE WHEN k % 3 = 0 THEN NULL ELSE can_id END AS episode_can_id,
  CASE WHEN k % 2 = 0 THEN 'burst' ELSE 'disappearance' END AS kind_of FROM bus WHERE kind = 'purchase' AND value > 120 AND ts_us >= {TEST})"""
_SLACK = DAY // 24
_MATCH = f"""matched AS (SELECT e.ord AS event_id, e.type, e.can_id, e.ts_us, m.episode FROM ev e LEFT JOIN (SELECT ord, type, episode FROM (SELECT e.ord, e.type, p.episode, row_number() OVER (PARTITION BY e.ord, e.type
  ORDER BY abs(e.ts_us - p.start_us), p.episode) AS rn FROM ev e JOIN episodes p ON (p.episode_can_id IS NULL OR p.episode_can_id = e.can_id) AND e.ts_us BETWEEN p.start_us - {_SLACK} AND p.end_us + {_SLACK}) WHERE rn = 1) m ON m.ord = e.ord AND m.type = e.type)"""


def _episodes(spark, sf_dir):
    rows = bus(spark, sf_dir).filter((F.col("kind") == "purchase") & (F.col("value") > 120) & (F.col("ts_us") >= TEST))
    return rows.select(
        F.col("ord").alias("episode"), F.col("ts_us").alias("start_us"), (F.col("ts_us") + DAY // 24).alias("end_us"), F.when(F.col("k") % 3 != 0, F.col("can_id")).alias("episode_can_id"),
        F.when(F.col("k") % 2 == 0, "burst").otherwise("disappearance").alias("kind_of"),
    )


def _matched(spark, sf_dir):
    ev = _events(spark, sf_dir).withColumn("event_id", F.concat_ws("/", "ord", "type"))
    out = evaluation.match_episodes(ev, _episodes(spark, sf_dir), _SLACK, 3 * _SLACK)
    return out.select(F.col("ord").alias("event_id"), "type", "can_id", "ts_us", "episode")


@query(f", {_UNION}, {_EPISODES}, {_MATCH} SELECT * FROM matched")
def match_episodes(spark, sf_dir):
    return _matched(spark, sf_dir)


@query(f""", {_UNION}, {_EPISODES}, {_MATCH}, grid AS (SELECT DISTINCT k.kind_of, t.type FROM (SELECT DISTINCT kind_of FROM episodes) k, (SELECT DISTINCT type FROM ev) t),
hit AS (SELECT DISTINCT p.kind_of, m.type, m.episode FROM matched m JOIN episodes p USING (episode)),
n AS (SELECT kind_of, count(*) AS total FROM episodes GROUP BY 1), f AS (SELECT type, count(*) AS fp FROM matched WHERE episode IS NULL GROUP BY 1),
h AS (SELECT kind_of, type, count(*) AS tp FROM hit GROUP BY 1, 2),
c AS (SELECT kind_of, type, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, total - coalesce(tp, 0) AS fn FROM grid JOIN n USING (kind_of) LEFT JOIN f USING (type) LEFT JOIN h USING (kind_of, type))
SELECT kind_of, type, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1 FROM c""")
def episode_metrics(spark, sf_dir):
    m, e = _matched(spark, sf_dir), _episodes(spark, sf_dir)
    kinds, types = e.groupBy("kind_of").agg(F.count("*").alias("total")), m.groupBy("type").agg(F.sum(F.col("episode").isNull().cast("long")).alias("fp"))
    hit = m.filter("episode is not null").join(e.select("episode", "kind_of"), "episode").groupBy("kind_of", "type").agg(F.countDistinct("episode").alias("_tp"))
    grid = kinds.crossJoin(types).join(hit, ["kind_of", "type"], "left").withColumn("tp", F.coalesce("_tp", F.lit(0)))  # kinds x types: a handful of rows
    out = evaluation.scores(grid.withColumn("fn", F.col("total") - F.col("tp")))
    return out.select("kind_of", "type", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f""", {_UNION}, {_EPISODES} SELECT ord, type, CASE WHEN ts_us < {TEST + DAY} THEN 'boundary_guard'
  WHEN EXISTS (SELECT 1 FROM episodes p WHERE ev.ts_us BETWEEN p.start_us AND p.end_us AND (p.episode_can_id IS NULL OR p.episode_can_id = ev.can_id)) THEN 'target_episode'
  WHEN EXISTS (SELECT 1 FROM episodes p WHERE ev.ts_us BETWEEN p.end_us AND p.end_us + {_SLACK} AND (p.episode_can_id IS NULL OR p.episode_can_id = ev.can_id)) THEN 'target_recovery'
  WHEN EXISTS (SELECT 1 FROM episodes p WHERE ev.ts_us BETWEEN p.start_us AND p.end_us) THEN 'other_id_during_episode' ELSE 'background_candidate' END AS category FROM ev""")
def event_category(spark, sf_dir):
    ev, e = _events(spark, sf_dir), _episodes(spark, sf_dir)
    own = F.col("episode_can_id").isNull() | (F.col("episode_can_id") == F.col("can_id"))
    inside = (F.col("ts_us") <= F.col("end_us"))
    found = ranges.in_ranges(ev, "ts_us", e, F.col("start_us"), F.col("end_us") + _SLACK, 2 * _SLACK)
    flags = found.groupBy("ord", "type").agg(
        F.max(inside & own).alias("_target"), F.max((F.col("ts_us") >= F.col("end_us")) & own).alias("_after"), F.max(inside).alias("_other")
    )
    category = (
        F.when(F.col("ts_us") < TEST + DAY, "boundary_guard").when(F.col("_target"), "target_episode").when(F.col("_after"), "target_recovery")
        .when(F.col("_other"), "other_id_during_episode").otherwise("background_candidate")
    )
    return ev.join(flags, ["ord", "type"], "left").select("ord", "type", category.alias("category"))


@query(""", b AS (SELECT ord, ts_us AS s, ts_us + 7200000000 + k * 1000000 AS e FROM bus WHERE kind IN ('purchase', 'error') AND value > 120),
r AS (SELECT *, max(e) OVER (ORDER BY s, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (ORDER BY s, ord ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT min(s) AS start_us, max(e) AS end_us, count(*) AS n_intervals FROM i GROUP BY island""")
def clean_background(spark, sf_dir):
    rows = bus(spark, sf_dir).filter(F.col("kind").isin("purchase", "error") & (F.col("value") > 120))
    spans = rows.select("ord", F.col("ts_us").alias("start_us"), (F.col("ts_us") + 7200000000 + F.col("k") * 1000000).alias("end_us"))
    return ranges.islands(spans, (), "start_us", "end_us", ("start_us", "ord"), f"floor(start_us / {DAY})")


@query(f""", {_UNION}, {_EPISODES}, {_MATCH}, f AS (SELECT m.type, m.episode, min(m.ts_us) - min(p.start_us) AS latency FROM matched m JOIN episodes p USING (episode) GROUP BY 1, 2)
SELECT type, count(*) AS n, min(latency) AS min_us, round(median(latency), 3) AS median_us, max(latency) AS max_us FROM f GROUP BY type""")
def latency_stats(spark, sf_dir):
    hits = stored(evaluation.first_hits(_matched(spark, sf_dir), _episodes(spark, sf_dir), ["type"]).select("type", "latency_us"))
    told = hits.groupBy("type").agg(F.count("*").alias("n"), F.min("latency_us").alias("min_us"), F.max("latency_us").alias("max_us"))
    middle = evaluation.medians(hits, ["type"], "latency_us", "median_us", DAY // 1440)
    return told.join(middle, "type").select("type", "n", "min_us", F.round("median_us", 3).alias("median_us"), "max_us")


@query(f""", {_UNION}, {_EPISODES}, {_MATCH}, h AS (SELECT p.episode, p.kind_of, max(CASE WHEN m.type = 'signal_out_of_range' THEN 1 ELSE 0 END) AS a, max(CASE WHEN m.type = 'period_violation' THEN 1 ELSE 0 END) AS b,
  max(CASE WHEN m.type IS NULL THEN 0 ELSE 1 END) AS c FROM episodes p LEFT JOIN matched m USING (episode) GROUP BY 1, 2)
SELECT kind_of, CAST(sum(a) AS BIGINT) AS signal_out_of_range, CAST(sum(b) AS BIGINT) AS period_violation, CAST(sum(c) AS BIGINT) AS any_rule, count(*) AS episodes FROM h GROUP BY kind_of""")
def hit_matrix(spark, sf_dir):
    kinds = ["signal_out_of_range", "period_violation"]
    hits = _matched(spark, sf_dir).filter("episode is not null").groupBy("episode").pivot("type", [*kinds, "controller_event"]).agg(F.lit(1).alias("hit"))
    rows = _episodes(spark, sf_dir).join(hits, "episode", "left").withColumn("any_rule", F.coalesce(*kinds, "controller_event"))
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in [*kinds, "any_rule"]]
    return rows.groupBy("kind_of").agg(*sums, F.count("*").alias("episodes"))


@query(f""", {_EPISODES} SELECT p.episode, count(b.ord) AS n, round(count(b.ord) / ((p.end_us - p.start_us) / 1e6), 9) AS per_second FROM episodes p
  LEFT JOIN bus b ON b.ts_us BETWEEN p.start_us AND p.end_us AND (p.episode_can_id IS NULL OR b.can_id = p.episode_can_id) GROUP BY p.episode, p.start_us, p.end_us""")
def achieved_intensity(spark, sf_dir):
    e = _episodes(spark, sf_dir)
    frames = bus(spark, sf_dir).select("ts_us", F.explode(F.array_distinct(F.array(F.col("can_id"), F.lit(None)))).alias("episode_can_id"))  # null: those of any id
    n = ranges.count_in_ranges(frames, "ts_us", e, F.col("start_us"), F.col("end_us"), ["episode_can_id"], ["episode"], 2 * _SLACK).withColumnRenamed("n", "_n")
    out = e.join(n, "episode", "left").withColumn("n", F.coalesce("_n", F.lit(0)))
    return out.select("episode", "n", F.round(F.col("n") / ((F.col("end_us") - F.col("start_us")) / 1e6), 9).alias("per_second"))


@query("SELECT channel, arg_max(ord, ord) AS ord, arg_max(kind, ord) AS kind, arg_max(value, ord) AS value FROM bus GROUP BY channel")
def latest_by_bus(spark, sf_dir):
    newest = bus(spark, sf_dir).groupBy("channel").agg(F.max(F.struct("ord", "kind", "value")).alias("r"))
    return newest.select("channel", "r.ord", "r.kind", "r.value")


@query("""SELECT ord, k, array_to_string(list_filter([CASE WHEN k & 1 > 0 THEN 'warning' END, CASE WHEN k & 2 > 0 THEN 'passive' END, CASE WHEN k & 4 > 0 THEN 'bus_off' END,
  CASE WHEN k >= 8 THEN '0x' || upper(to_hex(k & ~7)) END], lambda x: x IS NOT NULL), ',') AS names, CASE WHEN k & 4 > 0 THEN 'critical' WHEN k & 3 > 0 THEN 'warning' ELSE 'info' END AS severity FROM bus""")
def diag_kv(spark, sf_dir):
    from busloom.functions.bits import mask_names

    k = F.col("k")
    severity = F.when(k.bitwiseAND(4) > 0, "critical").when(k.bitwiseAND(3) > 0, "warning").otherwise("info")
    return bus(spark, sf_dir).select("ord", "k", mask_names(k, {1: "warning", 2: "passive", 4: "bus_off"}).alias("names"), severity.alias("severity"))


@query(f"""SELECT ord, t + days * {DAY} AS unrolled FROM (SELECT *, sum(CASE WHEN before - t > {DAY // 2} THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY ord ROWS UNBOUNDED PRECEDING)::BIGINT AS days FROM
  (SELECT *, lag(t) OVER (PARTITION BY channel ORDER BY ord) AS before FROM (SELECT *, ts_us % {DAY} AS t FROM bus)))""")
def midnight_rollover(spark, sf_dir):
    rows = bus(spark, sf_dir).withColumn("t", F.col("ts_us") % DAY)
    return enrich.midnight_rollover(rows, BY_CHANNEL, "t", DAY).select("ord", "unrolled")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS line FROM lineitem", )
def signal_partition_sort(spark, sf_dir):
    from pyspark.sql.window import Window as W

    order = W.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber", F.row_number().over(order).cast("long").alias("line"))


@query(""", a AS (SELECT DISTINCT can_id FROM bus), b AS (SELECT DISTINCT c_custkey AS can_id FROM customer)
SELECT can_id, CASE WHEN b.k IS NULL THEN 'profile_only' ELSE 'catalog_only' END AS side FROM (SELECT can_id, 1 AS k FROM a) a FULL JOIN (SELECT can_id, 1 AS k FROM b) b USING (can_id) WHERE a.k IS NULL OR b.k IS NULL""")
def profile_vs_catalog(spark, sf_dir):
    ids = bus(spark, sf_dir).select("can_id").distinct()
    catalog = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("can_id")).distinct()
    gone = ids.join(catalog, "can_id", "left_anti").withColumn("side", F.lit("profile_only"))
    return gone.unionByName(catalog.join(ids, "can_id", "left_anti").withColumn("side", F.lit("catalog_only")))


@query(""", t AS (SELECT ord, can_id, kind, row_number() OVER (PARTITION BY can_id, kind ORDER BY ord) AS o FROM bus WHERE channel = 1),
r AS (SELECT ord, can_id, kind, row_number() OVER (PARTITION BY can_id, kind ORDER BY ord) AS o FROM bus WHERE channel = 2)
SELECT coalesce(t.can_id, r.can_id) AS can_id, coalesce(t.kind, r.kind) AS kind, coalesce(t.o, r.o) AS occurrence, t.ord AS tx_ord, r.ord AS rx_ord FROM t FULL JOIN r ON t.can_id = r.can_id AND t.kind = r.kind AND t.o = r.o""")
def frame_match(spark, sf_dir):
    side = lambda n, name: bus(spark, sf_dir).filter(F.col("channel") == n).select("can_id", "kind", F.col("ord").alias(name))
    out = evaluation.occurrence_join(side(1, "tx_ord"), side(2, "rx_ord"), ["can_id", "kind"], ["tx_ord"], ["rx_ord"])
    return out.select("can_id", "kind", F.col("occurrence").cast("long").alias("occurrence"), "tx_ord", "rx_ord")


@query(""", a AS (SELECT can_id, kind, k FROM bus), b AS (SELECT can_id, kind, CASE WHEN ord % 97 = 0 THEN k + 1 ELSE k END AS k FROM bus)
SELECT can_id, kind, k, CAST(sum(n) AS BIGINT) AS surplus FROM (SELECT *, 1 AS n FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY can_id, kind, k HAVING sum(n) <> 0""")
def replay_equality(spark, sf_dir):
    a = bus(spark, sf_dir)
    b = a.withColumn("k", F.when(F.col("ord") % 97 == 0, F.col("k") + 1).otherwise(F.col("k")))
    return evaluation.differences(a.select("can_id", "kind", "k"), b.select("can_id", "kind", "k"))


_TX = "t AS (SELECT ord AS tx_id, kind, ts_us AS tx_us FROM bus WHERE channel = 1), r AS (SELECT ord AS rx_id, kind, ts_us + k * 1000000 AS rx_us FROM bus WHERE channel = 2)"


@query(f""", {_TX}, p AS (SELECT *, rx_us - tx_us AS residual_us FROM t JOIN r USING (kind) WHERE abs(rx_us - tx_us) <= 900000000),
a AS (SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY abs(residual_us), rx_id) AS na, row_number() OVER (PARTITION BY rx_id ORDER BY abs(residual_us), tx_id) AS nb FROM p)
SELECT tx_id, rx_id, residual_us FROM a WHERE na = 1 AND nb = 1""")
def match_by_time(spark, sf_dir):
    b = bus(spark, sf_dir)
    tx = b.filter("channel = 1").select(F.col("ord").alias("tx_id"), "kind", F.col("ts_us").alias("tx_us"))
    rx = b.filter("channel = 2").select(F.col("ord").alias("rx_id"), "kind", (F.col("ts_us") + F.col("k") * 1000000).alias("rx_us"))
    return audit.match_by_time(tx, rx, ["kind"], 900_000_000)


@query(f""", w AS (SELECT channel, ts_us // {DAY} AS w, count(*) AS n, CAST(sum(CASE WHEN kind = 'error' THEN k ELSE 0 END) AS BIGINT) AS dropped, CAST(sum(CASE WHEN value > 490 THEN 1 ELSE 0 END) AS BIGINT) AS overrun FROM bus GROUP BY 1, 2)
SELECT channel, max(n) AS max_records, round(avg(n), 6) AS mean_records, CAST(sum(dropped) AS BIGINT) AS dropped, CAST(sum(overrun) AS BIGINT) AS overrun, sum(dropped) + sum(overrun) = 0 AS lossless FROM w GROUP BY channel""")
def link_statistics(spark, sf_dir):
    rows = bus(spark, sf_dir).withColumns({"dropped": F.when(F.col("kind") == "error", F.col("k")).otherwise(0), "overrun": (F.col("value") > 490).cast("long")})
    return audit.link_statistics(rows, DAY, ["dropped", "overrun"]).withColumn("mean_records", F.round("mean_records", 6))


@query("SELECT can_id, kind, count(dt_us) AS n, round(avg(dt_us), 3) AS mean_us, round(stddev_samp(dt_us) / 1e6, 3) AS std_s, count(CASE WHEN dt_us > 100000000000 THEN 1 END) AS exceeding FROM frames GROUP BY can_id, kind")
def interval_statistics(spark, sf_dir):
    out = audit.interval_statistics(_frames(spark, sf_dir), ["can_id", "kind"], F.col("dt_us") > 100_000_000_000)
    return out.select("can_id", "kind", "n", F.round("mean_us", 3).alias("mean_us"), F.round(F.col("std_us") / 1e6, 3).alias("std_s"), "exceeding")


@query("""SELECT capture_id, run_id, d AS distance_us FROM (SELECT a.ord AS capture_id, b.ord AS run_id, abs(a.ts_us - b.ts_us) AS d, row_number() OVER (PARTITION BY a.ord ORDER BY abs(a.ts_us - b.ts_us), b.ord) AS n
  FROM bus a JOIN bus b ON a.can_id = b.can_id AND a.kind = 'purchase' AND b.kind = 'signup') WHERE n = 1""")
def nearest_capture(spark, sf_dir):
    b = bus(spark, sf_dir)
    captures = b.filter("kind = 'purchase'").select("can_id", F.col("ord").alias("capture_id"), F.col("ts_us").alias("capture_us"))
    runs = b.filter("kind = 'signup'").select("can_id", F.col("ord").alias("run_id"), F.col("ts_us").alias("run_us"))
    return audit.nearest_capture(captures, runs, ["can_id"])


@query(f""", q AS (SELECT ts_us AS s, ts_us + 3600000000 + 3050000 AS e FROM bus WHERE {_RESET}), {_UNION}
SELECT ord, type FROM ev WHERE NOT EXISTS (SELECT 1 FROM q WHERE ev.ts_us BETWEEN q.s AND q.e)""")
def quality_masked(spark, sf_dir):
    gaps = bus(spark, sf_dir).filter(_RESET).select(F.col("ts_us").alias("start_us"), (F.col("ts_us") + 3_600_000_000).alias("end_us"))
    return audit.masked(_events(spark, sf_dir), audit.reinitialisation_mask(gaps, 3_050_000), DAY // 12).select("ord", "type")


@query(f""", c AS ({_PERIOD}), r AS (SELECT ord FROM (SELECT *, lag(bad) OVER (PARTITION BY can_id ORDER BY ord) AS was FROM
  (SELECT *, std_us > 0 AND abs(dt_us - period_us) > std_us * {SIGMAS} AS bad FROM tested)) WHERE bad AND NOT coalesce(was, false))
SELECT coalesce(c.ord, r.ord) AS ord, CASE WHEN c.ord IS NULL THEN 'recorded_only' WHEN r.ord IS NULL THEN 'computed_only' ELSE 'both' END AS side FROM c FULL JOIN r ON c.ord = r.ord""")
def onset_reconstruction(spark, sf_dir):
    tested, bad = _tested(spark, sf_dir), rules.period_bad(F.col("dt_us"), F.col("period_us"), TOLERANCE)
    recorded = BY_ID.onsets(tested, rules.sigma_bad(F.col("dt_us"), F.col("period_us"), F.col("std_us"), SIGMAS)).select("ord")
    return audit.reconstruct_onsets(tested, BY_ID, bad, recorded)


@query(f""", {_EPISODES}, s AS (SELECT ord, can_id, ts_us, 0 AS k2, kind AS state FROM bus WHERE kind <> 'purchase' UNION ALL SELECT episode, can_id, ts_us, 1, NULL FROM episodes JOIN bus ON bus.ord = episodes.episode)
SELECT ord, can_id, state_before FROM (SELECT *, last_value(CASE WHEN k2 = 0 THEN state END IGNORE NULLS) OVER (PARTITION BY can_id ORDER BY ts_us, k2, ord ROWS UNBOUNDED PRECEDING) AS state_before FROM s) WHERE k2 = 1""")
def state_at_episode(spark, sf_dir):
    b = bus(spark, sf_dir).select("ord", "can_id", "ts_us", F.col("kind").alias("state"))
    points = b.join(_episodes(spark, sf_dir).select(F.col("episode").alias("ord")), "ord").drop("state")
    return audit.state_at(points, b.filter("state <> 'purchase'"), ["can_id"], f"floor(ts_us / {DAY})").select("ord", "can_id", "state_before")


@query("""SELECT kind, count(CASE WHEN a THEN 1 END) AS n_a, count(CASE WHEN b THEN 1 END) AS n_b, count(CASE WHEN NOT (a AND b) THEN 1 END) AS differing, count(CASE WHEN NOT (a AND b) THEN 1 END) = 0 AS equal
  FROM (SELECT kind, can_id, bool_or(channel = 1) AS a, bool_or(channel = 2) AS b FROM bus GROUP BY 1, 2) GROUP BY kind""")
def id_set_equality(spark, sf_dir):
    b = bus(spark, sf_dir)
    return audit.set_equality(b.filter("channel = 1"), b.filter("channel = 2"), "kind", "can_id")


@query("SELECT kind, ord, value FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY value DESC, ord) AS n FROM bus) WHERE n <= 100")
def largest_values(spark, sf_dir):
    return audit.top_rows(bus(spark, sf_dir), ["kind"], [F.desc("value"), F.col("ord")], 100).select("kind", "ord", "value")


@query("SELECT ord, channel, max(t) OVER (PARTITION BY channel ORDER BY t0, ord ROWS UNBOUNDED PRECEDING) AS clamped FROM (SELECT ord, channel, ts_us AS t0, ts_us + (k % 7) * 100000000 AS t FROM bus)")
def monotone_clamp(spark, sf_dir):
    rows = bus(spark, sf_dir).withColumn("t", F.col("ts_us") + (F.col("k") % 7) * 100_000_000)
    return Timeline(("channel",), ("ts_us", "ord"), DAYS).running_max(rows, F.col("t"), "clamped").select("ord", "channel", "clamped")


@query("SELECT DISTINCT channel, ts_us // 3600000000 AS start_h, k % 5 AS length_h FROM bus WHERE kind = 'error'")
def distinct_intervals(spark, sf_dir):
    rows = bus(spark, sf_dir).filter("kind = 'error'")
    return rows.select("channel", F.floor(F.col("ts_us") / 3_600_000_000).alias("start_h"), (F.col("k") % 5).alias("length_h")).dropDuplicates()


@query("SELECT can_id, first(ts_us ORDER BY ord) AS first_us, last(ts_us ORDER BY ord) AS last_us, last(ts_us ORDER BY ord) - first(ts_us ORDER BY ord) AS span_us, bool_or(kind = 'error') AS any_error FROM bus GROUP BY can_id")
def record_spans(spark, sf_dir):
    out = bus(spark, sf_dir).groupBy("can_id").agg(F.min_by("ts_us", "ord").alias("first_us"), F.max_by("ts_us", "ord").alias("last_us"), F.bool_or(F.col("kind") == "error").alias("any_error"))
    return out.withColumn("span_us", F.col("last_us") - F.col("first_us"))


def stream_latch(spark, sf_dir):
    """The period rule as a stateful stream over the events folder, one pass to its end."""
    from busloom.sources.streams import run_once
    from busloom.streaming import latch

    profile = _profile(_frames(spark, sf_dir)).filter("period_us is not null")
    schema = bus(spark, sf_dir).schema
    return run_once(spark, bus(spark, sf_dir), schema, lambda s: latch.period_onsets(s, profile, TOLERANCE, F.col("ts_us") >= TEST))


QUERIES["stream_latch"] = stream_latch
ORACLES["stream_latch"] = COMMON + f"""SELECT ord, can_id, ts_us, dt_us FROM (SELECT *, lag(bad) OVER (PARTITION BY can_id ORDER BY ord) AS was FROM
  (SELECT *, abs(dt_us - period_us) > period_us * {TOLERANCE} AS bad FROM tested)) WHERE bad AND NOT coalesce(was, false)"""
