"""From trace bytes to alarms: records in order, restored time, sessions, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busloom.operators import enrich, profiles, protocol, rules
from busloom.operators.timeline import Timeline
from busloom.sources import traces

ORDER, SLICE = ("block", "line"), "block"  # a slice of a trace is one input split
ERRORS = ["stuff_errors", "form_errors", "ack_errors", "bit_recessive_errors", "bit_dominant_errors", "crc_errors", "other_errors", "warning_entries", "bus_off_entries"]
LOSSES = ["fifo_full", "fifo_overrun", "ring_dropped", "rx_read_errors"]


def timed_records(records: DataFrame) -> DataFrame:
    """Whole records (``traces.deframe`` of ``traces.read_trace``) with ``session_index`` and ``sync_us``, the
    newest 64-bit time told by a time or session record before each."""
    line = Timeline(("trace",), ORDER, SLICE)
    good = records.filter("status = 'ok'")
    starts, ticks = (F.col("type") == 3) & (F.length("payload") == 39), (F.col("type") == 2) & (F.length("payload") == 8)
    sync = F.when(ticks, traces.number(F.col("payload"), 0, 8)).when(starts, traces.number(F.col("payload"), 4, 8))
    rows = enrich.session_index(good, line, starts)
    return line.last_known(rows, sync, "sync_us")


def trace_frames(records: DataFrame) -> DataFrame:
    """Frames with ``ts_us`` (null before any sync, or where the nearest time is ambiguous) and the time
    since their identifier's frame before in the same session."""
    rows = traces.frames(timed_records(records)).withColumn("ts_us", enrich.restore_time(F.col("ts32"), F.col("sync_us"), reject_ambiguous=True))
    line = Timeline(("trace", "session_index", "channel", "can_id"), ORDER, SLICE)
    return enrich.intervals(rows, line).select("trace", *ORDER, "seq", "session_index", "channel", "can_id", "dlc", "data", "ts_us", "dt_us")


def trace_alarms(records: DataFrame, messages: DataFrame, learn_us: int, min_intervals: int, tolerance: float, burst: float, burst_frames: int, rearm_us: int = 1_000_000) -> DataFrame:
    """Alarms of all traces: ``stage``, ``type``, place (trace, block, line, session_index), channel, can_id,
    ``ts_us``, ``measured`` and ``expected``.

    ``messages`` (can_id, data_length) are the definitions. Periods are learnt per trace, session, channel
    and identifier in the first ``learn_us`` of a session and tested after. Unknown identifiers and wrong
    lengths are judged without a time too. An identifier that was learnt is known. Frames are worked
    out once and persisted (memory, then disk) for the rules that share them.
    """
    keys = ["trace", "session_index", "channel", "can_id"]
    line = Timeline(tuple(keys), ORDER, SLICE)
    frames = trace_frames(records).persist()
    begins = frames.groupBy("trace", "session_index").agg(F.min("ts_us").alias("_begin"))  # one row a session
    timed = frames.join(begins, ["trace", "session_index"]).withColumn("_learning", F.col("ts_us") < F.col("_begin") + learn_us)
    named = timed.filter("_learning").withColumn("_key", F.struct(*keys))
    learnt = profiles.latched_profile(named, min_intervals, key="_key").filter("period_us is not null").select("_key.*", "period_us")
    defined = messages.select(F.col("can_id").alias("_defined"), "data_length").dropDuplicates(["_defined"])
    known = frames.join(defined, F.col("can_id") == F.col("_defined"), "left").join(learnt, keys, "left")
    tested = timed.filter("not _learning and dt_us is not null").join(learnt, keys)
    stats = traces.bus_stats(timed_records(records)).withColumn("ts_us", F.col("ts64"))
    channel = Timeline(("trace", "session_index", "channel"), ORDER, SLICE)
    place = ["trace", *ORDER, "session_index", "channel", "ts_us"]
    parts = [
        ("unknown_id", protocol.rearmed_onsets(known, line, F.col("_defined").isNull() & F.col("period_us").isNull(), rearm_us).withColumn("measured", F.col("can_id").cast("double"))),
        ("dlc_mismatch", line.onsets(known.filter("_defined is not null"), F.col("dlc") != F.col("data_length")).withColumns({"measured": F.col("dlc").cast("double"), "expected": F.col("data_length").cast("double")})),
        ("controller_counter_increase", protocol.counter_increases(stats, channel, ERRORS, place).withColumns({"measured": F.col("increment").cast("double"), "expected": F.lit(0.0)})),
        ("device_frame_loss", protocol.frame_losses(stats, channel, LOSSES, "ring_dropped", "last_ring_drop_id", place).withColumns({"can_id": F.col("frame_id").cast("int"), "expected": F.lit(0.0)})),
        ("controller_state_change", protocol.state_changes(stats, channel, "state_name").select(*place)),
        ("period_violation", line.onsets(tested, rules.period_bad(F.col("dt_us"), F.col("period_us"), tolerance)).withColumns({"measured": F.col("dt_us").cast("double"), "expected": F.col("period_us")})),
        ("burst", rules.bursts(tested, line, F.col("dt_us") < F.col("period_us") * burst, burst_frames).withColumns({"measured": F.col("dt_us").cast("double"), "expected": F.col("period_us")})),
    ]
    columns = [*place, "can_id", "measured", "expected"]
    return rules.union_events(parts, columns)
