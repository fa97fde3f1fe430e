"""Trace bytes to alarms, batch de-framing, multiplexed signals, sinks and campaign operators."""

import json
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from busloom.operators import campaign, protocol
from busloom.operators.timeline import Timeline
from busloom.plans import alarms
from busloom.sources import dbc, sinks, traces


def frame(seq, can_id, data, ts32, channel=1):
    return traces.encode(1, seq, struct.pack("<HI", can_id | len(data) << 11 | (channel - 1) << 15, ts32) + data)


def test_batch_deframing_equals_single():
    rng = random.Random(5)
    pieces = [b"", None, b"\x01" * 132, b"\x05ab", b"\x01" * 131]
    for k in range(600):
        body = frame(k, rng.randrange(2048), bytes(rng.choice([0, 1, 255]) for _ in range(rng.randrange(9))), rng.randrange(2**32))[:-1]
        if k % 3 == 0:
            body = bytearray(body)
            body[rng.randrange(len(body))] = rng.randrange(1, 256)
        pieces.append(bytes(body))
    pieces += [traces.encode(5, 1, bytes(rng.randrange(256) for _ in range(107)))[:-1], traces.encode(0x20, 1, b"\x00" * 90)[:-1]]
    for at in (0, 3):
        status, body, size = traces.unstuff_batch(pa.array(pieces, pa.binary()).slice(at))
        for k, piece in enumerate(pieces[at:]):
            want, record = traces.status_of(piece or b"")
            assert traces.STATUSES[status[k]] == want
            assert record is None or bytes(body[k, : size[k] - 1]) == record
    assert len(traces.unstuff_batch(pa.array([], pa.binary()))[0]) == 0


@pytest.fixture(scope="module")
def trace(spark, tmp_path_factory):
    """Two learnt identifiers at 100 ms, from 2 s on a gap, a burst, a wrong length, an unknown id; statistics that grow."""
    path = str(tmp_path_factory.mktemp("alarm") / "t.canbin")
    events = [(k * 100_000 + p, i, b"\x00" * 8) for i, p in ((0x10, 0), (0x20, 10)) for k in range(40) if not (i == 0x10 and 25 <= k < 28)]
    events += [(3_200_000 + k * 10_000 + 5, 0x20, b"\x00" * 8) for k in range(1, 6)]
    events += [(3_500_050, 0x20, b"\x00" * 7), (2_100_000, 0x99, b"a"), (2_200_000, 0x99, b"b"), (3_900_001, 0x99, b"c")]
    out, seq = [traces.encode(3, 0, struct.pack("<BBHQIIIIIBBBBBBB", 1, 5, 128, 0, 500000, 250000, 1, 2, 2000000, 1, 26, 9, 20, 12, 0, 1)), traces.encode(2, 1, struct.pack("<Q", 0))], 2
    for ts, can_id, data in sorted(events):
        out.append(frame(seq, can_id, data, ts))
        seq += 1
    for ts, grown in ((3_950_000, 0), (3_960_000, 3)):
        counters = [100] * 23
        counters[traces.COUNTERS.index("crc_errors")] += grown
        counters[traces.COUNTERS.index("ring_dropped")] += grown
        counters[traces.COUNTERS.index("last_ring_drop_id")] = 0x20
        out.append(traces.encode(5, seq, struct.pack("<BQ", 1, ts) + struct.pack("<23I", *counters) + bytes([0, 0, 0, 0, 0, 2 if grown else 0])))
        seq += 1
    with open(path, "wb") as f:
        f.write(b"".join(out))
    return traces.deframe(traces.read_trace(spark, path))


def test_bytes_to_alarms(spark, trace):
    messages = spark.createDataFrame([(0x10, 8), (0x20, 8)], "can_id int, data_length int")
    got = alarms.trace_alarms(trace, messages, 2_000_000, 5, 0.3, 0.5, 3).collect()
    kinds = {}
    for r in sorted(got, key=lambda r: (r.block, r.line)):
        kinds.setdefault(r.type, []).append((r.can_id, r.ts_us))
    assert kinds["unknown_id"] == [(0x99, 2_100_000), (0x99, 3_900_001)]  # armed again after a second of silence
    assert kinds["dlc_mismatch"] == [(0x20, 3_500_050)]
    assert kinds["controller_counter_increase"] == [(None, 3_960_000)] and kinds["device_frame_loss"] == [(0x20, 3_960_000)]
    assert kinds["controller_state_change"] == [(None, 3_960_000)]
    assert (0x10, 2_800_000) in kinds["period_violation"] and [i for i, _ in kinds["burst"]] == [0x20]
    assert {r.measured for r in got if r.type == "controller_counter_increase"} == {3.0}


def test_order_of_records(trace):
    rows = alarms.trace_frames(trace).orderBy("block", "line").collect()
    assert [r.seq for r in rows] == sorted(r.seq for r in rows) and all(r.session_index == 1 for r in rows)


DBC = """BO_ 300 MUX: 8 A
 SG_ Sel M : 0|8@1+ (1,0) [0|255] "" B
 SG_ A m0 : 8|8@1+ (1,0) [0|255] "" B
 SG_ B m1 : 15|16@0- (0.5,0) [-100|100] "" B
BA_ "GenMsgCycleTime" BO_ 300 100;
VAL_ 300 Sel 0 "zero" 1 "one" ;
"""


def test_multiplexed_signals_names_and_round_trip(spark, tmp_path):
    (tmp_path / "B.dbc").write_text(DBC)
    (tmp_path / "a.dbc").write_text("BO_ 5 X: 8 A\n")
    messages, signals = dbc.read_dbc(spark, str(tmp_path))
    assert {(r.can_id, r.channel) for r in dbc.by_bus(messages).collect()} == {(5, 1), (300, 2)}
    frames = spark.createDataFrame([(0, 300, bytearray(b"\x00\x07\x00" + b"\x00" * 5)), (1, 300, bytearray(b"\x01\xff\xfe" + b"\x00" * 5)), (2, 300, bytearray(b"\x09" + b"\x01" * 7))], "k int, can_id long, data binary")
    got = {(r.k, r.signal): r.value for r in dbc.decode_signals(frames, signals).collect()}
    assert got == {(0, "Sel"): 0.0, (0, "A"): 7.0, (1, "Sel"): 1.0, (1, "B"): -1.0, (2, "Sel"): 9.0}
    values = spark.createDataFrame([(0, 300, "Sel", 1.0), (0, 300, "B", -1.0), (1, 300, "Sel", 0.0), (1, 300, "A", 255.0)], "k int, can_id long, signal string, value double")
    made = {r.k: bytes(r.data) for r in dbc.encode_signals(values, signals, ["k"]).collect()}
    assert made == {0: b"\x01\xff\xfe" + b"\x00" * 5, 1: b"\x00\xff" + b"\x00" * 6}
    with pytest.raises(Exception, match="doesn't fit"):
        dbc.encode_signals(values.withColumn("value", F.col("value") + 300), signals, ["k"]).collect()
    assert {(r.value, r.name) for r in dbc.value_names(spark, str(tmp_path / "B.dbc")).collect()} == {(0, "zero"), (1, "one")}
    assert [tuple(r) for r in dbc.message_attributes(spark, str(tmp_path / "B.dbc")).collect()] == [(300, "GenMsgCycleTime", "100")]


def test_sinks(spark, tmp_path, trace):
    rows = spark.createDataFrame([(7, 100.5, 3)], "can_id long, period_us double, frame_count long")
    sinks.write_profile(rows, str(tmp_path / "p"), "can_id", {"period_us": ("us", "mean time between frames")})
    assert [tuple(r) for r in sinks.read_profile(spark, str(tmp_path / "p"), "can_id", {"period_us": "double", "frame_count": "bigint"}).collect()] == [(7, 100.5, 3)]
    other = spark.createDataFrame([(8, {"a": 1})], "can_id long, extra map<string,int>")
    sinks.write_union_csv([rows, other], str(tmp_path / "c"))
    back = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert back.columns == ["can_id", "period_us", "frame_count", "extra"] and {r.extra for r in back.collect()} == {None, '{"a":1}'}
    events = spark.createDataFrame([("burst",), ("burst",), ("unknown_id",)], "type string")
    report = sinks.session_report(events, alarms.trace_frames(trace), traces.decoder_counters(trace))
    sinks.write_report(report, str(tmp_path / "r"))
    read = json.loads(spark.read.text(str(tmp_path / "r")).first().value)
    assert read["alarms"] == {"burst": 2, "unknown_id": 1} and read["identifiers"] == 3 and read["decoder"]["ok"] > 80
    (tmp_path / "x.dbc").write_bytes(b"a\r\nb\n")
    (tmp_path / "y.dbc").write_bytes(b"a\nb\n")
    assert len({r.sha256 for r in sinks.file_identities(spark, str(tmp_path / "*.dbc"), text=True).collect()}) == 1
    assert len({r.sha256 for r in sinks.file_identities(spark, str(tmp_path / "*.dbc")).collect()}) == 2
    truth = spark.createDataFrame([("s", 1, 0, "burst"), ("s", 1, 1, "delay")], "session_id string, seed long, episode int, type string")
    sinks.write_truth(truth, str(tmp_path / "t"))
    assert [e["type"] for e in json.loads(spark.read.text(str(tmp_path / "t")).first().value)["episodes"]] == ["burst", "delay"]
    (tmp_path / "s.json").write_text('{"episodes": [{"type": "burst", "start": 1, "end": 2, "can_id": 5}]}')
    assert sinks.read_scenarios(spark, str(tmp_path / "s.json")).first().can_id == 5


def test_protocol_rules(spark):
    line = Timeline(("ch",), ("ord",), "0")
    stats = spark.createDataFrame([(0, 1, 5, 2**32 - 1, 9, "active"), (1, 1, 5, 1, 9, "warning"), (2, 1, 6, 1, 8, "warning"), (3, 1, 6, 1, 8, "active")], "ord long, ch int, e long, r long, id long, state string")
    assert [tuple(r) for r in protocol.counter_increases(stats, line, ["e", "r"], ["ord"]).orderBy("ord").collect()] == [(1, "r", 2), (2, "e", 1)]
    lost = [(r.ord, r.loss_increments, r.frame_id, r.frame_id_source) for r in protocol.frame_losses(stats, line, ["e", "r"], "r", "id", ["ord"]).orderBy("ord").collect()]
    assert lost == [(1, {"r": 2}, 9, "ram_buffer_rejection"), (2, {"e": 1}, None, "untrusted")]
    assert [r.ord for r in protocol.state_changes(stats, line, "state").collect()] == [1]


def test_silence_is_not_detected_by_interval_rules(spark):
    events = spark.createDataFrame([("period", 1, 150), ("missing", 1, 160), ("period", 2, 150), ("burst", 1, 220)], "type string, can_id int, ts_us long")
    episodes = spark.createDataFrame([(0, 100, 200, 1)], "episode int, start_us long, end_us long, episode_can_id int")
    r = campaign.episode_hits(events, episodes, 50, 55, {"tol": 0}, 100, ("period", "burst"), F.lit(True)).first()
    assert (r.new_onsets, r.delayed, r.core, r.latency_us, r.tol) == (1, 2, 0, 60, True)
