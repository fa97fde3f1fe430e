"""Binary records, definitions and text logs against hand-made and brute-force values."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from busloom.functions.bits import unsigned_le
from busloom.sources import dbc, json_files, textlog, traces


def frame(seq, can_id, data, ts32, channel=1):
    return traces.encode(1, seq, struct.pack("<HI", can_id | len(data) << 11 | (channel - 1) << 15, ts32) + data)


@pytest.mark.parametrize("n", [0, 1, 2, 253, 254, 255, 508, 509, 600])
def test_stuffing_round_trip(n):
    rng = random.Random(n)
    for zeros in (0.0, 0.02, 0.5, 1.0):
        data = bytes(0 if rng.random() < zeros else rng.randrange(1, 256) for _ in range(n))
        out = traces.stuff(data)
        assert out.endswith(b"\x00") and b"\x00" not in out[:-1] and traces.unstuff(out[:-1]) == data


def test_known_checks():
    assert traces.crc8(b"123456789") == 0xF4  # the catalogue value of this polynomial
    assert traces.unstuff(b"\x05ab") is None
    piece = frame(7, 0x123, b"\x01\x02", 99)[:-1]
    for bit in range(8 * len(piece)):
        broken = bytearray(piece)
        broken[bit // 8] ^= 1 << bit % 8
        assert traces.status_of(bytes(broken))[0] != "ok" or broken == piece
    assert traces.status_of(b"")[0] == "empty" and traces.status_of(b"\x01" * 132)[0] == "overflow"


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("trace") / "t.canbin")
    stats = struct.pack("<BQ", 2, 5_000) + struct.pack("<23I", *range(100, 123)) + bytes([1, 2, 3, 4, 5, 2])
    parts = [
        traces.encode(3, 0, struct.pack("<BBHQIIIIIBBBBBBB", 1, 5, 128, 1000, 500000, 250000, 1, 2, 2000000, 1, 26, 9, 20, 12, 0, 1)),
        traces.encode(2, 1, struct.pack("<Q", 0xFFFFFFF0)), frame(2, 0x321, b"\x00\x0a\x0d\xff", 0x20), frame(3, 0x7FF, b"", 5, 2),
        traces.encode(4, 4, struct.pack("<BBBHIIQ", 1, 4, 3, 0xFFFF, 9, 2, 77)), traces.encode(5, 5, stats),
        traces.encode(6, 6, struct.pack("<QIIIIIIIHHHHB", 9, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 6)), traces.encode(7, 7, struct.pack("<BBIQ", 0, 3, 70000, 8)),
        traces.encode(0x20, 8, b"abc"), traces.encode(2, 9, b"\x01"), b"\x03\x09\x00", b"\x02\x01\x01\x01\x00", frame(10, 1, b"\x00" * 8, 1)[:-1] + b"\x01\x00",
    ]
    with open(path, "wb") as f:
        f.write(b"".join(parts))
    return traces.deframe(traces.read_trace(spark, path)).cache()


def test_records_decode(records):
    f = {r.seq: r for r in traces.frames(records).collect()}
    assert sorted(f) == [2, 3]
    assert (f[2].channel, f[2].can_id, f[2].dlc, f[2].ts32, bytes(f[2].data)) == (1, 0x321, 4, 0x20, b"\x00\x0a\x0d\xff")
    assert (f[3].channel, f[3].can_id, f[3].dlc, bytes(f[3].data)) == (2, 0x7FF, 0, b"")
    assert [r.ts64 for r in traces.time_syncs(records).collect()] == [0xFFFFFFF0]  # the short one is no record
    s = traces.sessions(records).first()
    assert (s.rtc, s.rtc_valid, s.measurement_mode, s.usb_logging, s.stream_enabled, s.can2_bitrate) == ("2026-09-20 12:00:01", True, True, False, True, 250000)
    e = traces.events(records).first()
    assert (e.reason_name, e.state_name, e.frame_id, e.suppressed, e.ts64) == ("ring_drop", "bus_off", None, 2, 77)
    b = traces.bus_stats(records).first()
    assert (b.channel, b.ts64, b.rx_frames, b.last_ring_drop_id, b.max_tec, b.state_name) == (2, 5000, 100, 122, 5, "passive")
    lg = traces.logger_stats(records).first()
    assert (lg.loop_max_us, lg.tx_buffer_capacity, lg.usb_logging, lg.stream_enabled, lg.measurement_mode) == (7, 11, True, True, False)
    a = traces.acks(records).first()
    assert (a.accepted, a.command, a.value, a.ts64) == (True, 3, 70000, 8)


def test_decoder_counters(records):
    got = {r.status: r.records for r in traces.decoder_counters(records).collect()}
    assert got == {"ok": 10, "unknown": 1, "short": 1, "cobs": 1}  # a zero after the check byte passes the check, not the length


def test_envelope(spark, tmp_path):
    body = frame(1, 5, b"x", 1)
    header = b'{"checksum": "abc"}'
    (tmp_path / "a.canbin").write_bytes(b"CANTRACE\\x01" + struct.pack("<I", len(header)) + header + body)
    (tmp_path / "b.canbin").write_bytes(body)
    got = {r.trace[-8:]: (r.header, bytes(r.body)) for r in traces.read_envelopes(spark, str(tmp_path)).collect()}
    assert got == {"a.canbin": (header.decode(), body), "b.canbin": (None, body)}


DBC = """VERSION ""

BU_: A B
BO_ 3221225472 VECTOR__INDEPENDENT_SIG_MSG: 0 Vector__XXX
 SG_ Loose : 0|1@1+ (1,0) [0|255] "" Vector__XXX

BO_ 257 ENGINE: 8 A
 SG_ Speed : 7|16@0+ (0.5,-10) [0|100] "km/h" B
 SG_ Temp : 16|8@1- (1,0) [-40|120] "C" B
 SG_ Wide : 0|64@1+ (1,0) [0|0] "" B
 SG_ Odd : 12|11@0- (1,0) [-100|100] "" B

BO_ 258 SHORT: 2 A
 SG_ Late m1 : 8|12@1+ (2,1) [0|5000] "" B
"""


def test_definitions_and_signals(spark, tmp_path):
    (tmp_path / "net.dbc").write_text(DBC)
    messages, signals = dbc.read_dbc(spark, str(tmp_path / "net.dbc"))
    assert {(r.can_id, r.message, r.data_length) for r in messages.collect()} == {(dbc.INDEPENDENT, "VECTOR__INDEPENDENT_SIG_MSG", 0), (257, "ENGINE", 8), (258, "SHORT", 2)}
    rows = {r.signal: r for r in signals.collect()}
    assert (rows["Speed"].can_id, rows["Speed"].big_endian, rows["Speed"].scale, rows["Speed"].unit) == (257, True, 0.5, "km/h")
    assert rows["Wide"].minimum is None and rows["Late"].mux == "m1" and rows["Temp"].is_signed
    rng = random.Random(3)
    payloads = [bytes(rng.randrange(256) for _ in range(8)) for _ in range(20)] + [b"\xff" * 8, b"\x01"]
    frames = spark.createDataFrame([(k, 257, bytearray(p)) for k, p in enumerate(payloads)] + [(90, 258, bytearray(b"\x00\x00"))], "k int, can_id long, data binary")

    def expected(p, start, length, big, signed, scale, offset):
        at, bits = start, []
        for _ in range(length):
            bits.append(at)
            at = (at + 15 if at % 8 == 0 else at - 1) if big else at + 1
        if max(bits) >= 8 * len(p):
            return None
        value = 0
        for b in bits if big else reversed(bits):
            value = value << 1 | (p[b // 8] >> b % 8 & 1)
        if signed and value >> (length - 1):
            value -= 1 << length
        return float(value) * scale + offset

    got = {(r.k, r.signal): r.value for r in dbc.decode_signals(frames, signals).collect()}
    for k, p in enumerate(payloads):
        assert got[(k, "Speed")] == expected(p, 7, 16, True, False, 0.5, -10)
        assert got[(k, "Temp")] == expected(p, 16, 8, False, True, 1, 0)
        assert got[(k, "Wide")] == expected(p, 0, 64, False, False, 1, 0)
        assert got[(k, "Odd")] == expected(p, 12, 11, True, True, 1, 0)
    assert got[(90, "Late")] is None


def test_text_log(spark, tmp_path):
    lines = ["00000000100 0123 0A0B 1", "00000000200 7FF 0 2", "00000000300 0800 00 1", "00000000400 12 ABC 1", "#BUS t=500 bus=1 state=2 state=3 x", "#BUS bus=1", "# t=4", "junk", "00000000600 0001 00 0"]
    (tmp_path / "log_20260920120001.log").write_bytes("\r\n".join(lines).encode())
    log = textlog.read_log(spark, str(tmp_path))
    got = {r.time_us: r for r in textlog.frames(log).collect()}
    assert {k: (r.can_id, r.dlc, bytes(r.data), r.bus) for k, r in got.items()} == {100: (0x123, 2, b"\x0b\x0a", 1), 200: (0x7FF, 0, b"", 2)}
    assert str(got[100].file_time) == "2026-09-20 12:00:01"
    assert bytes(textlog.frames(log, reverse=False).filter("time_us = 100").first().data) == b"\x0a\x0b"
    d = textlog.diagnostics(log).collect()
    assert [(r.kind, r.time_us, r.fields) for r in d] == [("BUS", 500, {"t": "500", "bus": "1", "state": "3"})]
    assert [r.value for r in textlog.to_log_line(textlog.frames(log, reverse=False)).orderBy("value").collect()] == ["00000000100 0123 0A0B 1", "00000000200 07FF 0 2"]
    asc = [r.value for r in textlog.asc_lines(textlog.frames(log), "Sun Sep 20 2026").orderBy("line_no").collect()]
    assert asc[3].startswith("Begin") and asc[-1].startswith("End") and "123" in asc[4] and asc[4].endswith("d 2 0B 0A") and asc[5].endswith("d 0")


def test_json_sources(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"format": "can-live-baseline-v1", "ready": true, "channel": 1, "min_intervals": 5, "messages": {"12": {"frame_count": 9, "interval_count": 8, "period_us": 100.5, "std_us": 0}}}')
    r = json_files.latched_profiles(spark, str(tmp_path / "p.json")).first()
    assert (r.can_id, r.frame_count, r.period_us) == (12, 9, 100.5)
    (tmp_path / "t.json").write_text('{"session_id": "s", "seed": 42, "episodes": [{"type": "burst", "start": 1.5, "end": 2.5, "can_id": 7, "parameters": {"x": 1}}]}')
    e = json_files.truth_episodes(spark, str(tmp_path / "t.json")).first()
    assert (e.episode, e.type, e.start, e.can_id, e.parameters) == (0, "burst", 1.5, 7, {"x": "1"})


def test_little_endian_numbers(spark):
    row = spark.range(1).select(unsigned_le(F.lit(b"\x01\x02\x00\xff"), 1, 3).alias("n")).first()
    assert row.n == 0xFF0002
