"""Binary record traces: de-framing, checks and typed decoding of delimited byte-stuffed records.

A trace is a stream of records, each stuffed so that it has no zero byte and closed by one. Spark's
text reader splits at that byte, so a huge trace is read in parallel and also as a stream.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the wire format: record types, sizes, limits, names.
TYPES = {1: "frame", 2: "time_sync", 3: "session", 4: "event", 5: "bus_stats", 6: "logger_stats", 7: "ack"}
SIZES = {2: 11, 3: 42, 4: 24, 5: 110, 6: 48, 7: 17}  # without the check byte
FRAME_BASE, LONGEST, SHORTEST, RESERVED = 9, 131, 4, 0x20
STATUSES = ["ok", "empty", "overflow", "cobs", "short", "crc", "unknown"]
REASONS = {
    0: "rx_read_error", 1: "extended_frame_rejected", 2: "remote_frame_rejected", 3: "invalid_dlc", 4: "ring_drop", 5: "fifo_full",
    6: "fifo_overrun", 7: "controller_error", 8: "state_change", 9: "tx_buffer_overflow", 10: "usb_log_boundary", 11: "extended_id_remapped",
}
STATES = {0: "active", 1: "warning", 2: "passive", 3: "bus_off"}
COUNTERS = [
    "rx_frames", "valid_frames", "buffered_frames", "payload_bytes", "rx_read_errors", "extended_frames", "remote_frames", "invalid_dlc",
    "fifo_full", "fifo_overrun", "ring_dropped", "warning_entries", "passive_entries", "bus_off_entries", "stuff_errors", "form_errors",
    "ack_errors", "bit_recessive_errors", "bit_dominant_errors", "crc_errors", "other_errors", "last_error_code", "last_ring_drop_id",
]
GAUGES = ["fifo_max_fill", "current_rec", "current_tec", "max_rec", "max_tec", "state"]
LOGGER = [
    ("ring_drop_total", 4), ("tx_records_sent", 4), ("tx_bytes_sent", 4), ("tx_records_dropped", 4), ("tx_bytes_dropped", 4), ("event_queue_dropped", 4),
    ("loop_max_us", 4), ("ring_peak", 2), ("ring_capacity", 2), ("tx_buffer_peak", 2), ("tx_buffer_capacity", 2), ("flags", 1),
]
SESSION = [
    ("proto_version", 1), ("flags", 1), ("max_record_len", 2), ("ts64", 8), ("can1_bitrate", 4), ("can2_bitrate", 4), ("can1_btr", 4), ("can2_btr", 4),
    ("uart_baudrate", 4), ("rtc_valid", 1), ("year", 1), ("month", 1), ("day", 1), ("hour", 1), ("minute", 1), ("second", 1),
]


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.int64)
    for _ in range(8):
        table = np.where(table & 0x80, (table << 1) ^ 0x07, table << 1) & 0xFF
    return table


_CRC = _crc_table()


def crc8(data: bytes) -> int:
    """CRC-8 with polynomial 0x07 and start 0."""
    value = 0
    for byte in data:
        value = int(_CRC[value ^ byte])
    return value


def unstuff(body: bytes) -> bytes | None:
    """The record's bytes from its stuffed form without the closing zero; None if it is broken.

    Each block starts with its length plus one; the block's end stands for a zero, but for
    blocks of 254 bytes and the last one.
    """
    blocks, at = [], 0
    while at < len(body):
        size = body[at]
        if size == 0 or at + size > len(body):
            return None
        blocks.append(body[at + 1 : at + size])
        at += size
        if size < 255 and at < len(body):
            blocks.append(b"\x00")
    return b"".join(blocks)


def stuff(record: bytes) -> bytes:
    """The stuffed form of a record and its closing zero (for fixtures)."""
    out = b""
    for k, part in enumerate(parts := record.split(b"\x00")):
        while len(part) >= 254:
            out += b"\xff" + part[:254]
            part = part[254:]
            if not part and k == len(parts) - 1:
                return out + b"\x00"
        out += bytes([len(part) + 1]) + part
    return out + b"\x00"


def status_of(raw: bytes) -> tuple[str, bytes | None]:
    """What became of one delimited piece: ok, empty, overflow, cobs, short, crc or unknown."""
    if not raw:
        return "empty", None
    if len(raw) > LONGEST:
        return "overflow", None
    body = unstuff(raw)
    if body is None:
        return "cobs", None
    if len(body) < SHORTEST:
        return "short", None
    if crc8(body[:-1]) != body[-1]:
        return "crc", None
    return ("ok" if body[0] in TYPES else "unknown"), body[:-1]


def unstuff_batch(raw: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``status_of`` for a whole column at once: status codes (places in ``STATUSES``), a matrix of record
    bytes and their lengths. One step per byte position, over all records of the batch together."""
    n = len(raw)
    start = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + n + 1].astype(np.int64)
    size = np.diff(start) * ~np.asarray(raw.is_null())
    flat = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] else np.zeros(0, np.uint8)
    length = np.where(size > LONGEST, 0, size)
    wide = np.zeros((n, LONGEST), np.uint8)
    cell = np.arange(LONGEST) < length[:, None]
    row, column = np.nonzero(cell)
    wide[row, column] = flat[start[row] + column]
    body, at, left = np.zeros((n, LONGEST), np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64)
    last, broken = np.full(n, 255), np.zeros(n, bool)
    for j in range(int(length.max(initial=0))):
        byte, live = wide[:, j].astype(np.int64), j < length
        code = live & (left == 0)
        at += code & (last < 255)  # the end of the block before stands for a zero
        broken |= code & ((byte == 0) | (j + byte > length))
        last, left = np.where(code, byte, last), np.where(code, byte - 1, left)
        data = np.flatnonzero(live & ~code)
        body[data, at[data]] = byte[data]
        at[data] += 1
        left[data] -= 1
    check = np.zeros(n, np.int64)
    for j in range(int(at.max(initial=0))):
        check = np.where(j < at - 1, _CRC[check ^ body[:, j]], check)
    wrong = check != body[np.arange(n), np.maximum(at - 1, 0)]
    unknown = ~np.isin(body[:, 0], list(TYPES))
    status = np.select([size == 0, size > LONGEST, broken, at < SHORTEST, wrong, unknown], range(1, 7), 0)
    return status, body, at


def read_trace(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """One row per delimited piece: ``trace`` (file), ``block`` (where the split that holds it begins),
    ``line`` and ``raw``. (block, line) is the order within a trace: a split is read by one task, from
    front to back. Streams have no ``line``: their order is that of arrival."""
    reader = (spark.readStream if streaming else spark.read).option("lineSep", "\u0000").format("text")
    columns = [F.col("_metadata.file_path").alias("trace"), F.col("_metadata.file_block_start").alias("block")]
    if not streaming:
        columns.append(F.monotonically_increasing_id().alias("line"))
    return reader.load(path).select(*columns, F.col("value").cast("binary").alias("raw"))


def read_envelopes(spark: SparkSession, path: str, magic: bytes = b"CANTRACE\\x01") -> DataFrame:
    """Traces in a checksum envelope (magic, length, JSON header): ``trace``, ``header``, ``body``.
    A file without the magic is its own body and has no header."""
    whole = spark.read.format("binaryFile").load(path)
    n = len(magic)
    has = F.substring("content", 1, n) == F.lit(magic)
    size = sum((F.conv(F.hex(F.substring("content", n + 1 + k, 1)), 16, 10).cast("long") * 256**k for k in range(4)), F.lit(0).cast("long"))
    header = F.when(has, F.decode(F.expr(f"substring(content, {n + 5}, int(_size))"), "UTF-8"))
    body = F.when(has, F.expr(f"substring(content, int({n + 5} + _size), length(content))")).otherwise(F.col("content"))
    return whole.withColumn("_size", F.when(has, size)).select(F.col("path").alias("trace"), header.alias("header"), body.alias("body"))


def deframe(pieces: DataFrame) -> DataFrame:
    """Adds ``status``, ``type``, ``seq`` and ``payload`` (after the sequence number; null unless
    the piece is a whole known record). Works on batches and streams; Arrow batches."""
    kept = [c for c in pieces.columns if c != "raw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw").cast(pa.binary())
            status, body, size = unstuff_batch(raw)
            good, n = status == 0, batch.num_rows
            place = np.arange(LONGEST)
            inside = (place >= 3) & (place < (size - 1)[:, None]) & good[:, None]
            ends = np.concatenate([[0], np.cumsum(inside.sum(axis=1))]).astype(np.int32)
            valid = pa.py_buffer(np.packbits(good, bitorder="little").tobytes())
            payload = pa.BinaryArray.from_buffers(pa.binary(), n, [valid, pa.py_buffer(ends.tobytes()), pa.py_buffer(body[inside].tobytes())])
            seq = body[:, 1].astype(np.int32) | body[:, 2].astype(np.int32) << 8
            columns = [batch.column(c) for c in kept] + [
                pa.array(STATUSES, pa.string()).take(pa.array(status)), pa.array(body[:, 0].astype(np.int32), mask=~good), pa.array(seq, mask=~good), payload,
                pc.fill_null(pc.binary_length(raw), 0).cast(pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "status", "type", "seq", "payload", "wire_bytes"])

    types = dict(pieces.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept)
    return pieces.select(*kept, "raw").mapInArrow(run, f"{schema}{', ' if kept else ''}status string, type int, seq int, payload binary, wire_bytes long")


def number(payload: Column, at: int, size: int) -> Column:
    """Unsigned little-endian number in ``payload`` at a 0-based offset (8 bytes: below 2**63)."""
    return F.conv(F.concat(*[F.hex(F.substring(payload, at + size - k, 1)) for k in range(size)]), 16, 10).cast("long")


def _fields(layout: list[tuple[str, int]], at: int = 0) -> dict[str, Column]:
    out = {}
    for name, size in layout:
        out[name] = number(F.col("payload"), at, size)
        at += size
    return out


def named(code: Column, names: dict[int, str]) -> Column:
    known = F.create_map(*[x for k, v in names.items() for x in (F.lit(k).cast("long"), F.lit(v))])
    return F.coalesce(known[code.cast("long")], F.concat(F.lit("unknown_"), code.cast("string")))


def _of(records: DataFrame, kind: int) -> DataFrame:
    return records.filter((F.col("status") == "ok") & (F.col("type") == kind) & (F.length("payload") == SIZES.get(kind, 0) - 3))


def frames(records: DataFrame) -> DataFrame:
    """Frame records with a valid length: channel, can_id, dlc, ts32, data. Native expressions."""
    head = number(F.col("payload"), 0, 2)
    rows = records.filter((F.col("status") == "ok") & (F.col("type") == 1) & (F.length("payload") >= FRAME_BASE - 3))
    rows = rows.withColumns({"channel": (head / 32768).cast("int") + 1, "can_id": head.bitwiseAND(0x7FF).cast("int"), "dlc": F.shiftright(head, 11).bitwiseAND(15).cast("int")})
    rows = rows.withColumns({"ts32": number(F.col("payload"), 2, 4), "data": F.expr("substring(payload, 7, 8)")})
    return rows.filter((F.col("dlc") <= 8) & (F.length("payload") == FRAME_BASE - 3 + F.col("dlc"))).drop("payload")


def time_syncs(records: DataFrame) -> DataFrame:
    return _of(records, 2).withColumn("ts64", number(F.col("payload"), 0, 8)).drop("payload")


def sessions(records: DataFrame) -> DataFrame:
    rows = _of(records, 3).withColumns(_fields(SESSION)).drop("payload")
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    rtc = F.concat(F.lit("20"), two("year"), F.lit("-"), two("month"), F.lit("-"), two("day"), F.lit(" "), two("hour"), F.lit(":"), two("minute"), F.lit(":"), two("second"))
    flag = lambda bit: F.col("flags").bitwiseAND(bit) > 0
    rows = rows.withColumns({"rtc": rtc, "rtc_valid": F.col("rtc_valid") > 0, "measurement_mode": flag(1), "usb_logging": flag(2), "stream_enabled": flag(4)})
    return rows.drop("year", "month", "day", "hour", "minute", "second")


def events(records: DataFrame) -> DataFrame:
    rows = _of(records, 4).withColumns(_fields([("channel", 1), ("reason", 1), ("state", 1), ("frame_id", 2), ("error_code", 4), ("suppressed", 4), ("ts64", 8)])).drop("payload")
    return rows.withColumns({"reason_name": named(F.col("reason"), REASONS), "state_name": named(F.col("state"), STATES), "frame_id": F.when(F.col("frame_id") != 0xFFFF, F.col("frame_id"))})


def bus_stats(records: DataFrame) -> DataFrame:
    layout = [("channel", 1), ("ts64", 8), *[(c, 4) for c in COUNTERS], *[(g, 1) for g in GAUGES]]
    return _of(records, 5).withColumns(_fields(layout)).withColumn("state_name", named(F.col("state"), STATES)).drop("payload")


def logger_stats(records: DataFrame) -> DataFrame:
    rows = _of(records, 6).withColumns(_fields([("ts64", 8), *LOGGER])).drop("payload")
    flag = lambda bit: F.col("flags").bitwiseAND(bit) > 0
    return rows.withColumns({"measurement_mode": flag(1), "usb_logging": flag(2), "stream_enabled": flag(4)})


def acks(records: DataFrame) -> DataFrame:
    rows = _of(records, 7).withColumns(_fields([("status_code", 1), ("command", 1), ("value", 4), ("ts64", 8)])).drop("payload")
    return rows.withColumn("accepted", F.col("status_code") == 0)


def decoder_counters(records: DataFrame) -> DataFrame:
    """Pieces and bytes by status."""
    return records.groupBy("status").agg(F.count("*").alias("records"), F.sum("wire_bytes").alias("bytes"))


def encode(kind: int, seq: int, payload: bytes) -> bytes:
    """A stuffed record (for fixtures and generators)."""
    body = struct.pack("<BH", kind, seq) + payload
    return stuff(body + bytes([crc8(body)]))
