"""Message definitions: a DBC text file as two dimension tables, and signal decoding with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

_BO = r"^BO_ (\d+) (\w+) *: *(\d+) (\w+)"
_SG = r'^ *SG_ (\w+)( M| m\d+M?)? *: *(\d+)\|(\d+)@([01])([+-]) *\(([^,]+),([^)]+)\) *\[([^|]*)\|([^\]]*)\] *"([^"]*)"'
_VAL = r"^VAL_ (\d+) (\w+) (.*);"
_PAIR = r'(-?\d+) "([^"]*)"'
_BA = r'^BA_ "([^"]+)" BO_ (\d+) (.*?) *;'
INDEPENDENT = 3221225472  # the pseudo-message of signals without a message


def read_dbc(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(messages, signals). A definition file is one small document: it is read whole, so that
    a signal can be told its message, and both tables have a row per definition."""
    text = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("dbc"), F.split("value", "\r?\n").alias("line"))
    lines = text.select("dbc", F.posexplode("line").alias("no", "line"))
    head = F.when(F.col("line").rlike(_BO), F.regexp_extract("line", _BO, 1).cast("long"))
    above = W.partitionBy("dbc").orderBy("no").rowsBetween(W.unboundedPreceding, 0)  # a file's few thousand lines
    lines = lines.withColumn("can_id", F.last(head, ignorenulls=True).over(above))
    part = lambda rx, k: F.regexp_extract("line", rx, k)
    heads = lines.filter(F.col("line").rlike(_BO)).select(
        "dbc", "can_id", part(_BO, 2).alias("message"), part(_BO, 3).cast("int").alias("data_length")
    )
    signals = lines.filter(F.col("line").rlike(_SG)).select(
        "dbc", "can_id", part(_SG, 1).alias("signal"), F.nullif(F.trim(part(_SG, 2)), F.lit("")).alias("mux"), part(_SG, 3).cast("int").alias("start_bit"),
        part(_SG, 4).cast("int").alias("bit_length"), (part(_SG, 5) == "0").alias("big_endian"), (part(_SG, 6) == "-").alias("is_signed"),
        part(_SG, 7).cast("double").alias("scale"), part(_SG, 8).cast("double").alias("offset"),
        part(_SG, 9).cast("double").alias("minimum"), part(_SG, 10).cast("double").alias("maximum"), part(_SG, 11).alias("unit"),
    )
    bounded = F.col("minimum") != F.col("maximum")  # equal limits mean none
    signals = signals.withColumns({c: F.when(bounded, F.col(c)) for c in ("minimum", "maximum")})
    return heads, signals


def value_names(spark: SparkSession, path: str) -> DataFrame:
    """Named values of signals (VAL_ lines): can_id, signal, value, name."""
    lines = spark.read.text(path).filter(F.col("value").rlike(_VAL)).select(F.regexp_extract("value", _VAL, 1).cast("long").alias("can_id"), F.regexp_extract("value", _VAL, 2).alias("signal"), F.regexp_extract("value", _VAL, 3).alias("_rest"))
    pairs = F.explode(F.regexp_extract_all("_rest", F.lit(_PAIR), F.lit(0))).alias("_pair")
    rows = lines.select("can_id", "signal", pairs)
    return rows.select("can_id", "signal", F.regexp_extract("_pair", _PAIR, 1).cast("long").alias("value"), F.regexp_extract("_pair", _PAIR, 2).alias("name"))


def message_attributes(spark: SparkSession, path: str) -> DataFrame:
    """Attributes of messages (BA_ lines), such as cycle times: can_id, attribute, value (text)."""
    lines = spark.read.text(path).filter(F.col("value").rlike(_BA))
    part = lambda k: F.regexp_extract("value", _BA, k)
    return lines.select(part(2).cast("long").alias("can_id"), part(1).alias("attribute"), F.btrim(part(3), F.lit('"')).alias("value"))


def by_bus(definitions: DataFrame) -> DataFrame:
    """Adds ``channel``: the definition file's place, from 1, among all by file name without case. The
    number of files is that of a device's buses, a handful; only their names are ranked."""
    name = F.lower(F.element_at(F.split("dbc", "/"), -1))
    files = definitions.select("dbc").distinct().withColumn("channel", F.row_number().over(W.orderBy(name, "dbc")))
    return definitions.join(F.broadcast(files), "dbc")


def _words(data: Column) -> tuple[Column, Column]:
    """The data, filled up to eight bytes, as one 64-bit number: first byte on top, and at the bottom."""
    text = F.rpad(F.hex(data), 16, "0")
    back = F.concat(*[F.substring(text, k, 2) for k in range(15, 0, -2)])
    return F.conv(text, 16, -10).cast("long"), F.conv(back, 16, -10).cast("long")


def _raw(prefix: str = "") -> str:
    """SQL of a signal's raw bits, in the low end of a long: one shift and one mask of the frame's word.
    With bits numbered from the first byte's top, those of a big-endian signal are consecutive."""
    start, length = f"{prefix}start_bit", f"{prefix}bit_length"
    top = f"({start} - {start} % 8 + 7 - {start} % 8)"
    shifted = f"if({prefix}big_endian, shiftrightunsigned(_big, int(64 - {top} - {length})), shiftrightunsigned(_little, int({start})))"
    return f"({shifted} & shiftrightunsigned(-1L, int(64 - {length})))"


def decode_signals(frames: DataFrame, signals: DataFrame) -> DataFrame:
    """One row per frame and signal of its message, with the physical ``value``.

    Signals that don't fit into the frame's data have a null value. Multiplexed signals (``m<k>``) have
    a row only in frames whose multiplexor (``M``) holds k; nested multiplexing isn't resolved. The definition table has a
    row per signal of one network (a checked few thousand), so it is broadcast; frames stay put.
    """
    if (n := signals.count()) > 100_000:
        raise ValueError(f"{n} signal definitions are more than the supported 100,000")
    layout = ["start_bit", "bit_length", "big_endian"]
    selector = signals.filter("mux = 'M'").select(F.col("can_id").alias("_id"), *[F.col(c).alias(f"_m_{c}") for c in layout])
    dims = signals.drop("dbc").join(selector, F.col("can_id") == F.col("_id"), "left").drop("_id")
    big, little = _words(F.col("data"))
    rows = frames.withColumns({"_big": big, "_little": little}).join(F.broadcast(dims), "can_id")
    branch = F.regexp_extract("mux", r"^m(\d+)", 1)
    chosen = F.expr(_raw("_m_")) == F.when(branch != "", branch).cast("long")
    rows = rows.filter(F.coalesce(~F.col("mux").startswith("m") | F.col("_m_start_bit").isNull() | chosen, F.lit(True)))
    last = F.when(F.col("big_endian"), F.col("start_bit") - F.col("start_bit") % 8 + 7 - F.col("start_bit") % 8).otherwise(F.col("start_bit")) + F.col("bit_length")
    signed = F.expr(f"shiftright(shiftleft({_raw()}, int(64 - bit_length)), int(64 - bit_length))")
    plain = F.expr(_raw())
    unsigned = F.when(plain >= 0, plain.cast("decimal(20,0)")).otherwise(plain.cast("decimal(20,0)") + F.lit(str(2**64)).cast("decimal(20,0)"))
    number = F.when(F.col("is_signed"), signed.cast("double")).otherwise(unsigned.cast("double"))
    rows = rows.withColumn("value", F.when(last <= 8 * F.length("data"), number * F.col("scale") + F.col("offset")))
    return rows.drop("_big", "_little", *[f"_m_{c}" for c in layout])


def encode_signals(values: DataFrame, signals: DataFrame, keys: list[str]) -> DataFrame:
    """One row per ``keys`` and can_id with the 64-bit ``data`` that holds the given physical values
    (``values``: keys, can_id, signal, value). A value that isn't a multiple of the scale (to 1e-9) or
    doesn't fit the bits is an error. A message's signals don't overlap, so their bits add up."""
    dims = signals.select("can_id", "signal", "start_bit", "bit_length", "big_endian", "is_signed", "scale", "offset")
    rows = values.join(dims, ["can_id", "signal"])
    exact = (F.col("value") - F.col("offset")) / F.col("scale")
    near = F.abs(exact - F.round(exact)) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(exact))
    span = F.pow(F.lit(2.0), F.col("bit_length"))
    low, high = F.when(F.col("is_signed"), -span / 2).otherwise(0.0), F.when(F.col("is_signed"), span / 2 - 1).otherwise(span - 1)
    fits = near & (F.round(exact) >= low) & (F.round(exact) <= high)
    whole = F.when(fits, F.round(exact)).otherwise(F.raise_error(F.concat(F.lit("a value doesn't fit its signal "), "signal")).cast("double"))
    whole = F.when(whole >= 2.0**63, whole - 2.0**64).otherwise(whole).cast("long")
    top = "(start_bit - start_bit % 8 + 7 - start_bit % 8)"
    rows = rows.withColumn("_raw", whole).withColumn("_raw", F.expr("_raw & shiftrightunsigned(-1L, int(64 - bit_length))"))
    big = F.expr(f"if(big_endian, shiftleft(_raw, int(64 - {top} - bit_length)), 0L)")
    little = F.expr("if(big_endian, 0L, shiftleft(_raw, int(start_bit)))")
    packed = rows.groupBy(*keys, "can_id").agg(F.bit_or(big).alias("_big"), F.bit_or(little).alias("_little"))
    text = F.lpad(F.hex("_little"), 16, "0")
    back = F.conv(F.concat(*[F.substring(text, k, 2) for k in range(15, 0, -2)]), 16, -10).cast("long")
    return packed.select(*keys, "can_id", F.unhex(F.lpad(F.hex(F.col("_big").bitwiseOR(back)), 16, "0")).alias("data"))
