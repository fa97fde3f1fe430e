"""Column functions on integers and bytes: masks, little-endian numbers, bit-packed signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_names(mask: Column, names: dict[int, str]) -> Column:
    """Names of the set bits in order, joined by commas; unknown bits as one hex number."""
    rest = mask
    parts = []
    for bit, name in names.items():
        parts.append(F.when(mask.bitwiseAND(bit) > 0, F.lit(name)))
        rest = rest.bitwiseAND(~bit)
    parts.append(F.when(rest != 0, F.concat(F.lit("0x"), F.hex(rest))))
    return F.concat_ws(",", *parts)


def unsigned_le(data: Column, at: int, size: int) -> Column:
    """Unsigned little-endian number of 1 to 7 bytes (or 8 below 2**63) at a 0-based offset."""
    hexed = F.concat(*[F.hex(F.substring(data, at + size - i, 1)) for i in range(size)])
    return F.conv(hexed, 16, 10).cast("long")
