"""Checksums, content fingerprints and packed dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes at either end of a file that its fingerprint covers.
FINGERPRINT_BYTES = 65536


def crc32_hex(data: Column) -> Column:
    return F.lower(F.hex(F.crc32(data)))


def fingerprint(content: Column) -> Column:
    """size:crc of the head:crc of the tail. Bytes between the first and the last 64 KB of a larger file don't count."""
    n = F.octet_length(content)
    start = F.greatest(F.lit(FINGERPRINT_BYTES), n - FINGERPRINT_BYTES)
    tail = F.when(n > FINGERPRINT_BYTES, F.substring(content, start + 1, n)).otherwise(F.lit(b""))
    return F.concat_ws(":", n.cast("string"), crc32_hex(F.substring(content, F.lit(1), F.lit(FINGERPRINT_BYTES))), crc32_hex(tail))


def source_key(fingerprints: Column) -> Column:
    """One key for a set of files, whatever their order."""
    return F.array_join(F.sort_array(fingerprints), ";")


def dos_datetime(t: Column) -> Column:
    """date and time as archives pack them: years from 1980, even seconds."""
    year = F.greatest(F.year(t) - 1980, F.lit(0))
    date = F.shiftleft(year, 9).bitwiseOR(F.shiftleft(F.month(t), 5)).bitwiseOR(F.dayofmonth(t))
    time = F.shiftleft(F.hour(t), 11).bitwiseOR(F.shiftleft(F.minute(t), 5)).bitwiseOR(F.floor(F.second(t) / 2).cast("int"))
    return F.struct(date.alias("date"), time.alias("time"))
