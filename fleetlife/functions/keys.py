"""Days, ordinals and the packed (device, day) key.

A day is counted from 1970-01-01. An ordinal is a day counted from ``base`` (the first day of the fleet's history).
The packed key is only an interchange format: filters belong on the real ``device`` and ``day`` columns, which reach
the Parquet scan, while an expression over the packed key does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the packed key format: 13 bits of ordinal, ordinal 0 is 2012-01-01.
DAY_BITS = 13
BASE_DAY = 15340

MAX_ORDINAL = (1 << DAY_BITS) - 1


def epoch_day(date_text: Column) -> Column:
    """ISO date text to days since 1970-01-01; text that is no date gives null."""
    return F.unix_date(date_text.try_cast("date"))


def iso_date(day: Column) -> Column:
    """Days since 1970-01-01 to ``yyyy-MM-dd`` text."""
    return F.date_format(F.date_from_unix_date(day), "yyyy-MM-dd")


def day_to_ordinal(day: Column, base: int = BASE_DAY) -> Column:
    return day - F.lit(base)


def ordinal_to_day(ordinal: Column, base: int = BASE_DAY) -> Column:
    return ordinal + F.lit(base)


def ordinal_to_timestamp(ordinal: Column, base: int = BASE_DAY) -> Column:
    """Midnight of the ordinal's day, without a time zone."""
    return F.date_from_unix_date(ordinal_to_day(ordinal, base)).cast("timestamp_ntz")


def pack_key(device: Column, ordinal: Column) -> Column:
    """``device << 13 | ordinal`` as a long; null when the ordinal does not fit its bits."""
    packed = F.shiftleft(device.cast("bigint"), DAY_BITS).bitwiseOR(ordinal.cast("bigint"))
    return F.when(ordinal.between(0, MAX_ORDINAL), packed)


def unpack_device(key: Column) -> Column:
    return F.shiftright(key, DAY_BITS)


def unpack_ordinal(key: Column) -> Column:
    return key.bitwiseAND(F.lit(MAX_ORDINAL).cast("bigint")).cast("int")


def is_device(key: Column, device: Column, first: Column | None = None, last: Column | None = None) -> Column:
    """Range predicate "this key belongs to the device", optionally inside ``[first, last]`` ordinals."""
    low = F.lit(0) if first is None else first
    high = F.lit(MAX_ORDINAL) if last is None else last
    return key.between(pack_key(device, low), pack_key(device, high))
