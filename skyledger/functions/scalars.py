"""Tolerant parsing of cells, clocks and local times as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTES_A_DAY = 1440


def blank_to_null(raw: Column) -> Column:
    text = F.trim(raw)
    return F.when(text != "", text)


def parse_integer(raw: Column) -> Column:
    """A signed 64-bit integer from decimal text with a zero fraction, with or without an exponent; null for anything else."""
    return integer_of(blank_to_null(raw))


def integer_of(text: Column) -> Column:
    """parse_integer of a text that blank_to_null gave. Plain digits are cast; only other texts go by decimals, in a lambda, so that the code made for a cell stays small."""
    plain = text.rlike(r"^[+-]?[0-9]{1,18}(\.0*)?$")
    return F.when(plain, F.substring_index(text, ".", 1).try_cast("long")).when(text.isNotNull(), F.transform(F.array(text), _by_decimal)[0])


def _by_decimal(text: Column) -> Column:
    number = text.try_cast("decimal(38,18)")
    # the cast rounds what lies beyond 18 places
    whole = (number == F.floor(number)) & ~text.rlike(r"^[+-]?[0-9]*\.[0-9]*[1-9][0-9]*$") & text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(whole & number.between(F.lit("-9223372036854775808").cast("decimal(38,18)"), F.lit("9223372036854775807").cast("decimal(38,18)")), number.cast("long"))


def invalid_integer(raw: Column) -> Column:
    """True where a cell holds something that is no integer."""
    return blank_to_null(raw).isNotNull() & parse_integer(raw).isNull()


def parse_boolean(raw: Column) -> Column:
    n = parse_integer(raw)
    return F.when(n == 1, F.lit(True)).when(n == 0, F.lit(False))


def parse_date(raw: Column) -> Column:
    text = F.trim(raw)
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date"))


def clock_minutes(value: Column) -> Column:
    """Minute of the day of an HHMM number; 2400 is 0; null for impossible hours or minutes."""
    hour, minute = F.floor(value / 100).cast("int"), F.pmod(value, F.lit(100)).cast("int")
    return F.when(value == 2400, F.lit(0)).when((value < 0) | (hour > 23) | (minute > 59), F.lit(None)).otherwise(hour * 60 + minute).cast("int")


def normalize_column(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def archive_name(year: Column, month: Column) -> Column:
    return F.concat(F.lit("On_Time_Marketing_Carrier_On_Time_Performance_Beginning_January_2018_"), year, F.lit("_"), month, F.lit(".zip"))


def at_minute(day: Column, minute: Column) -> Column:
    """The instant of a UTC wall clock: independent of the session's time zone."""
    return F.timestamp_seconds(F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + minute.cast("long") * 60)


def add_minutes(value: Column, minutes: Column, limit: int = 10**9) -> Column:
    """value and minutes later; null if either is, or the minutes are absurd."""
    return F.when(F.abs(minutes) < limit, F.timestamp_micros(F.unix_micros(value) + minutes.cast("long") * 60_000_000))


def minutes_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(60_000_000)


def local_candidates(day: Column, minute: Column, zone: Column) -> Column:
    """The 0 (gap), 1 or 2 (fold) instants at which a zone's clocks show this date and minute, rising."""
    wall = at_minute(day, minute)
    guess = F.to_utc_timestamp(wall, zone)
    around = F.array(*[F.timestamp_micros(F.unix_micros(guess) + F.lit(m * 60_000_000)) for m in (-60, -30, 0, 30, 60)])
    # distinct and rising as they are made
    return F.filter(around, lambda c: F.from_utc_timestamp(c, zone) == wall)


def showing(wall: Column, guess: Column, zone: Column) -> Column:
    """local_candidates of a wall clock and its to_utc_timestamp, for columns: without a lambda, so that it is compiled."""
    near = [guess if m == 0 else F.timestamp_micros(F.unix_micros(guess) + F.lit(m * 60_000_000)) for m in (-60, -30, 0, 30, 60)]
    return F.concat(*[F.when(F.from_utc_timestamp(c, zone) == wall, F.array(c)).otherwise(F.array().cast("array<timestamp>")) for c in near])


def local_minute(value: Column, zone: Column) -> Column:
    local = F.from_utc_timestamp(value, zone)
    return F.pmod(F.floor(F.unix_micros(local) / 60_000_000), F.lit(MINUTES_A_DAY)).cast("int")


def clock_agrees(value: Column, minute: Column, zone: Column, tolerance: int = 0) -> Column:
    gap = F.abs(local_minute(value, zone) - minute)
    return F.least(gap, F.lit(MINUTES_A_DAY) - gap) <= tolerance


def weekday(day: Column) -> Column:
    """Monday is 0."""
    return F.weekday(day)


def bucket_of(minute: Column, hours: int = 6) -> Column:
    return F.floor(minute / (60 * hours)).cast("int")
