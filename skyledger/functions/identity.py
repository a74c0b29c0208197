"""Canonical identities and deterministic draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(value: Column) -> Column:
    """JSON of a string or null."""
    inner = F.to_json(F.array(value))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.substring(inner, F.lit(2), F.length(inner) - 2))


def json_array(*values: Column) -> Column:
    """Compact JSON array of strings (numbers as strings of digits are for json_number)."""
    return F.concat(F.lit("["), F.concat_ws(",", *values), F.lit("]"))


def json_number(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def digest(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def iso(value: Column) -> Column:
    """An instant as YYYY-MM-DDTHH:MM:SS+00:00, whatever the session's time zone."""
    seconds = F.unix_seconds(value)
    day, rest = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")), F.pmod(seconds, F.lit(86400))
    clock = [F.lpad(F.floor(x).cast("string"), 2, "0") for x in (rest / 3600, rest % 3600 / 60, rest % 60)]
    return F.concat(day.cast("string"), F.lit("T"), F.concat_ws(":", *clock), F.lit("+00:00"))


def _words(hexadecimal: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(hexadecimal, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))


def hex_modulo(hexadecimal: Column, n: Column) -> Column:
    """A 256-bit hexadecimal number modulo n (below 2^31), by Horner's rule on 32-bit words."""
    return F.aggregate(_words(hexadecimal), F.lit(0).cast("long"), lambda acc, w: F.pmod(acc * F.lit(2**32) + w, n.cast("long")))


def _rejected(hexadecimal: Column, n: Column) -> Column:
    """True for numbers in the last, incomplete run of n below 2^256: those that would make low indexes likelier."""
    over = F.pmod(hex_modulo(F.lit("f" * 64), n) + 1, n.cast("long"))  # 2^256 mod n
    # with n below 2^31, only numbers whose first seven words are all ones can be rejected
    tail = F.conv(F.substring(hexadecimal, 57, 8), 16, 10).cast("long")
    return (F.substring(hexadecimal, 1, 56) == F.lit("f" * 56)) & (tail >= F.lit(2**32) - over) & (over > 0)


def uniform_index(key: Column, size: Column, version: str, tries: int = 3) -> Column:
    """An unbiased index below size: SHA-256 of the canonical JSON [version, key, counter], with rejection, at most tries counters.

    key is the canonical JSON text of an object. Rejection has probability below 2^-225, so a draw that runs out of tries raises.
    """
    hashes = [F.sha2(F.concat(F.lit(f'["{version}",'), key, F.lit(f",{k}]")), 256) for k in range(tries)]
    out = F.raise_error(F.lit("no draw was accepted")).cast("long")
    for h in reversed(hashes):
        out = F.when(_rejected(h, size), out).otherwise(hex_modulo(h, size))
    return F.when(size > 0, out)
