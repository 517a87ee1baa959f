"""Column functions over bytes. Searches go through the Latin-1 view, which maps each byte to one character."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def latin1(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def byte_count(data: Column, allowed: str) -> Column:
    """Bytes of a Latin-1 character class."""
    return F.octet_length(data) - F.length(F.regexp_replace(latin1(data), f"[{allowed}]+", ""))


def ascii_ratio(data: Column) -> Column:
    """Share of printable ASCII, space, LF and CR; tabs don't count. Empty: 0."""
    return F.coalesce(byte_count(data, r"\x21-\x7e \n\r") / F.nullif(F.octet_length(data), F.lit(0)), F.lit(0.0))


def zero_ratio(data: Column) -> Column:
    return F.coalesce(byte_count(data, r"\x00") / F.nullif(F.octet_length(data), F.lit(0)), F.lit(0.0))


def int_le(data: Column, at: int, size: int) -> Column:
    """Unsigned little-endian integer at a 0-based offset; null beyond the end."""
    b = F.hex(F.substring(data, at + 1, size))
    turned = F.concat(*(F.substring(b, 2 * k + 1, 2) for k in reversed(range(size))))
    return F.when(F.octet_length(data) >= at + size, F.conv(turned, 16, 10).cast("decimal(20,0)"))


def int_be(data: Column, at: int, size: int) -> Column:
    return F.when(F.octet_length(data) >= at + size, F.conv(F.hex(F.substring(data, at + 1, size)), 16, 10).cast("decimal(20,0)"))


def hex_line(data: Column, offset: Column) -> Column:
    """'%08x  hex bytes  ascii' of up to 16 bytes."""
    pairs = F.rpad(F.rtrim(F.lower(F.regexp_replace(F.hex(data), "(..)", "$1 "))), 47, " ")
    shown = F.regexp_replace(latin1(data), r"[^\x20-\x7e]", ".")
    return F.concat(F.lower(F.lpad(F.hex(offset), 8, "0")), F.lit("  "), pairs, F.lit("  "), shown)


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID (version 5) as a column expression."""
    x = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(x, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(x, 1, 8), F.substring(x, 9, 4), F.concat(F.lit("5"), F.substring(x, 14, 3)), F.concat(variant, F.substring(x, 18, 3)), F.substring(x, 21, 12))


def extension(name: Column) -> Column:
    """What follows the last dot; the whole name where there is none."""
    return F.element_at(F.split(name, r"\."), -1)
