"""Normal forms of identifiers, object keys and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"^[\s ]+|[\s ]+$"


def trimmed(c: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(c, BLANKS, "")


def hex_id(c: Column) -> Column:
    """Lower case without surrounding blanks; an empty id is null."""
    return F.nullif(F.lower(trimmed(c)), F.lit(""))


def percent_decoded(c: Column) -> Column:
    """RFC 3986 decoding as UTF-8: `+` stays, a `%` that starts no escape stays. Rows without `%` skip the work."""
    ready = F.replace(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(F.contains(c, F.lit("%")), F.url_decode(ready)).otherwise(c)


def packed_hex(c: Column) -> Column:
    """Hex text as bytes, half as wide in a shuffle; other text as its own UTF-8 bytes behind a zero byte.

    The two ranges cannot meet on equal values of the same input: a value is either all hex of even length or not.
    """
    whole = c.rlike("^([0-9a-f]{2})+$")
    return F.when(whole, F.concat(F.lit(b"\x01"), F.unhex(c))).otherwise(F.concat(F.lit(b"\x00"), F.encode(c, "utf-8")))


def unpacked_hex(c: Column) -> Column:
    body = F.substring(c, 2, 2147483646)
    return F.when(F.substring(c, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(body))).otherwise(F.decode(body, "utf-8"))


def entry_name(c: Column) -> Column:
    """A text as the name of an archive's entry, reversible by percent_decoded: bytes that a path must not hold as `%XX`."""
    byte = lambda h: F.conv(h, 16, 10).cast("int")
    plain = lambda h: byte(h).between(33, 126) & ~h.isin(*(f"{b:02X}" for b in b'%/\\:*?"<>|'))
    parts = F.transform(F.regexp_extract_all(F.hex(F.encode(c, "utf-8")), F.lit("(..)"), F.lit(1)), lambda h: F.when(plain(h), F.chr(byte(h))).otherwise(F.concat(F.lit("%"), h)))
    return F.array_join(parts, "")
