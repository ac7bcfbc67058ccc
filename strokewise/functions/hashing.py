"""Keyed hashes and names derived from them, as native column expressions."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a string, in hexadecimal; null stays null."""
    key = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(outer, F.unhex(first)), 256)


def pseudonym(kind: str, value: Column, key: bytes, digits: int = 24) -> Column:
    """A name that tells nothing without the key, the same for equal values; null and empty values have none."""
    text = value.cast("string")
    return F.when(text != "", F.concat(F.lit(f"{kind}_"), F.substring(hmac_sha256(key, F.concat(F.lit(f"{kind}:"), text)), 1, digits)))


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """The version 5 UUID of a name; null stays null."""
    digest = F.sha1(F.concat(F.lit(bytearray(namespace.bytes)), F.encode(name, "UTF-8")))
    part = lambda at, n: F.substring(digest, at, n)
    variant = F.element_at(F.array(*[F.lit("89ab"[i % 4]) for i in range(16)]), F.conv(part(17, 1), 16, 10).cast("int") + 1)
    return F.when(name.isNotNull(), F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12)))


def bucket(value: Column, n: int) -> Column:
    """0 to n-1 by the value's SHA-256: the same everywhere."""
    digest = F.sha2(value.cast("string"), 256)
    high, low = (F.conv(F.substring(digest, i, 8), 16, 10).cast("decimal(20,0)") for i in (1, 9))
    return ((high * F.lit(1 << 32).cast("decimal(20,0)") + low) % n).cast("int")
