"""Keyed digests from built-in hash functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Block bytes of SHA-256 and the two pads of HMAC (fixed values).
BLOCK, INNER, OUTER = 64, 0x36, 0x5C


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256 of a text column, without leaving the JVM."""
    import hashlib

    if len(key) > BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(BLOCK, b"\0")
    inner, outer = (bytes(b ^ pad for b in key) for pad in (INNER, OUTER))
    first = F.sha2(F.concat(F.lit(bytearray(inner)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 256)


def session_label(key: bytes, subscriber: Column) -> Column:
    """Two groups of eight hex characters; empty for a null subscriber. The break
    keeps runs of ten digits from arising."""
    digest = hmac_sha256(key, subscriber.cast("string"))
    label = F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 8))
    return F.coalesce(label, F.lit(""))
