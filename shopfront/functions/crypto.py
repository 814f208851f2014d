"""HMAC-SHA256 as built-in column expressions.

Spark has no hmac function, but HMAC is two nested SHA-256 passes over
the key padded to the block size and XORed with fixed pads.  The secret is
a job parameter, so both padded keys are constants computed once on the
driver; per row only ``sha2``/``unhex``/``concat`` run, all JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64  # SHA-256 block size in bytes


def padded_keys(secret: bytes) -> tuple[bytes, bytes]:
    """(key XOR ipad, key XOR opad) as in RFC 2104."""
    if len(secret) > _BLOCK:
        import hashlib
        secret = hashlib.sha256(secret).digest()
    k = secret.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)


def hmac_sha256_hex(secret: bytes | str, message: Column) -> Column:
    """Lower-case hex HMAC-SHA256 of a string column under ``secret``."""
    if isinstance(secret, str):
        secret = secret.encode()
    ipad, opad = padded_keys(secret)
    inner = F.sha2(F.concat(F.lit(ipad), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(opad), F.unhex(inner)), 256)
