"""HMAC-SHA256 delivery signatures, composed from the built-in `sha2`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.functions.columns import let

_BLOCK = 64


def _key_block(secret: Column) -> Column:
    """The 64-byte key block as 128 hex digits; longer secrets are hashed first."""
    raw = F.when(F.octet_length(secret) > _BLOCK, F.sha2(secret, 256)).otherwise(F.lower(F.hex(F.encode(secret, "utf-8"))))
    return F.rpad(raw, 2 * _BLOCK, "0")


def _pad(secret: Column, byte: int) -> Column:
    """Key block XOR a repeated byte. XOR with a constant is a fixed translation of hex digits, one
    for the high and one for the low digit of each byte."""
    digits = "0123456789abcdef"
    high, low = ("".join(digits[d ^ nibble] for d in range(16)) for nibble in (byte >> 4, byte & 15))
    block = _key_block(secret)
    both = F.struct(F.translate(block, digits, high).alias("h"), F.translate(block, digits, low).alias("l"))
    positions = F.sequence(F.lit(1), F.lit(2 * _BLOCK - 1), F.lit(2))
    mixed = let(
        both,
        lambda b: F.array_join(
            F.transform(positions, lambda i: F.concat(F.substring(b["h"], i, F.lit(1)), F.substring(b["l"], i + 1, F.lit(1)))), ""
        ),
    )
    return F.unhex(mixed)


def key_pads(secret: Column) -> Column:
    """Inner and outer pad; computed once per connection, not once per delivery."""
    return F.struct(_pad(secret, 0x36).alias("inner"), _pad(secret, 0x5C).alias("outer"))


def hmac_sha256(pads: Column, body: Column) -> Column:
    inner = F.unhex(F.sha2(F.concat(pads["inner"], F.encode(body, "utf-8")), 256))
    return F.sha2(F.concat(pads["outer"], inner), 256)


def signature_ok(secret: Column, pads: Column, body: Column, header: Column) -> Column:
    """True for `sha256=<hex>` equal to the body's HMAC; an empty secret never verifies."""
    given = F.lower(F.substring(header, 8, 1 << 20))
    wellformed = header.startswith("sha256=") & given.rlike("^([0-9a-f]{2})*$")
    return F.coalesce((F.coalesce(secret, F.lit("")) != "") & wellformed & (given == hmac_sha256(pads, body)), F.lit(False))
