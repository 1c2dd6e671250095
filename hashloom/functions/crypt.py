"""Value encryption: AES-GCM with a header that is authenticated with each value.

The key is a column, so that it can come from a secret table or a session
variable; a literal key would show up in logged plans. Keys go in verbatim, only
values are encrypted, as one value of 12 bytes nonce, ciphertext and 16 bytes tag.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

KEY_BYTES = 32


def _checked(key: Column) -> Column:
    return F.when(F.octet_length(key) == KEY_BYTES, key).otherwise(F.raise_error(F.lit("the key must have 32 bytes")).cast("binary"))


def encrypt(value: Column, key: Column, header: str = "") -> Column:
    return F.aes_encrypt(value.cast("binary"), _checked(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"").cast("binary"), F.lit(header.encode()))


def decrypt(value: Column, key: Column, header: str = "") -> Column:
    """The value; an error if key or header are not those it was encrypted with."""
    return F.aes_decrypt(value, _checked(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(header.encode()))


def try_decrypt(value: Column, key: Column, header: str = "") -> Column:
    """The value, or null if key or header are not those it was encrypted with."""
    return F.try_aes_decrypt(value, _checked(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(header.encode()))
