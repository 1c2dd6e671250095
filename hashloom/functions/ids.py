"""Content ids and hash digits as columns."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Fixed by the public content-id format: base16 multibase and version 1, codec byte, SHA-256 multihash header.
CID_PREFIX = "f01"
CODECS = {"raw": "55", "dag-cbor": "71"}
SHA256_HEADER = "1220"


def content_id(data: Column, codec: str = "raw") -> Column:
    """The content id of binary or text data; null for null."""
    return F.concat(F.lit(CID_PREFIX + CODECS[codec] + SHA256_HEADER), F.sha2(data, 256))


def key_hash(key: Column) -> Column:
    """Hex SHA-256 of a key: its path in the trie, two digits a level."""
    return F.sha2(key, 256)


def custom_hash(fn: Callable[[bytes], bytes]) -> Callable[[Column], Column]:
    """A column function for another hash (bytes to bytes), as hex; runs in Arrow batches."""

    @F.pandas_udf(T.StringType())
    def hashed(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else fn(bytes(b)).hex())

    return lambda data: hashed(data.cast("binary"))


def prefix(hash_hex: Column, levels: int) -> Column:
    """The first ``levels`` bytes of a hash, as hex."""
    return F.substring(hash_hex, 1, 2 * levels)


def slot(hash_hex: Column, depth: int | Column) -> Column:
    """Byte number ``depth`` of a hash, 0 to 255."""
    start = F.lit(depth) * 2 + 1 if isinstance(depth, int) else depth * 2 + 1
    return F.conv(F.substr(hash_hex, start, F.lit(2)), 16, 10).cast("int")


def extract_bits(hash_hex: Column, depth: int | Column, nbits: int) -> Column:
    """Bits depth * nbits to (depth + 1) * nbits - 1, most significant first; an error if the hash has fewer. ``nbits`` of 62 at most."""
    nibbles = F.transform(F.split(hash_hex, ""), lambda c: F.lpad(F.conv(c, 16, 2), 4, "0"))
    bits = F.array_join(F.filter(nibbles, lambda c: c.isNotNull()), "")
    depth = F.lit(depth) if isinstance(depth, int) else depth
    value = F.conv(F.substr(bits, depth * nbits + 1, F.lit(nbits)), 2, 10).cast("long")
    return F.when(F.length(hash_hex) * 4 >= (depth + 1) * nbits, value).otherwise(F.raise_error(F.lit("the hash has too few bits")).cast("long"))
