"""Byte ranges of binary columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def read_range(data: Column, offset: Column | int | None = None, length: Column | int | None = None, suffix: Column | int | None = None) -> Column:
    """Bytes from ``offset`` on (at most ``length``), or the last ``suffix`` bytes, or all; null data gives null.

    A suffix or length of 0 gives no bytes; ``length`` alone counts from the start.
    """
    lit = lambda v: F.lit(v) if v is None or isinstance(v, int) else v
    data = data.cast("binary")
    n = F.octet_length(data)
    if suffix is not None:
        size = F.least(lit(suffix), n)
        return F.substr(data, n - size + 1, size)
    if offset is None and length is None:
        return data
    begin = F.lit(0) if offset is None else lit(offset)
    return F.substr(data, (begin + 1).cast("int"), (n if length is None else lit(length)).cast("int"))


def byte_request(data: Column, request: Column) -> Column:
    """Bytes for a request struct(kind, a, b): ``range`` [a, b), ``offset`` from a, ``suffix`` of a bytes, or null for all.

    A range that ends before it starts, and any other kind, are errors.
    """
    kind, a, b = request["kind"], request["a"], request["b"]
    bad = lambda text: F.raise_error(F.lit(text)).cast("binary")
    return (
        F.when(request.isNull() | kind.isNull(), data.cast("binary"))
        .when((kind == "range") & (b < a), bad("the range ends before it starts"))
        .when(kind == "range", read_range(data, a, b - a))
        .when(kind == "offset", read_range(data, a))
        .when(kind == "suffix", read_range(data, suffix=a))
        .otherwise(bad("unknown byte request"))
    )
