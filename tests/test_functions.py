import hashlib

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from hashloom.functions import crypt, ids, ranges

#: Bits, depth, bits a digit, result.
BITS = [
    ("11111111", 0, 5, "11111"), ("10101010", 0, 5, "10101"), ("10000000", 0, 5, "10000"), ("00010000", 0, 5, "00010"),
    ("1000010010010000", 0, 9, "100001001"), ("1010101010101010", 0, 9, "101010101"), ("1000010010010000", 1, 5, "10010"), ("1010101010101010", 1, 5, "01010"),
    ("1000010010010000", 2, 5, "01000"), ("1010101010101010", 2, 5, "10101"), ("10000100100100001000010010000100", 3, 5, "01000"), ("10101010" * 4, 3, 5, "01010"),
    ("10000100100100001000010010000100", 4, 5, "01001"), ("10101010" * 4, 4, 5, "10101"),
]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_extract_bits(spark):
    rows = [(f"{int(b, 2):0{len(b) // 4}x}", d, n, int(v, 2)) for b, d, n, v in BITS]
    for n in (5, 9):
        df = spark.createDataFrame([r for r in rows if r[2] == n], "h string, d int, n int, want long")
        assert df.where(ids.extract_bits(F.col("h"), F.col("d"), n) != F.col("want")).count() == 0
    with pytest.raises(Exception, match="too few bits"):
        one(spark, ids.extract_bits(F.lit("01"), 20, 20))


def test_content_id(spark):
    assert one(spark, ids.content_id(F.lit(b"abc"))) == "f01551220" + hashlib.sha256(b"abc").hexdigest()
    assert one(spark, ids.content_id(F.lit(b"abc"), "dag-cbor")).startswith("f01711220")
    assert one(spark, ids.content_id(F.lit(None).cast("binary"))) is None


def test_custom_hash(spark):
    assert one(spark, ids.custom_hash(lambda b: hashlib.md5(b).digest())(F.lit("abc"))) == hashlib.md5(b"abc").hexdigest()


DATA = b"0123456789abcdefghijklmnopqrstuvwxyz"


@pytest.mark.parametrize(("kw", "want"), [({"offset": 10, "length": 5}, b"abcde"), ({"offset": 30}, b"uvwxyz"), ({"suffix": 6}, b"uvwxyz"), ({}, DATA), ({"suffix": 0}, b""), ({"offset": 3, "length": 0}, b""), ({"offset": 99}, b""), ({"suffix": 99}, DATA), ({"length": 4}, b"0123")])
def test_ranges(spark, kw, want):
    assert bytes(one(spark, ranges.read_range(F.lit(DATA), **kw))) == want


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.binary(max_size=40), st.integers(0, 50), st.integers(0, 50), st.integers(0, 50)), min_size=1, max_size=40))
def test_ranges_as_slices(spark, rows):
    df = spark.createDataFrame([(bytearray(b), o, n, s) for b, o, n, s in rows], "b binary, o int, n int, s int")
    got = df.select(ranges.read_range(F.col("b"), F.col("o"), F.col("n")).alias("x"), ranges.read_range(F.col("b"), F.col("o")).alias("y"), ranges.read_range(F.col("b"), suffix=F.col("s")).alias("z")).collect()
    assert [(bytes(r.x), bytes(r.y), bytes(r.z)) for r in got] == [(b[o : o + n], b[o:], b[len(b) - min(s, len(b)) :]) for b, o, n, s in rows]


def test_byte_request_errors(spark):
    request = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    with pytest.raises(Exception, match="ends before"):
        one(spark, ranges.byte_request(F.lit(DATA), request("range", 10, 5)))
    with pytest.raises(Exception, match="unknown"):
        one(spark, ranges.byte_request(F.lit(DATA), request("middle", 1, 2)))


def test_encryption(spark):
    key, other = F.lit(b"k" * 32), F.lit(b"o" * 32)
    sealed = one(spark, crypt.encrypt(F.lit("text"), key, "h"))
    assert bytes(sealed) != bytes(one(spark, crypt.encrypt(F.lit("text"), key, "h"))) and len(sealed) == 4 + 28
    assert bytes(one(spark, crypt.decrypt(F.lit(bytes(sealed)), key, "h"))) == b"text"
    assert one(spark, crypt.try_decrypt(F.lit(bytes(sealed)), other, "h")) is None
    assert one(spark, crypt.try_decrypt(F.lit(bytes(sealed)), key, "x")) is None
    with pytest.raises(Exception, match="32 bytes"):
        one(spark, crypt.encrypt(F.lit("text"), F.lit(b"short"), "h"))
