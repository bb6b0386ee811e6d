"""Keyed tokens: published vectors, edge values, and Column against Python."""

import hashlib
import hmac

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloakfield.functions.tokens import hmac_hex, is_token, token, token_text, weak_salt

SALT = "unit-test-salt-of-more-than-32-characters"
KNOWN = {
    ("USER", "alice"): "[USER_7d3b5ef69cb0c55d]",
    ("USER", "bob"): "[USER_3c6f0744aa5f8dbd]",
    ("USER", "alice(uid=1001)"): "[USER_03039ef2cf708ba7]",
    ("IP", "192.168.1.50"): "[IP_90cdfffaa9a7fb6f]",
    ("IP", "10.20.30.4"): "[IP_a97fd567dddbcd62]",
    ("HOST", "web-01"): "[HOST_3f9e090adda45c83]",
    ("HOST", "host-a"): "[HOST_138339fce0c12dba]",
    ("AGENT", "agent-7"): "[AGENT_6a4f3824f59c3339]",
}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("family,value", KNOWN)
def test_known_tokens(spark, family, value):
    assert one(spark, token(family, F.lit(value), SALT)) == KNOWN[family, value] == token_text(family, value, SALT)


@pytest.mark.parametrize("key,message,digest", [
    (b"\x0b" * 20, "Hi There", "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"),
    (b"Jefe", "what do ya want for nothing?", "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
    (b"\xaa" * 131, "Test Using Larger Than Block-Size Key - Hash Key First", "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54"),
])
def test_rfc_4231(spark, key, message, digest):
    assert one(spark, hmac_hex(F.lit(message), key)) == digest


@pytest.mark.parametrize("length", [0, 1, 32, 63, 64, 65, 131])
def test_key_lengths(spark, length):
    key = bytes(range(length))
    assert one(spark, hmac_hex(F.lit("user:ü中😀"), key)) == hmac.new(key, "user:ü中😀".encode(), hashlib.sha256).hexdigest()


@settings(max_examples=8, deadline=None)
@given(st.text(min_size=1, max_size=30).filter(lambda s: "\x00" not in s and s.isprintable()))
def test_column_equals_python(value):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    row = spark.createDataFrame([(value,)], "v string").select(token("USER", F.col("v"), SALT).alias("t")).first()
    assert row["t"] == token_text("USER", value, SALT)


def test_null_empty_and_tokens_stay(spark):
    rows = spark.createDataFrame([(None,), ("",), ("[HOST_3f9e090adda45c83]",)], "v string").select(token("USER", F.col("v"), SALT).alias("t")).collect()
    assert [r["t"] for r in rows] == [None, "", "[HOST_3f9e090adda45c83]"]


def test_what_is_a_token(spark):
    values = ["[IP_90cdfffaa9a7fb6f]", "[IP_90cdfffaa9a7fb6f]\n", "[EMAIL_90cdfffaa9a7fb6f]", "x[IP_90cdfffaa9a7fb6f]", None]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(is_token(F.col("v")).alias("t")).collect()
    assert [r["t"] for r in rows] == [True, False, False, False, False]


def test_weak_salt():
    assert weak_salt("short" + " " * 40) and not weak_salt("x" * 32)
