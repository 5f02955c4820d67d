"""The SQL functions against their column forms."""

import pytest
from pyspark.sql import functions as F

from veilspark.functions import hashing, sql
from veilspark.functions import validators as v

KEY = hashing.KeyMaterial(bytes([0x33]) * 32, bytes([0x44]) * 32)
VALUES = ["４111 1111 1111 1111", "4111 1111 1111 1111", "4111-1111-1111-1112", "", "aAbB", "x", "ключ é\U0001f600", "a@b.co", None, "y" * 300]


@pytest.mark.parametrize("bits", [64, 96, 128])
def test_sql_functions_equal_their_column_forms(spark, bits):
    assert sql.register(spark, KEY, ("email", "custom:member"), bits) == ["luhn", "entropy", "value_hash", "token"]
    spark.createDataFrame([(k, x) for k, x in enumerate(VALUES)], "k int, s string").createOrReplaceTempView("some_values")
    long = "r" * 80
    got = spark.sql(f"""SELECT k, luhn(s) AS l, entropy(s) AS e, value_hash('pii.email', s) AS h, value_hash('{long}', s) AS g,
        token('email', s) AS t, token('custom:member', s) AS u, token('other', s) AS o FROM some_values ORDER BY k""").collect()
    s = F.col("s")
    want = spark.table("some_values").select(
        "k", v.luhn(s).alias("l"), v.entropy(s).alias("e"), hashing.value_hash("pii.email", s).alias("h"), hashing.value_hash(long, s).alias("g"),
        hashing.token(KEY, "email", s, bits).alias("t"), hashing.token(KEY, "custom:member", s, bits).alias("u"), F.lit(None).cast("string").alias("o"),
    ).orderBy("k").collect()
    assert got == want
    assert spark.sql("SELECT count(*) FROM some_values WHERE luhn(s)").first()[0] == 2
