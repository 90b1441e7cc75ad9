import uuid

import pytest
from pyspark.sql import functions as F

from synthframe.functions.identity import NAMESPACE, uuid5_name, uuid5_natural, uuid5_ordinal
from synthframe.operators.sequence import dense_sequence


def test_frozen_vector(spark):
    row = spark.range(1).select(uuid5_natural("CRM", "Customer", F.lit("Acme Ltd"))).first()
    assert row[0] == "f629ad79-bbba-5d12-ae83-b8a8b9bf4ce0"


def test_equals_the_standard_library(spark):
    names = ["", "a", "Ærø|ø", "x" * 300, "line\nbreak", "2024"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r["n"]: r["id"] for r in df.select("n", uuid5_name(F.col("n")).alias("id")).collect()}
    assert got == {n: str(uuid.uuid5(uuid.UUID(NAMESPACE), n)) for n in names}


def test_ordinal_form(spark):
    got = spark.range(1).select(uuid5_ordinal("D", "E", "S", 7, F.lit(12))).first()[0]
    assert got == str(uuid.uuid5(uuid.UUID(NAMESPACE), "D|E|S|7|12"))


def test_null_key_is_an_error(spark):
    with pytest.raises(Exception, match="must not be null"):
        spark.range(1).select(uuid5_natural("D", "E", F.lit(None).cast("string"))).collect()


def test_sequence_is_dense_and_ordered(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k")).repartition(9)
    out = dense_sequence(df, ["k"], "n", start=10).collect()
    assert all(r["n"] == r["k"] + 10 for r in out)
    assert len(out) == 5000
