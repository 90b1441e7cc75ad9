"""Audits of identities and natural keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import uuid5_natural


def audit_identity(df: DataFrame, domain: str, entity: str, stored: str, natural_key: Column) -> DataFrame:
    """Rows whose stored id is not the derived one (a missing stored id counts)."""
    checked = df.withColumn("derived_id", uuid5_natural(domain, entity, natural_key))
    return checked.filter(~F.col(stored).eqNullSafe(F.col("derived_id")))


def natural_key_collisions(df: DataFrame, key: str) -> DataFrame:
    """Natural keys that occur more than once: they would all derive one id."""
    return (df.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
              .groupBy(F.col(key).alias("natural_key")).agg(F.count(F.lit(1)).alias("rows"))
              .filter(F.col("rows") > 1))
