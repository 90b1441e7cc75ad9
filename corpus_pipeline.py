"""The corpus pipeline: quality rules, near-dedup, substring dedup, decontamination, tokens.

Each stage is an operator of ``synthframe.llm`` over everything its predecessor kept; near dedup takes fingerprints, their
components and the BK-trees from operator 3, on sets of five-word shingles, and checks what they find. A stage takes
(spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read again as the next
stage's documents, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from synthframe.llm.decontaminate import remove_contaminated
from synthframe.llm.quality import fit_bands, keep_quality
from synthframe.llm.sentencepiece_codec import encode_rows
from synthframe.llm.simhash import drop_near_duplicates
from synthframe.llm.suffix_dedup import without_repeats
from synthframe.session import configure, scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or the compression bands, fitted to these documents, go."""
    return keep_quality(docs, fit_bands(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: SimHash and BK-trees over five-word shingles, checked at similarity 0.8."""
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that stand elsewhere too are cut out of the texts; ``n_chars`` follows, no row goes."""
    kept = without_repeats(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more stand in benchmark windows go."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, their number, and whether they read back as the text and equal the library's own."""
    made = encode_rows(docs.select("doc_id", "text"))
    return made.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"), "parity")


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("substring dedup", substring_dedup), ("decontamination", decontamination), ("tokens", tokens)]

#: SQL has neither zstandard nor the fingerprints; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
