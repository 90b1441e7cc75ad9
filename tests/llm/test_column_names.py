"""Tables whose other columns are named like what the operators make on the way."""

import time

import pyspark.sql.functions as F
import pytest

from synthframe.llm import chat, licenses
from synthframe.llm.decontaminate import contamination, remove_contaminated
from synthframe.llm.quality import keep_quality
from synthframe.llm.simhash import drop_near_duplicates
from synthframe.llm.suffix_dedup import removal_report, without_repeats

NAMES = ("_content", "_null", "_row", "_id", "_text", "_none", "none", "text_key", "copies", "spans", "n_words", "items", "_n", "key", "a.b")


@pytest.fixture
def clashing(spark, prose):
    texts = [*prose(4), prose(1)[0], None, ""]
    rows = [(i, t, *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ["doc_id", "text", *NAMES]).repartition(2)


def others(df):
    return sorted(tuple(r[n] for n in ("doc_id", *NAMES)) for r in df.collect())


def test_stages_of_the_pipeline_keep_every_column(spark, clashing, prose):
    benchmark = spark.createDataFrame([(1, prose(4)[2])], "item_id long, text string")
    every = others(clashing)
    for made, gone in ((drop_near_duplicates(clashing), {4, 6}), (without_repeats(clashing), set()), (remove_contaminated(clashing, benchmark), {2}), (keep_quality(clashing), {5, 6})):
        assert made.columns == clashing.columns
        assert others(made) == [r for r in every if r[0] not in gone]


def test_reports_take_any_columns(spark, clashing, prose):
    report = removal_report(clashing)
    assert others(report) == others(clashing) and {"n_bytes", "n_removed", "n_spans", "kept_sha256"} <= set(report.columns)
    assert removal_report(clashing.select("text")).count() == 7 and without_repeats(clashing.select("text")).columns == ["text"]


def test_test_items_in_blocks_and_repeated(spark, docs, prose):
    texts = prose(6)
    items = [(i, texts[i]) for i in range(3)] * 20
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = [sorted(map(str, contamination(docs(texts), b, block_bytes=n).collect())) for b, n in ((benchmark, 1 << 20), (benchmark, 900), (benchmark.distinct(), 1 << 20))]
    assert whole[0] == whole[1] == whole[2]


@pytest.mark.parametrize("kind", ["date", "decimal(10,2)", "double", "short", "boolean", "timestamp", "string"])
def test_conversations_with_any_key(spark, kind):
    frame = spark.range(6).select(F.lit(1).cast("string").cast("string").alias("n"), F.when(F.lit(kind == "date"), "2024-01-02").when(F.lit(kind == "timestamp"), "2024-01-02 03:04:05").when(F.lit(kind == "boolean"), "true").otherwise("7").cast(kind).alias("conv"),
                                  "id", F.to_json(F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))).alias("record")).withColumnRenamed("id", "turn")
    found = chat.conversation_digests(chat.format_records(frame, "record", ["conv", "turn"]), "conv", ["turn", "part"]).collect()
    assert [(r["n_turns"]) for r in found] == [6] and found[0]["conv"] == frame.first()["conv"]


def test_many_notices_take_time_in_proportion(docs):
    took = []
    for n in (4000, 16_000):
        frame = docs(["under the mit license we go on. " * n])
        start = time.perf_counter()
        found = licenses.scan_licenses(frame).first()
        took.append(time.perf_counter() - start)
        assert len(found["base"]) == n and found["base"][-1]["word"] == 7 * (n - 1)
    assert took[1] < 10 * took[0] + 1
