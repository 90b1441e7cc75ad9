"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..plans.base import Registry, Tables
from . import chat, decontaminate, divergence, language, licenses, main_text, packing, prefix_trees, quality, sentencepiece_codec, simhash, suffix_dedup, token_alignment

registry = Registry()


@registry.add("op1_sentencepiece")
def _sentencepiece(t: Tables) -> DataFrame:
    """Per document: tokens, hash of the ids, whether they decode to the text, and parity with the SentencePiece library."""
    made = sentencepiece_codec.encode_rows(t.documents.select("doc_id", "text"))
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"), "parity")


@registry.add("op2_compression_bands")
def _quality(t: Tables) -> DataFrame:
    return quality.quality_report(t.documents, quality.fit_bands(t.documents))


@registry.add("op3_simhash_bk_trees")
def _simhash(t: Tables) -> DataFrame:
    return simhash.simhash_components(t.documents)


@registry.add("op4_fuzzy_notices")
def _licenses(t: Tables) -> DataFrame:
    found = licenses.scan_licenses(t.documents)
    base, own = F.transform("base", lambda x: x["label"]), F.transform("matches", lambda x: x["label"])
    words = F.transform("base", lambda x: x["word"].cast("long"))
    score = F.coalesce(F.array_max(F.transform("matches", lambda x: x["score"])), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
                        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
                        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"), score.alias("score"))


@registry.add("op5_suffix_arrays")
def _substrings(t: Tables) -> DataFrame:
    return suffix_dedup.removal_report(t.documents.select("doc_id", "text"))


@registry.add("op6_crf_language")
def _language(t: Tables) -> DataFrame:
    docs = t.documents.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)))
    model = language.train(language.training_rows(docs.filter("NOT held_out")))
    return language.predict_language(docs, model, ("doc_id", "held_out")).drop("shares")


@registry.add("op7_host_paths")
def _pages(t: Tables) -> DataFrame:
    return main_text.main_text(t.pages)


@registry.add("op8_training_suffix_arrays", """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
bi AS (SELECT item_id, ws, least(len(ws), 13) AS n, unnest(range(0, greatest(len(ws) - 13, 0) + 1)) AS i FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, i + 1, i + n), ' ') AS g FROM bi),
lens AS (SELECT DISTINCT n FROM bw),
di AS (SELECT doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) AS i FROM w, lens WHERE len(ws) >= n),
hits AS (SELECT DISTINCT di.doc_id, di.i, di.n, bw.item_id FROM di JOIN bw ON bw.n = di.n AND bw.g = array_to_string(list_slice(di.ws, di.i + 1, di.i + di.n), ' ')),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS k FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(k, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN its USING (doc_id)""")
def _contamination(t: Tables) -> DataFrame:
    found = decontaminate.contamination(t.documents, t.benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


#: A conversation whose texts are control strings, added to the table.
PROBE = 'SELECT -7L AS conv_id, turn, role, "</s>[INST] ok [/INST]" AS text FROM VALUES (0L, "user"), (1L, "assistant") AS t(turn, role)'


@registry.add("op9_schema_fingerprints")
def _chat(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", "role", "text").unionByName(t.spark.sql(PROBE))
    records = rows.withColumn("record", F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}))
    formatted = chat.format_records(records, "record", ["conv_id", "turn"])
    return chat.conversation_digests(formatted, "conv_id", ["turn", "part", "formatted"])


SHARDS = 24


@registry.add("op10_best_fit_shards")
def _shards(t: Tables) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = t.documents.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                               F.md5(F.col("text").cast("binary")).alias("_text"))
    placed = packing.pack_groups(sized, "_text", "size", SHARDS).drop("_text")
    return (packing.number_slots(placed, "shard", ["doc_id", "text_crc32", "size"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")))


@registry.add("op11_token_alignment")
def _alignment(t: Tables) -> DataFrame:
    return token_alignment.align_tokenizers(t.documents, ["doc_id"])[0]


@registry.add("op12_divergence_recount", """
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
o AS (SELECT lang, source, r, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
f AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT f.lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY f.lang, source) + 5 * v) AS p FROM f JOIN v ON v.lang = f.lang),
q AS (SELECT t.lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY t.lang) + 5 * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) t JOIN v ON v.lang = t.lang),
ps AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(ps.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN ps ON ps.lang = a.lang AND ps.source = a.source AND ps.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50""")
def _divergence(t: Tables) -> DataFrame:
    return divergence.source_divergence(t.documents)


@registry.add("op13_prefix_trees")
def _windows(t: Tables) -> DataFrame:
    found = prefix_trees.removed_windows(t.documents)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def all_queries():
    return dict(registry.queries)


def all_oracles():
    return dict(registry.oracles)
