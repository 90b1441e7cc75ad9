"""How far the sources of a language differ in their terms.

Two passes over the texts. The first counts in how many documents of its language a term stands and keeps the
frequent ones, exactly. These become minimal perfect hashes, one for each shard of a language's terms, built by
tasks; the second pass carries a bounded set of shards at a time to the texts, verifies each term against the
stored keys, and adds its occurrences to the slots of a dense array per (language, source). Distances between
sources are summed in tiles of sources and terms, so no task holds all sources or all terms.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from ..session import scratch_path
from .perfect_hash import PerfectHash, key_hashes
from .texts import joined, text_slices
from .words import byte_table, runs_of

LEAST_DOCS = 30
PRIOR, UNIT = 5, 1_000_000_000
TOP_TERMS = 50
#: Terms of one perfect hash, bytes of them that travel with one pass, and slots of dense arrays that a task holds.
SHARD_TERMS, PASS_BYTES, HELD_SLOTS = 1 << 16, 64 << 20, 4 << 20
#: Sources and terms of one tile of distances.
TILE_SOURCES, TILE_TERMS = 64, 4096


def slice_terms(texts: pa.Array, folded: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct terms, number of the term of each occurrence, its row) of a text column."""
    data, bounds = joined(texts)
    own = inside[data]
    begin, end = runs_of(own, bounds)
    offsets = np.concatenate(([0], np.cumsum(end - begin))).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(folded[data[own]])]).dictionary_encode()
    return terms.dictionary, terms.indices.to_numpy(), np.searchsorted(bounds[1:], begin, side="right")


def term_bytes() -> np.ndarray:
    """Bytes of terms ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``: ASCII letters and everything above ASCII."""
    inside = np.zeros(256, bool)
    inside[0x41:0x5B] = inside[0x61:0x7B] = inside[0x80:] = True
    return inside


def _frequencies(folded: np.ndarray, inside: np.ndarray):
    """Task: texts to (lang, term, documents of the slice that hold it)."""
    def run(batches):
        for part in text_slices(batches, "text", 4 << 20):
            terms, number, row = slice_terms(part.column("text"), folded, inside)
            langs = part.column("lang").dictionary_encode()
            width = max(len(terms), 1)
            once = np.unique(row * width + number)
            pair, n = np.unique(langs.indices.to_numpy()[once // width].astype(np.int64) * width + once % width, return_counts=True)
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(pair // width)), terms.take(pa.array(pair % width)), pa.array(n)], ["lang", "term", "n_docs"])

    return run


def frequent_terms(rows: DataFrame, least: int) -> DataFrame:
    """(lang, term as bytes) of the terms that stand in ``least`` documents of their language or more."""
    found = rows.mapInArrow(_frequencies(byte_table(), term_bytes()), "lang string, term binary, n_docs long")
    return found.groupBy("lang", "term").agg(F.sum("n_docs").alias("n")).filter(F.col("n") >= least).select("lang", "term")


def _hashed(table: pa.Table) -> pa.Table:
    """Terms of one shard to one row with their perfect hash."""
    keys = table["term"].combine_chunks().cast(pa.binary())
    made = PerfectHash.build(keys).packed()
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.table({"lang": table["lang"][:1], "shard": table["shard"][:1], "shards": table["shards"][:1], "n_bytes": pa.array([len(made["bits"]) + keys.nbytes]),
                     "sizes": one(pa.array(made["sizes"], pa.int64())), "bits": pa.array([made["bits"]], pa.binary()), "keys": one(made["keys"]), "placed": pa.array([made["placed"]], pa.int64())})


SHARD_ROWS = "lang string, shard int, shards int, n_bytes long, sizes array<bigint>, bits binary, keys array<binary>, placed long"


@dataclass
class Language:
    """The shards of one language that a pass carries."""

    shards: int
    parts: dict[int, tuple[int, PerfectHash]]  # first slot and hash
    size: int = 0

    def slots(self, terms: pa.Array, hashes: np.ndarray) -> np.ndarray:
        shard = np.array([zlib.crc32(t) % self.shards for t in terms.to_pylist()], np.int64)
        out = np.full(len(terms), -1, np.int64)
        for number, (base, perfect) in self.parts.items():
            at = np.flatnonzero(shard == number)
            found = perfect.lookup(terms.take(pa.array(at)), hashes[at])
            out[at] = np.where(found < 0, -1, found + base)
        return out

    def terms(self) -> pa.Array:
        return pa.concat_arrays([p.keys for _, p in self.parts.values()])


def _languages(rows: list) -> dict[str, Language]:
    out: dict[str, Language] = {}
    for r in rows:
        own = out.setdefault(r["lang"], Language(r["shards"], {}))
        own.parts[r["shard"]] = (own.size, PerfectHash.unpacked(r["sizes"], r["bits"], pa.array(r["keys"], pa.binary()), r["placed"]))
        own.size += len(r["keys"])
    return out


def _recount(carried, folded: np.ndarray, inside: np.ndarray, most: int):
    """Task of one pass: occurrences of the carried terms, added up in dense slots per group until ``most`` are held."""
    def run(batches):
        languages = _languages(carried.value)
        terms_of = {lang: known.terms() for lang, known in languages.items()}
        dense: dict[tuple[str, str], np.ndarray] = {}

        def emit():
            for (lang, source), counts in dense.items():
                slot = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slot), pa.string()), pa.array([source] * len(slot), pa.string()), terms_of[lang].take(pa.array(slot)), pa.array(counts[slot])],
                                                 ["lang", "source", "term", "n"])

        for part in text_slices(batches, "text", 4 << 20):
            terms, number, row = slice_terms(part.column("text"), folded, inside)
            if not len(terms):
                continue
            hashes, width = key_hashes(terms), len(terms)
            groups = pa.StructArray.from_arrays([part.column("lang"), part.column("source")], ["lang", "source"]).to_pylist()
            numbers = {g: i for i, g in enumerate(dict.fromkeys((g["lang"], g["source"]) for g in groups))}
            of = np.array([numbers[g["lang"], g["source"]] for g in groups], np.int64)
            pair, n = np.unique(of[row] * width + number, return_counts=True)
            group, term = pair // width, pair % width
            for lang in dict.fromkeys(lang for lang, _ in numbers):
                if lang not in languages:
                    continue
                mine = [g for g in numbers if g[0] == lang]
                used = np.unique(term[np.isin(group, [numbers[g] for g in mine])])
                slot = np.full(width, -1, np.int64)
                slot[used] = languages[lang].slots(terms.take(pa.array(used)), hashes[used])
                for g in mine:
                    if g not in dense:
                        if dense and sum(map(len, dense.values())) + languages[lang].size > most:
                            yield from emit()
                            dense.clear()
                        dense[g] = np.zeros(languages[lang].size, np.int64)
                    own = slice(*np.searchsorted(group, [numbers[g], numbers[g] + 1]))
                    at, times = slot[term[own]], n[own]
                    dense[g][at[at >= 0]] += times[at >= 0]
        yield from emit()

    return run


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def term_counts(rows: DataFrame, kept: DataFrame, shard_terms: int = SHARD_TERMS, pass_bytes: int = PASS_BYTES, held_slots: int = HELD_SLOTS) -> DataFrame:
    """(lang, source, term, n): occurrences of the kept terms in each group that has any.

    Shards are taken in passes of at most ``pass_bytes`` (one shard at least, of ``shard_terms`` terms on average), and
    only those travel, so neither the driver nor a task holds more however many terms are kept.
    """
    spark = rows.sparkSession
    shards = kept.groupBy("lang").agg(F.ceil(F.count("*") / shard_terms).cast("int").alias("shards"))
    dealt = kept.join(shards, "lang").withColumn("shard", F.pmod(F.crc32("term"), "shards").cast("int"))
    built = _written(dealt.select("lang", "term", "shard", "shards").groupBy("lang", "shard").applyInArrow(_hashed, SHARD_ROWS), "term-hashes")
    passes: list[list] = []
    held = pass_bytes
    for r in built.select("lang", "shard", "n_bytes").orderBy("lang", "shard").toLocalIterator():
        if held + r["n_bytes"] > pass_bytes:
            passes.append([])
            held = 0
        passes[-1].append((r["lang"], r["shard"]))
        held += r["n_bytes"]
    out = spark.createDataFrame([], "lang string, source string, term binary, n long")
    for one in passes:
        # a pass holds neighbours in (lang, shard) order
        place = F.struct("lang", "shard")
        bound = [F.struct(F.lit(x[0]).alias("lang"), F.lit(x[1]).cast("int").alias("shard")) for x in (one[0], one[-1])]
        carried = spark.sparkContext.broadcast(built.filter((place >= bound[0]) & (place <= bound[1])).drop("n_bytes").collect())
        counted = rows.mapInArrow(_recount(carried, byte_table(), term_bytes(), held_slots), "lang string, source string, term binary, n long")
        out = out.unionByName(counted)
    return out.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def smoothed(count, total, terms):
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * terms)) in whole numbers of any size."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(20,0)")
    return F.when(terms > 0, F.lit(1) + F.call_function("div", top, (total + PRIOR * terms).cast("decimal(20,0)"))).otherwise(F.lit(0)).cast("long")


def _tile(key, counted: pa.Table, groups: pa.Table) -> pa.Table:
    """Distances between the sources of two blocks over the terms of one bucket that any of them holds."""
    _, low, high, _ = (k.as_py() for k in key)
    number, zero, block = (groups[c].to_numpy() for c in ("_number", "_zero", "_block"))
    order = np.argsort(number, kind="stable")
    number, zero, block = number[order], zero[order], block[order]
    terms = counted["term"].combine_chunks().dictionary_encode()
    dense = np.repeat(zero[:, None], len(terms.dictionary), axis=1)
    dense[np.searchsorted(number, counted["number"].to_numpy()), terms.indices.to_numpy()] = counted["p"].to_numpy()
    rows = []
    right = np.flatnonzero(block == high)
    for i in np.flatnonzero(block == low):
        far = np.abs(dense[right] - dense[i]).sum(axis=1)
        rows += [(int(number[i]), int(number[j]), int(f)) for j, f in zip(right, far) if low != high or i < j]
    a, b, f = zip(*rows) if rows else ((), (), ())
    n = len(rows)
    return pa.table({"lang": pa.array([key[0].as_py()] * n, pa.string()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "value": pa.array(f, pa.int64()), "seen": pa.array([len(terms.dictionary)] * n, pa.int64())})


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS,
                      shard_terms: int = SHARD_TERMS, pass_bytes: int = PASS_BYTES, held_slots: int = HELD_SLOTS, tile_sources: int = TILE_SOURCES, tile_terms: int = TILE_TERMS) -> DataFrame:
    """Per (lang, source): its distance to every other source of the language (``part`` 'pair') and the terms that it
    uses more than the language does ('term', the ``top`` first): lang, source, part, item, value, rank.

    Nulls are empty texts. A term kept is one in ``least_docs`` documents of its language; a group's share of a term
    is ``smoothed``. Ranks go by falling value, then by the bytes of the item. A language without kept terms has pairs
    of value 0 and no terms; one with a single source has no pairs; an empty table gives an empty result. Repeated
    rows are documents of their own; columns beside those named are not read.
    """
    rows = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    kept = _written(frequent_terms(rows.select("lang", "text"), least_docs), "kept-terms")
    counts = _written(term_counts(rows, kept, shard_terms, pass_bytes, held_slots), "term-counts")
    groups = rows.select("lang", "source").distinct()
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = (groups.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["terms", "total"]).withColumn("number", number.cast("long"))
              .withColumn("block", F.floor(F.col("number") / tile_sources).cast("long")).withColumn("zero", smoothed(F.lit(0), F.col("total"), F.col("terms"))))
    groups = _written(groups, "term-groups")
    blocks = groups.groupBy("lang").agg((F.max("block") + 1).alias("blocks"), F.greatest(F.ceil(F.max("terms") / tile_terms), F.lit(1)).cast("int").alias("buckets"))
    shares = counts.join(groups.select("lang", "source", "number", "block", "total", "terms"), ["lang", "source"]).withColumn("p", smoothed(F.col("n"), F.col("total"), F.col("terms")))

    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("_other")
    tile = [F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high")]
    left = (shares.select("lang", "term", "number", "block", "p").join(blocks, "lang").withColumn("bucket", F.pmod(F.crc32("term"), "buckets").cast("int"))
            .select("lang", "term", "number", "block", "p", "bucket", other).select("lang", *tile, "bucket", "term", "number", "p"))
    right = (groups.select("lang", "number", "block", "zero").join(blocks, "lang").select("lang", "number", "block", "zero", "buckets", other)
             .select(F.col("lang").alias("_lang"), *(t.alias(f"_{n}") for t, n in zip(tile, ("low", "high"))), F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("_bucket"),
                     *(F.col(c).alias(f"_{c}") for c in ("number", "block", "zero"))))
    tiles = left.groupBy("lang", "low", "high", "bucket").cogroup(right.groupBy("_lang", "_low", "_high", "_bucket")).applyInArrow(_tile, "lang string, a long, b long, value long, seen long")
    summed = tiles.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    one = groups.select("lang", "number", "source", "zero", "terms")
    named = (summed.join(one.select("lang", F.col("number").alias("a"), F.col("source").alias("of_a"), F.col("zero").alias("zero_a"), "terms"), ["lang", "a"])
             .join(one.select("lang", F.col("number").alias("b"), F.col("source").alias("of_b"), F.col("zero").alias("zero_b")), ["lang", "b"])
             .withColumn("value", F.col("value") + (F.col("terms") - F.col("seen")) * F.abs(F.col("zero_a") - F.col("zero_b"))))
    both = F.explode(F.array(F.struct(F.col("of_a").alias("source"), F.col("of_b").alias("item")), F.struct(F.col("of_b").alias("source"), F.col("of_a").alias("item")))).alias("_of")
    pairs = named.select("lang", "value", both).select("lang", "_of.source", F.lit("pair").alias("part"), "_of.item", "value")

    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    whole = whole.join(sizes, "lang").join(totals.groupBy("lang").agg(F.sum("total").alias("total")), "lang").select("lang", "term", smoothed(F.col("n"), F.col("total"), F.col("terms")).alias("q"))
    terms = (shares.join(whole, ["lang", "term"]).filter(F.col("p") > F.col("q"))
             .select("lang", "source", F.lit("term").alias("part"), F.decode("term", "UTF-8").alias("item"), (F.col("p") - F.col("q")).alias("value")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [part.withColumn("rank", F.row_number().over(order).cast("int")) for part in (pairs, terms)]
    return ranked[0].unionByName(ranked[1].filter(F.col("rank") <= top))
