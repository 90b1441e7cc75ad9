"""Benchmark decontamination with suffix arrays over the words of the training texts.

Each slice of a partition is one shard: its words become numbers (a word that no test item holds is 0 and
cannot match), a suffix array orders the positions of known words, and every suffix of every test item is
binary-searched in it, one word deeper at a time, until the interval is empty: the depth reached is its
longest verbatim match, the interval its locations. Nothing is shuffled; only the test items travel.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..session import scratch_path
from .suffix_arrays import narrow, suffix_array
from .texts import joined, text_slices
from .words import byte_table, word_bounds, word_hashes

WINDOW = 13
#: Bytes of test items that travel to the tasks at once; larger sets take several passes over the shards.
BLOCK_BYTES = 16 << 20
#: Text bytes of one shard.
SHARD_BYTES = 6 << 20


@dataclass
class TestItems:
    """Suffixes of some test items: word hashes, numbers, and where each suffix lies."""

    ids: list
    vocabulary: np.ndarray  # sorted word hashes; number = index + 1
    symbols: np.ndarray  # numbers of all items, each followed by a 0
    spelling: list[bytes]  # the words of all items, likewise, b"" behind each
    starts: np.ndarray  # position of each suffix
    ends: np.ndarray  # end of its item
    item: np.ndarray  # index of its item
    need: np.ndarray  # words that make a window there; 0 where no window starts

    @classmethod
    def of(cls, rows: list[tuple], window: int) -> TestItems:
        """``rows``: (item id, text). Items without words have no suffix."""
        spelling, starts, ends, item, need = [], [], [], [], []
        for at, (_, text) in enumerate(rows):
            data = np.frombuffer((text or "").encode().lower(), np.uint8)
            words = [bytes(data[a:b]) for a, b in zip(*word_bounds(data, np.zeros(1, np.int64)))]
            base, n = len(spelling), len(words)
            for i in range(n):
                starts.append(base + i)
                ends.append(base + n)
                item.append(at)
                need.append(window if i + window <= n else n if n < window and i == 0 else 0)
            spelling += [*words, b""]
        data = np.frombuffer(b" ".join(spelling), np.uint8)
        lengths = np.array([len(w) for w in spelling], np.int64)
        begin = np.cumsum(lengths + 1) - lengths - 1
        hashes = word_hashes(data, begin, begin + lengths)
        vocabulary = np.unique(hashes[lengths > 0])
        symbols = np.where(lengths > 0, np.searchsorted(vocabulary, hashes) + 1, 0)
        return cls([r[0] for r in rows], vocabulary, symbols, spelling, *(np.array(v, np.int64) for v in (starts, ends, item, need)))


def shard_matches(data: np.ndarray, doc_starts: np.ndarray, test: TestItems):
    """Hits of one shard.

    Returns word counts per document, and arrays (document, first word, end word, item, longest match of
    the suffix) with one row per occurrence of a window. Words of a window are compared letter by letter.
    """
    begin, end = word_bounds(data, doc_starts)
    doc = np.searchsorted(doc_starts, begin, side="right") - 1
    counts = np.bincount(doc, minlength=len(doc_starts))
    nothing = (counts, *(np.zeros(0, np.int64) for _ in range(5)))
    if not len(begin) or not len(test.starts):
        return nothing
    hashes = word_hashes(data, begin, end)
    bits = np.zeros(1 << 16, bool)
    bits[test.vocabulary & np.uint64(0xFFFF)] = True
    maybe = np.flatnonzero(bits[hashes & np.uint64(0xFFFF)])
    at = np.minimum(np.searchsorted(test.vocabulary, hashes[maybe]), len(test.vocabulary) - 1)
    known = test.vocabulary[at] == hashes[maybe]
    # a 0 between documents keeps matches inside one
    place = np.arange(len(begin)) + doc
    size = int(place[-1]) + 2
    longest_item = int((test.ends - test.starts).max())
    symbols = np.zeros(size + longest_item, np.int64)
    symbols[place[maybe[known]]] = at[known] + 1
    positions = np.flatnonzero(symbols)
    if not len(positions):
        return nothing
    sa = suffix_array(symbols[:size], 1, positions)
    low, high = np.zeros(len(test.starts), np.int64), np.full(len(test.starts), len(sa))
    found_low, found_high, reached = low * 0, low * 0, low * 0
    live, depth = np.arange(len(test.starts)), 0
    while len(live):
        a, b = narrow(symbols, sa, low[live], high[live], depth, test.symbols[test.starts[live] + depth])
        depth += 1
        live, a, b = live[a < b], a[a < b], b[a < b]
        low[live], high[live], reached[live] = a, b, depth
        full = live[test.need[live] == depth]
        found_low[full], found_high[full] = low[full], high[full]
        live = live[test.starts[live] + depth < test.ends[live]]
    rows = found_high - found_low
    hit = np.flatnonzero(rows > 0)
    of = np.repeat(hit, rows[hit])
    inside = np.arange(len(of)) - np.repeat(np.cumsum(rows[hit]) - rows[hit], rows[hit])
    where = sa[found_low[of] + inside]
    word_of = np.zeros(size, np.int64)
    word_of[place] = np.arange(len(begin))
    word = word_of[where]
    ok = np.array([all(data[begin[w + i]:end[w + i]].tobytes() == test.spelling[test.starts[s] + i] for i in range(test.need[s]))
                   for w, s in zip(word.tolist(), of.tolist())], bool)
    word, of = word[ok], of[ok]
    first_word = np.cumsum(counts) - counts
    start = word - first_word[doc[word]]
    return counts, doc[word], start, start + test.need[of], test.item[of], reached[of]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _search(test: TestItems, folded: np.ndarray):
    """Task of one pass: adds the hits of ``test`` to the running columns of each row."""
    def run(batches):
        for batch in batches:
            for part in text_slices([batch], "_text", SHARD_BYTES):
                data, bounds = joined(part.column("_text"))
                counts, doc, start, end, item, reached = shard_matches(folded[data], bounds[:-1], test)
                spans, items = [[(s["start"], s["end"]) for s in v] for v in part.column("spans").to_pylist()], [set(v) for v in part.column("items").to_pylist()]
                longest = part.column("longest_match").to_pylist()
                for d, s, e, i, r in zip(doc.tolist(), start.tolist(), end.tolist(), item.tolist(), reached.tolist()):
                    spans[d].append((s, e))
                    items[d].add(None if test.ids[i] is None else str(test.ids[i]))
                    longest[d] = max(longest[d], r)
                made = {
                    "n_words": pa.array(counts, pa.int64()),
                    "spans": pa.array([[{"start": a, "end": b} for a, b in _merged(v)] for v in spans], part.schema.field("spans").type),
                    "items": pa.array([sorted(v, key=lambda x: x or "") for v in items], pa.list_(pa.string())), "longest_match": pa.array(longest, pa.int64())}
                yield pa.RecordBatch.from_arrays([made.get(n, part.column(n)) for n in part.schema.names], part.schema.names)

    return run


FOUND = ("n_words", "spans", "items", "longest_match", "n_hit")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per input row: the id, ``n_words``, ``spans`` (merged word ranges that windows cover), ``items`` (sorted
    ids as text of the items with a window there), ``longest_match`` (words of the longest verbatim match
    that holds a window) and ``n_hit``.

    Words are runs of ASCII letters and digits and of all characters above, with A-Z folded. A null text
    has no words; an item without words has no window; an item with a null id hits but stands in no list.
    Repeated rows are judged one by one, repeated items count once by id. Other columns are not read. The
    test items, repeated ones once, pass through the driver in blocks of ``block_bytes``, each block a narrow pass over a
    table, so neither what travels nor a plan grows with either table.
    """
    found = _found(docs.select(F.struct(F.col(f"`{id_col}`")).alias("_row"), F.col(f"`{text_col}`").alias("_text")),
                   benchmark.select(F.col(f"`{item_col}`").alias("_item"), F.col(f"`{item_text}`").alias("_text")), window, block_bytes)
    return found.select("_row.*", *FOUND)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                        window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns, whatever their names.

    A null text has no words and stays; repeated rows are judged one by one; without test items all rows stay.
    """
    # the text crosses to the tasks once, beside the other columns
    own = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(0).alias("none")]
    found = _found(docs.select(F.struct(*own).alias("_row"), F.col(f"`{text_col}`").alias("_text")),
                   benchmark.select(F.col(f"`{item_col}`").alias("_item"), F.col(f"`{item_text}`").alias("_text")), window, block_bytes)
    return found.filter(~contaminated()).select(*[F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns])


def _found(rows: DataFrame, items: DataFrame, window: int, block_bytes: int) -> DataFrame:
    spark = rows.sparkSession
    items = items.distinct()
    total = items.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    rows = rows.select("_row", "_text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
                       F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("longest_match"))
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == block)
        test = TestItems.of([tuple(r) for r in part.orderBy("_item", "_text").collect()], window)
        rows = rows.mapInArrow(_search(test, byte_table()), rows.schema)
        if block < blocks - 1:
            # the next pass starts from a table, so that no plan holds more than one block
            path = scratch_path(spark, "decontamination")
            rows.write.parquet(path)
            rows = spark.read.schema(rows.schema).parquet(path)
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return rows.withColumn("items", F.filter("items", lambda x: x.isNotNull())).withColumn("n_hit", covered)


def contaminated() -> Column:
    """A document is contaminated if a twentieth of its words or more are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


