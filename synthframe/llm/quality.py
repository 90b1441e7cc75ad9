"""Quality rules by compression bands.

Text that repeats itself compresses too well, noise hardly at all. The zstandard ratio (compressed bytes
over bytes) of the whole document and of fixed chunks must lie inside a band that depends on the length,
because short texts always compress worse. The bands of whole documents are fitted to the corpus: for each half
octave of lengths the median ratio and its spread, from exact counts over all texts that pass the base rule.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
import zstandard
from pyspark.sql import DataFrame

from .texts import text_slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")


@dataclass(frozen=True)
class Band:
    """Allowed ratios for texts of up to ``max_bytes`` bytes."""

    max_bytes: int
    low: float
    high: float


@dataclass(frozen=True)
class CompressionRules:
    """Parameters of the compression bands.

    ``document``: bands over whole texts, by length, the last without a bound in practice. ``chunk_bytes``:
    texts longer than this are also cut into chunks of this many bytes (a shorter rest joins the last
    chunk); ``chunk`` is their band, and a text fails if more than ``max_bad_chunks`` of its chunks, as a
    share, lie outside.
    """

    level: int = 3
    document: tuple[Band, ...] = (
        Band(128, 0.0, 1.6), Band(512, 0.25, 1.2), Band(2048, 0.2, 0.85), Band(16384, 0.15, 0.75), Band(1 << 62, 0.08, 0.7))
    chunk_bytes: int = 4096
    chunk: Band = Band(8192, 0.15, 0.75)
    max_bad_chunks: float = 0.25


#: Length classes per doubling of the length; texts that a class must hold to have limits of its own; steps of a ratio
#: that are counted apart; robust deviations from the median that are allowed below and above.
CLASSES, LEAST_TEXTS, RATIO_STEPS, BELOW, ABOVE = 2, 20, 1000, 3.5, 6.0


def length_class(n_bytes: int) -> int:
    """Half octave of a length: the largest c with 2 ** (c / CLASSES) <= n_bytes."""
    c = int(math.log2(n_bytes) * CLASSES)
    while 2 ** ((c + 1) / CLASSES) <= n_bytes:
        c += 1
    while 2 ** (c / CLASSES) > n_bytes:
        c -= 1
    return c


def robust_limits(counts: dict[int, int], below: float = BELOW, above: float = ABOVE) -> tuple[float, float]:
    """Limits around the median of some counted ratios (in steps), in robust deviations (1.4826 times the median distance from it)."""
    def median(of: dict[int, int]) -> int:
        left = (sum(of.values()) - 1) // 2
        for value in sorted(of):
            left -= of[value]
            if left < 0:
                return value
        raise ValueError("nothing to rank")

    middle = median(counts)
    distance: Counter = Counter()
    for value, n in counts.items():
        distance[abs(value - middle)] += n
    spread = 1.4826 * max(median(distance), 1)
    return (middle - below * spread) / RATIO_STEPS, (middle + above * spread) / RATIO_STEPS


def fit_bands(docs: DataFrame, rules: CompressionRules = CompressionRules(), text_col: str = "text") -> CompressionRules:
    """``rules`` with bands of whole documents fitted to ``docs``.

    One pass counts the ratios of all texts that pass the base rule, in thousandths, per half octave of their length; the
    counts (a few thousand numbers, whatever the table's size) give medians and spreads. A class of fewer than
    ``LEAST_TEXTS`` texts, and every length of an empty table, keeps the limits of ``rules``.
    """
    def run(batches):
        compress = zstandard.ZstdCompressor(level=rules.level).compress
        for part in text_slices(batches, "_text"):
            found: Counter = Counter()
            for text in part.column("_text").to_pylist():
                if text and not base_failed(*text_statistics(text)):
                    data = text.encode()
                    found[length_class(len(data)), round(RATIO_STEPS * len(compress(data)) / len(data))] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.int32()), pa.array(list(found.values()), pa.int64())], ["length", "ratio", "n"])

    counted = docs.select(F.col(f"`{text_col}`").alias("_text")).mapInArrow(run, "length int, ratio int, n long").groupBy("length", "ratio").agg(F.sum("n").alias("n")).collect()
    classes: dict[int, dict[int, int]] = {}
    for row in counted:
        classes.setdefault(row["length"], {})[row["ratio"]] = row["n"]
    own = {c: robust_limits(counts) for c, counts in classes.items() if sum(counts.values()) >= LEAST_TEXTS}
    bands, last = [], -1
    for edge in sorted({math.ceil(2 ** ((c + e) / CLASSES)) - 1 for c in own for e in (0, 1)} | {b.max_bytes for b in rules.document}):
        if edge <= last or edge < 1:
            continue
        band = next(b for b in rules.document if edge <= b.max_bytes)
        fitted = own.get(length_class(edge))
        bands.append(Band(edge, *fitted) if fitted else Band(edge, band.low, band.high))
        last = edge
    return replace(rules, document=tuple(bands))


def _chunks(data: bytes, size: int) -> Iterator[bytes]:
    n = max(1, len(data) // size)
    for i in range(n):
        yield data[i * size : (i + 1) * size if i < n - 1 else len(data)]


def compression_verdict(data: bytes, rules: CompressionRules, compress) -> tuple[float, float, float, bool]:
    """Whole ratio, lowest and highest chunk ratio, and whether all bands hold. An empty text has ratio 0 and fails none."""
    if not data:
        return 0.0, 0.0, 0.0, True
    whole = len(compress(data)) / len(data)
    band = next(b for b in rules.document if len(data) <= b.max_bytes)
    good = band.low <= whole <= band.high
    if len(data) <= rules.chunk_bytes:
        return whole, whole, whole, good
    ratios = [len(compress(c)) / len(c) for c in _chunks(data, rules.chunk_bytes)]
    bad = sum(not rules.chunk.low <= r <= rules.chunk.high for r in ratios)
    return whole, min(ratios), max(ratios), good and bad <= rules.max_bad_chunks * len(ratios)


def repeated_window_words(words: list, width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    if len(words) <= width:
        return 0
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    total, covered = 0, 0
    for start, window in enumerate(windows):
        if seen[window] > 1:
            total += start + width - max(covered, start)
            covered = start + width
    return total


def text_statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)] if "\n" in text else ()
    return (len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), len(lines) - len(set(lines)),
            repeated_window_words(words))


def base_failed(n_words: int, word_chars: int, n_symbols: int, n_dup_lines: int, n_repeat_words: int) -> bool:
    """Too few words, or more than a fifth of them in repeated windows."""
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("ratio", "chunk_ratio_min", "chunk_ratio_max")


def quality_columns(texts: list[str], rules: CompressionRules) -> dict[str, list]:
    """Statistics, ratios and verdicts of some texts (no nulls), by column name."""
    compress = zstandard.ZstdCompressor(level=rules.level).compress
    out: dict[str, list] = {n: [] for n in (*STATISTICS, *RATIOS, "base_failed", "kept")}
    for text in texts:
        stats = text_statistics(text)
        *ratios, good = compression_verdict(text.encode(), rules, compress)
        failed = base_failed(*stats)
        for name, value in zip(out, (*stats, *ratios, failed, good and not failed)):
            out[name].append(value)
    return out


SCHEMA = ", ".join([*(f"{n} long" for n in STATISTICS), *(f"{n} double" for n in RATIOS), "base_failed boolean, kept boolean"])


def quality_report(docs: DataFrame, rules: CompressionRules = CompressionRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, counts, compression ratios, ``base_failed`` and ``kept``.

    A null or empty text has no words and so fails the base rule. Repeated rows are judged one by one; other
    columns are not read. Narrow: nothing is shuffled, and a task holds a few MB of text at once.
    """
    def run(batches):
        for part in text_slices(batches, "_text"):
            made = quality_columns([t or "" for t in part.column(1).to_pylist()], rules)
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, made.values())], [id_col, *made])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")


def keep_quality(docs: DataFrame, rules: CompressionRules = CompressionRules(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text passes, with all their columns.

    A null or empty text goes; repeated rows are judged one by one; an empty table gives an empty result.
    """
    def run(batches):
        # the text is looked at inside its row: it crosses to the task once
        named = (pa.RecordBatch.from_arrays([b.column(0), pc.struct_field(b.column(0), [at])], ["_row", "_text"]) for b in batches)
        for part in text_slices(named, "_text", 4 << 20):
            made = quality_columns([t or "" for t in part.column("_text").to_pylist()], rules)
            yield part.select(["_row"]).filter(pa.array(made["kept"], pa.bool_()))

    at = docs.columns.index(text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    kept = rows.mapInArrow(run, rows.schema)
    return kept.select(*[F.col(f"_row.`{c}`") for c in docs.columns])
