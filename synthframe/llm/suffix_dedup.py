"""Exact substring deduplication with suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts elsewhere is removed. The work is laid
out so that nothing grows with the square of anything and no task holds an unbounded group:

1. Equal texts become one, with their number.
2. Every window of ``length`` bytes has an anchor: the smallest hash of a ``GRAM``-byte string inside it.
   Equal windows have equal anchors, so a window whose anchor occurs once cannot repeat. Windows in a row
   with one anchor form a piece; only pieces whose anchor occurs twice go on, equal ones as one.
3. Pieces are sharded by anchor. A shard builds its suffix array (Larsson-Sadakane) and common prefixes
   (Kasai); windows in a run of prefixes of ``length`` or more are repeated.
4. An anchor with very many pieces is spread over several shards. Each of these sends its windows as sorted
   runs of digests, cut by digest range, and a run is merged with the others of its range by binary search.
5. Repeated windows are laid over their texts and cut out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame

from .suffix_arrays import common_prefixes, packed_words, suffix_array
from .texts import joined, text_slices
from .words import mixed, span_hashes

LENGTH = 200
#: Bytes whose hash makes an anchor.
GRAM = 32
#: Window starts looked at together.
CHUNK = 1 << 20
#: Windows of one piece at most; longer runs are several pieces.
MOST_WINDOWS = 256
#: Bytes of pieces after which a suffix array is closed, and pieces of one anchor in one shard.
SHARD_BYTES, SHARD_PIECES = 1 << 20, 2000


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes at each position (a power of two), by doubling."""
    h, width = data.astype(np.uint64) + np.uint64(1), 1
    factor = 0x9E3779B97F4A7C15
    while width < GRAM:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = (factor * factor + 2 * width) | 1, width * 2
        factor &= (1 << 64) - 1
    return mixed(h)


def windows_with_anchor(data: np.ndarray, length: int = LENGTH):
    """Pieces of some bytes, a part at a time: first windows, numbers of windows, anchor hashes, whether the
    anchor stands at several places of its run; then the part's bytes and where it begins."""
    for low in range(0, len(data) - length + 1, CHUNK):
        part = data[low : low + CHUNK + length - 1]
        hashes = gram_hashes(part)
        value = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
        span, width = length - GRAM + 1, 1
        while width * 2 <= span:  # smallest of the next `width` values, doubled
            value = np.minimum(value[:-width], value[width:])
            width *= 2
        if span > width:
            value = np.minimum(value[: len(value) - (span - width)], value[span - width :])
        # the same hash at another place is the same anchor: periodic text gives one run, not one per period
        first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
        anchor = hashes[(value[first] & np.uint64(0xFFFFFF)).astype(np.int64)]
        new = np.concatenate(([True], anchor[1:] != anchor[:-1]))
        several = np.add.reduceat(np.ones(len(first), np.int64), np.flatnonzero(new)) > 1
        first, anchor = first[new], anchor[new]
        count = np.diff(np.concatenate((first, [len(value)])))
        parts = -(-count // MOST_WINDOWS)
        step = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * MOST_WINDOWS
        yield low + np.repeat(first, parts) + step, np.minimum(np.repeat(count, parts) - step, MOST_WINDOWS), np.repeat(anchor, parts), np.repeat(several, parts), part, low


def _within_texts(first: np.ndarray, count: np.ndarray, bounds: np.ndarray, length: int):
    """Runs of windows over joined texts, cut where a text ends: (run, text, first window, windows)."""
    ends = bounds[1:]
    run, last, text = np.arange(len(first)), first + count, np.searchsorted(ends, first, side="right")
    out = []
    while len(run):
        stop = np.minimum(last, ends[text] - length + 1)
        ok = stop > first
        out.append((run[ok], text[ok], first[ok], (stop - first)[ok]))
        over = last > ends[text]
        run, last, first, text = run[over], last[over], ends[text[over]], text[over] + 1
    return (np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


def _anchors(length: int):
    """Task: texts to pieces. ``at`` packs the windows less one (8 bits), the first window, and on top whether
    the anchor stands at several places of its run."""
    def run(batches):
        for part in text_slices(batches, "text"):
            data, bounds = joined(part.column("text"))
            keys = part.column("text_key").to_numpy()
            for first, count, anchor, several, chunk, low in windows_with_anchor(data, length):
                which, text, start, count = _within_texts(first, count, bounds, length)
                pieces = span_hashes(chunk, start - low, start - low + count + length - 1)
                at = (several[which].astype(np.uint64) << np.uint64(63)) | ((start - bounds[text]).astype(np.uint64) << np.uint64(8)) | (count - 1).astype(np.uint64)
                size = (bounds[1:] - bounds[:-1])[text]
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)) for v in (anchor[which], pieces, keys[text], size, at)], ["anchor", "piece", "text_key", "n_bytes", "at"])

    return run


def _cut_pieces(length: int):
    """Task: one row per text with the pieces wanted from it, to one row per piece with its bytes."""
    def run(batches):
        for batch in batches:
            for part in text_slices([batch], "text", 4 << 20):
                data, bounds = joined(part.column("text"))
                wanted = part.column("wanted")
                flat = wanted.flatten()
                row = np.repeat(np.arange(len(wanted)), np.diff(wanted.offsets.to_numpy()))
                at = flat.field("at").to_numpy().view(np.uint64)
                start = bounds[row] + ((at >> np.uint64(8)) & np.uint64((1 << 55) - 1)).astype(np.int64)
                end = start + (at & np.uint64(0xFF)).astype(np.int64) + length
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [flat.field(n) for n in ("anchor", "piece", "copies", "spread")] + [pa.array([raw[a:b] for a, b in zip(start.tolist(), end.tolist())], pa.binary())],
                    ["anchor", "piece", "copies", "spread", "bytes"])

    return run


def window_classes(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Valid windows of some pieces in suffix order, and the number of their class; equal windows are one class."""
    words = packed_words(data, length)
    sa = suffix_array(words[: len(data)], 8)
    shared = common_prefixes(words, len(data), sa, length)
    classes = np.cumsum(shared < length)
    piece = np.searchsorted(bounds, sa, side="right") - 1
    valid = sa + length <= bounds[piece + 1]
    return sa[valid], classes[valid]


def _runs(offsets: np.ndarray) -> list[dict]:
    """Sorted numbers as runs of consecutive ones."""
    cut = np.flatnonzero(np.diff(offsets) > 1)
    return [{"start": int(a), "end": int(b) + 1} for a, b in zip(offsets[np.concatenate(([0], cut + 1))], offsets[np.concatenate((cut, [len(offsets) - 1]))])]


REPEATED = "anchor long, piece long, runs array<struct<start:int,end:int>>"


def _shard(length: int, spread: bool):
    """Task: pieces sorted by shard to repeated windows and, of spread anchors, sorted digest runs."""
    def run(batches):
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("anchor", "piece", "copies", "bytes", "shard", "spread"))):
                if held and (row[0], row[4]) != last and (spread or size >= SHARD_BYTES):
                    yield emit(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[3]), (row[0], row[4])
        if held:
            yield emit(held)

    def emit(held):
        data = np.frombuffer(b"".join(r[3] for r in held), np.uint8)
        bounds = np.cumsum([0, *(len(r[3]) for r in held)])
        where, classes = window_classes(data, bounds, length)
        piece = np.searchsorted(bounds, where, side="right") - 1
        # windows of different anchors are never equal, so a class lies within one anchor
        weight = np.bincount(classes, weights=np.array([r[2] for r in held])[piece])[classes]
        decided = _repeated_rows(held, piece, where - bounds[piece], weight > 1)
        if not spread:
            return _batch(decided)
        # one entry per class: a class that is decided here only tells other shards of its digest
        first = np.flatnonzero(np.concatenate(([True], classes[1:] != classes[:-1])))
        raw = data.tobytes()
        digest = np.array([xxhash.xxh3_128_digest(raw[w : w + length]) for w in where[first].tolist()], "V16")
        order = np.argsort(_leading(digest), kind="stable")
        digest, first = digest[order], first[order]
        ids = np.array([r[1] for r in held], np.int64)[piece[first]]
        offset = np.where(weight[first] > 1, -1, (where - bounds[piece])[first])
        ranges = held[0][5]
        cuts = np.searchsorted(_range_of(digest, ranges), np.arange(ranges + 1))
        runs = [(held[0][0], r, None, None, *(v[a:b].tobytes() for v in (digest, ids, offset))) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        return _batch([(anchor, held[0][4] % ranges, piece, runs, None, None, None) for anchor, _, piece, runs, *_ in decided] + runs)

    return run


def _leading(digest: np.ndarray) -> np.ndarray:
    """The first 8 bytes of each digest as a number."""
    return digest.view(np.uint8).reshape(-1, 16)[:, :8].copy().view(">u8").ravel().astype(np.uint64)


def _range_of(digest: np.ndarray, ranges: int) -> np.ndarray:
    return ((_leading(digest) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in _SHARD_TYPES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SHARD_TYPES.values())], list(_SHARD_TYPES))


def _repeated_rows(held, piece, offset, repeated) -> list[tuple]:
    piece, offset = piece[repeated], offset[repeated]
    order = np.lexsort((offset, piece))
    own, first = np.unique(piece[order], return_index=True)
    return [(held[i][0], None, held[i][1], _runs(part), None, None, None) for i, part in zip(own, np.split(offset[order], first[1:]))]


_RUNS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_SHARD_TYPES = {"anchor": pa.int64(), "range": pa.int32(), "piece": pa.int64(), "runs": _RUNS, "digests": pa.binary(), "pieces": pa.binary(), "offsets": pa.binary()}
SHARD_ROWS = f"{REPEATED}, digests binary, pieces binary, offsets binary".replace("piece long", "range int, piece long")


def _merge(batches):
    """Task: the sorted runs of each digest range of an anchor to repeated windows; decided rows pass through.

    Rows come sorted by (anchor, range). A run of a shard holds a digest once, so a digest found in two runs
    repeats; each run is looked up in the others by binary search.
    """
    current, runs = None, []

    def emit():
        table = np.sort(np.concatenate([_leading(r[0]) for r in runs]))
        rows = []
        for digest, piece, offset in runs:
            key = _leading(digest)
            near = np.searchsorted(table, key, side="right") - np.searchsorted(table, key, side="left") > 1
            open_ = np.flatnonzero(near & (offset >= 0))
            rows += [(digest[i].tobytes(), int(piece[i]), int(offset[i])) for i in open_]
        # the 8 leading bytes agree; the whole digest decides
        others: dict[bytes, int] = {}
        wanted = {r[0] for r in rows}
        for digest, _, _ in runs:
            for d in map(bytes, digest):
                if d in wanted:
                    others[d] = others.get(d, 0) + 1
        return _batch([(current[0], None, p, [{"start": o, "end": o + 1}], None, None, None) for d, p, o in rows if others[d] > 1])

    for batch in batches:
        for anchor, range_, piece, found, *blobs in zip(*(batch.column(n).to_pylist() for n in _SHARD_TYPES)):
            if current != (anchor, range_):
                if runs:
                    yield emit()
                current, runs = (anchor, range_), []
            if piece is not None:
                yield _batch([(anchor, None, piece, found, None, None, None)])
            else:
                runs.append(tuple(np.frombuffer(b, t) for b, t in zip(blobs, ("V16", "i8", "i8"))))
    if runs:
        yield emit()


def _remove(length: int, whole_characters: bool):
    """Task: texts and their repeated windows to what is left of them."""
    def run(batches):
        for batch in batches:
            for part in text_slices([batch], "text", 4 << 20):
                out = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
                for text, copies, spans in zip(part.column("text").to_pylist(), part.column("copies").to_pylist(), part.column("spans").to_pylist()):
                    data = text.encode()
                    ranges = [(0, len(data))] if copies > 1 and len(data) >= length else _covered(spans or [], length)
                    kept = _without(data, ranges)
                    for name, value in zip(out, (len(data), len(data) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest(),
                                                 _without(data, [_shrunk(data, a, b) for a, b in ranges]).decode() if whole_characters else None)):
                        out[name].append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("text_key"), *(pa.array(v, t) for v, t in zip(out.values(), kinds))], ["text_key", *out])

    return run


def _covered(spans: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by windows that start in ``spans``."""
    out: list[tuple[int, int]] = []
    for span in sorted((s["start"], s["end"]) for s in spans):
        a, b = span[0], span[1] - 1 + length
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _without(data: bytes, ranges: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in ranges:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def _shrunk(data: bytes, a: int, b: int) -> tuple[int, int]:
    """The range without characters that it holds in part."""
    while a < b and data[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def repeated_substrings(docs: DataFrame, text_col: str = "text", length: int = LENGTH, whole_characters: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, cuts): ``docs`` with its other columns in ``_row``, ``_none`` (the text is null) and ``text_key``; and per distinct text its ``text_key``,
    ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept`` (text, if ``whole_characters``: ranges
    are then narrowed to whole characters, so that it is valid UTF-8; else null).

    A null text is empty. Texts under ``length`` bytes hold no window and stay as they are; equal texts of
    ``length`` bytes or more are removed wholly, as is any text that stands twice in the table. An empty table gives
    empty results.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*own or [F.lit(0).alias("none")]).alias("_row"), F.col(f"`{text_col}`").isNull().alias("_none"), F.xxhash64(text).alias("text_key"), F.octet_length(text).cast("long").alias("n_bytes"))
    # Every use below takes all columns of this table, so that its shuffle is made once and read three times.
    texts = (docs.select(F.xxhash64(text).alias("text_key"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
             .groupBy("text_key", "n_bytes").agg(F.first("text").alias("text"), F.count("*").alias("copies")))
    found = texts.mapInArrow(_anchors(length), "anchor long, piece long, text_key long, n_bytes long, at long")
    # Said here once, so that both uses of the join below plan the same shuffle and share it.
    found = found.filter("anchor IS NOT NULL AND piece IS NOT NULL AND text_key IS NOT NULL AND n_bytes IS NOT NULL")
    often = found.groupBy("anchor").agg(F.sum(F.when(F.col("at") < 0, 2).otherwise(1)).alias("_n")).filter("_n > 1")
    again = found.join(often, "anchor")
    pieces = again.groupBy("anchor", "piece").agg(F.count("*").alias("copies"), F.first("text_key").alias("text_key"), F.first("n_bytes").alias("n_bytes"), F.first("at").alias("at"),
                                                  F.ceil(F.first("_n") / SHARD_PIECES).cast("int").alias("spread"))
    wanted = pieces.groupBy("text_key", "n_bytes").agg(F.collect_list(F.struct("anchor", "piece", "copies", "spread", "at")).alias("wanted"))
    cut = texts.join(wanted, ["text_key", "n_bytes"]).mapInArrow(_cut_pieces(length), "anchor long, piece long, copies long, spread int, bytes binary")
    few = (cut.filter("spread = 1").withColumn("shard", F.lit(0)).repartition("anchor").sortWithinPartitions("anchor", "piece")
           .mapInArrow(_shard(length, False), SHARD_ROWS))
    many = (cut.filter("spread > 1").withColumn("shard", F.pmod("piece", "spread").cast("int")).repartition("anchor", "shard").sortWithinPartitions("anchor", "shard", "piece")
            .mapInArrow(_shard(length, True), SHARD_ROWS).repartition("anchor", "range").sortWithinPartitions("anchor", "range").mapInArrow(_merge, SHARD_ROWS))
    repeated = few.unionByName(many).select("anchor", "piece", "runs")
    start = F.shiftright("at", 8).bitwiseAND(F.lit((1 << 55) - 1))
    spans = (again.join(repeated, ["anchor", "piece"])
             .select("text_key", "n_bytes", F.explode("runs").alias("run"), start.alias("_from"))
             .groupBy("text_key", "n_bytes").agg(F.collect_list(F.struct((F.col("_from") + F.col("run.start")).alias("start"), (F.col("_from") + F.col("run.end")).alias("end"))).alias("spans")))
    cuts = (texts.join(spans, ["text_key", "n_bytes"], "left")
            .mapInArrow(_remove(length, whole_characters), "text_key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"))
    return rows, cuts


def removal_report(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per input row its other columns, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``; columns of these names are replaced."""
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256")
    rows, cuts = repeated_substrings(docs, text_col, length)
    own = [F.col(f"_row.`{c}`") for c in docs.columns if c != text_col]
    return rows.join(cuts, ["text_key", "n_bytes"]).select(*own, "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes cut out of the text, whole characters only; null texts stay null."""
    rows, cuts = repeated_substrings(docs, text_col, length, whole_characters=True)
    kept = F.when(~F.col("_none"), F.col("kept")).alias(text_col)
    return rows.join(cuts, ["text_key", "n_bytes"]).select(*[kept if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns])
