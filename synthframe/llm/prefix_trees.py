"""Repeated word windows from prefix-partitioned suffix trees.

Each word covered by a window of 50 words that also starts in a document with a smaller id is removed.

1. Equal texts become one, with their smallest id.
2. Suffixes are sampled: every window has an anchor, its smallest-hashed string of 8 words, and equal windows have
   theirs at the same place. Windows in a row with one anchor form a piece. Only anchors that stand in two documents
   go on; equal pieces become one, with their smallest id.
3. The suffixes that begin at anchors are partitioned by prefix: first by the 8 words of the anchor. A prefix with more
   pieces than a task should hold is lengthened: the piece's windows are cut into classes by their distance to the
   anchor, and those of a class share 40 words, which become its prefix; what is still too much goes by whole windows,
   where the prefix is the suffix and a minimum per window, combined before the shuffle, says everything.
4. A task builds the subtree of each prefix that it holds: suffixes sorted, common prefixes, internal nodes; likewise
   for the words before the anchor. Two windows are equal if they share a node of the right depth to either side, so
   deep nodes give the maximal repeats, and the smallest id below them says which windows go.
5. Removed windows are laid over their texts and cut out.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame

from ..session import scratch_path
from .texts import joined, text_slices
from .words import mixed, powers, runs_of, span_hashes

WINDOW, GRAM = 50, 8
#: Width of the distance classes of a lengthened prefix.
CLASS = 11
#: Pieces of one prefix in one task, and bytes of words that a task's trees hold at once.
GROUP, TREE_BYTES = 2000, 1 << 20
#: Windows looked at together.
CHUNK = 1 << 20
LAST_ID = (1 << 63) - 1


def word_table() -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    inside = np.ones(256, bool)
    inside[0x20] = inside[0x09:0x0E] = False
    return inside


def anchors(words: np.ndarray, owner: np.ndarray, window: int, gram: int):
    """Pieces of some documents' words, a part at a time: (first window, number of windows, words before the anchor, anchor hash).

    ``words`` are hashes, ``owner`` says whose each one is; windows lie within one owner.
    """
    for low in range(0, len(words) - window + 1, CHUNK):
        part = words[low : low + CHUNK + window - 1]
        own = owner[low : low + CHUNK + window - 1]
        # a string of words hashes alike wherever it stands
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers(0x9E3779B97F4A7C15, len(part)), out=sums[1:])
        back = powers(pow(0x9E3779B97F4A7C15, -1, 1 << 64), len(part))
        hashes = mixed((sums[gram:] - sums[:-gram]) * back[: len(part) - gram + 1])
        value = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
        span, width = window - gram + 1, 1
        while width * 2 <= span:
            value = np.minimum(value[:-width], value[width:])
            width *= 2
        if span > width:
            value = np.minimum(value[: len(value) - (span - width)], value[span - width :])
        at = (value & np.uint64(0xFFFFFF)).astype(np.int64)
        valid = own[: len(at)] == own[window - 1 :]
        new = np.concatenate(([True], (at[1:] != at[:-1]) | ~valid[:-1]))
        first = np.flatnonzero(new & valid)
        ends = np.flatnonzero(valid & np.concatenate((new[1:] | ~valid[1:], [True]))) + 1
        yield low + first, ends - first, at[first] - first, hashes[at[first]]


def _sample(window: int, gram: int):
    """Task: texts to pieces. ``at`` packs the first window, the words before the anchor (8 bits) and the windows less one (8 bits)."""
    inside = word_table()

    def run(batches):
        for part in text_slices(batches, "text", 4 << 20):
            data, bounds = joined(part.column("text"))
            begin, end = runs_of(inside[data], bounds)
            owner = np.searchsorted(bounds[1:], begin, side="right")
            words = span_hashes(data, begin, end)
            first_word = np.searchsorted(owner, np.arange(part.num_rows))
            keys, sizes, ids = (part.column(n).to_numpy() for n in ("text_key", "n_bytes", "id"))
            for first, count, before, anchor in anchors(words, owner, window, gram):
                text = owner[first]
                low, high = (int(first[0]), int(first[-1] + count[-1] + window - 1)) if len(first) else (0, 0)
                piece = span_hashes(words[low:high], first - low, first - low + count + window - 1)
                at = ((first - first_word[text]) << 16) | (before << 8) | (count - 1)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (anchor.view(np.int64), piece.view(np.int64), keys[text], sizes[text], ids[text], at)],
                                                 ["anchor", "piece", "text_key", "n_bytes", "id", "at"])

    return run


def _cut(window: int):
    """Task: texts with the pieces wanted from them, to one row per piece with its words joined by one space."""
    def run(batches):
        for batch in batches:
            for part in text_slices([batch], "text", 4 << 20):
                columns: list[list] = [[], [], [], [], [], [], []]
                for text, wanted in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist()):
                    words = text.encode().split()
                    for w in wanted:
                        first, before, count = w["at"] >> 16, (w["at"] >> 8) & 0xFF, (w["at"] & 0xFF) + 1
                        row = (w["anchor"], w["piece"], w["id"], w["members"], before, count, b" ".join(words[first : first + count + window - 1]))
                        for column, value in zip(columns, row):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                                                 ["anchor", "piece", "id", "members", "before", "count", "words"])

    return run


#: A member of a prefix's group: windows whose anchor stands ``before - count + 1`` to ``before`` words behind their start;
#: ``skipped`` windows of the piece come before them.
MEMBER = "key long, anchor long, piece long, id long, skipped int, before int, count int, words binary"


def _lengthened(window: int, gram: int, width: int):
    """Task: members to one row per distance class, keyed by the words that all windows of the class share."""
    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                words, nearest, farthest = r["words"].split(b" "), r["before"] - r["count"] + 1, r["before"]
                for low in range(nearest - nearest % width, farthest + 1, width):
                    high = min(low + width - 1, window - gram)
                    a, b = max(low, nearest), min(high, farthest)
                    core = b" ".join(words[farthest - low : farthest + window - high])
                    key = xxhash.xxh3_64_intdigest(core, seed=low)
                    rows.append((key - (1 << 64) if key >> 63 else key, r["anchor"], r["piece"], r["id"], r["skipped"] + farthest - b, b, b - a + 1, b" ".join(words[farthest - b : farthest + window - a])))
            columns = list(zip(*rows)) if rows else [[] for _ in range(8)]
            kinds = (*(pa.int64(),) * 4, *(pa.int32(),) * 3, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["key", "anchor", "piece", "id", "skipped", "before", "count", "words"])

    return run


def _windows(window: int):
    """Task: members to one row per window with the digest of its words."""
    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                words = r["words"].split(b" ")
                rows += [(xxhash.xxh3_128_digest(b" ".join(words[w : w + window])), r["anchor"], r["piece"], r["id"], r["skipped"] + w) for w in range(r["count"])]
            columns = list(zip(*rows)) if rows else [[] for _ in range(5)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], ["digest", "anchor", "piece", "id", "skipped"])

    return run


def internal_nodes(shared: np.ndarray) -> np.ndarray:
    """Internal nodes of the suffix tree of some sorted suffixes: rows (depth, depth of the parent, first suffix, end).

    ``shared[i]`` is what suffix i shares with the one before it; ``shared[0]`` is 0.
    """
    open_, nodes = [(0, 0)], []  # (depth, first suffix) from the root down
    for i, depth in enumerate([*shared.tolist()[1:], 0], 1):
        first = i - 1
        while open_[-1][0] > depth:
            deep, first = open_.pop()
            nodes.append((deep, max(depth, open_[-1][0]), first, i))
        if open_[-1][0] < depth:
            open_.append((depth, first))
    return np.array(nodes, np.int64).reshape(-1, 4)


def node_classes(nodes: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Class of each suffix at a depth: the number of the highest node at least so deep, or one of its own."""
    n = len(order)
    out = np.empty(n, np.int64)
    out[order] = np.arange(n)
    if depth <= 0:
        return out * 0
    first, end = nodes[(nodes[:, 0] >= depth) & (nodes[:, 1] < depth)][:, 2:].T
    size = end - first
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - first, size)
    out[order[place]] = np.repeat(first, size)
    return out


def _sorted(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of some rows of symbols and what each shares with the one before it; 0 ends a row."""
    order = np.lexsort(matrix.T[::-1]) if matrix.shape[1] else np.arange(len(matrix))
    rows = matrix[order]
    differ = (rows[1:] != rows[:-1]) | (rows[1:] == 0)
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), matrix.shape[1]) if matrix.shape[1] else np.zeros(max(len(rows) - 1, 0), np.int64)
    return order, np.concatenate(([0], shared))[: len(rows)]


def repeated_windows(words: list[bytes], before: np.ndarray, count: np.ndarray, ids: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Per member and window (``count`` of them, first to last) whether an equal window has a smaller id.

    Words become numbers by value, so windows are compared exactly.
    """
    data = np.frombuffer(b" ".join(words), np.uint8)
    begin, end = runs_of(data != 0x20, np.zeros(1, np.int64))
    offsets = np.concatenate(([0], np.cumsum(end - begin))).astype(np.int32)
    numbers = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[data != 0x20])]).dictionary_encode().indices.to_numpy() + 1
    sizes = count + window - 1
    starts = np.cumsum(sizes) - sizes
    reach = window - gram

    def around(first: np.ndarray, step: int, width: int, room: np.ndarray) -> np.ndarray:
        """``width`` symbols from ``first`` on in direction ``step``, as far as there is room."""
        at = first[:, None] + step * np.arange(width)
        return np.where(np.arange(width) < room[:, None], numbers[np.clip(at, 0, len(numbers) - 1)], 0)

    right, shared_right = _sorted(around(starts + before, 1, window, sizes - before))
    left, shared_left = _sorted(around(starts + before - 1, -1, reach, before))
    trees = internal_nodes(shared_right), internal_nodes(shared_left)
    beaten = np.zeros((len(words), reach + 1), bool)
    for distance in range(reach + 1):
        live = np.flatnonzero((before >= distance) & (before - count < distance))
        if len(live) < 2:
            continue
        key = node_classes(trees[0], right, window - distance)[live] * len(words) + node_classes(trees[1], left, distance)[live]
        order = np.lexsort((ids[live], key))
        new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
        smallest = ids[live][order][new][np.cumsum(new) - 1]
        lost = live[order[smallest < ids[live][order]]]
        beaten[lost, before[lost] - distance] = True
    return beaten


def _trees(window: int, gram: int, limit: int):
    """Task: members sorted by prefix to (anchor, piece, runs of windows that a smaller id holds too)."""
    names = ("anchor", "piece", "id", "skipped", "before", "count", "words")

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for key, *row in zip(*(batch.column(n).to_pylist() for n in ("key", *names))):
                if size >= limit and key != last:
                    yield emit(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[-1]), key
        if held:
            yield emit(held)

    def emit(held):
        anchor, piece, ids, skipped, before, count, words = zip(*held)
        lost = repeated_windows(list(words), np.array(before), np.array(count), np.array(ids), window, gram)
        edge = np.diff(np.pad(lost.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (row, start), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        return pa.RecordBatch.from_arrays([pa.array(np.array(anchor)[row]), pa.array(np.array(piece)[row]), pa.array((np.array(skipped)[row] + start).astype(np.int32)), pa.array((np.array(skipped)[row] + end).astype(np.int32))],
                                          ["anchor", "piece", "start", "end"])

    return run


def _remove(window: int):
    """Task: texts and their removed windows to what is left of them."""
    def run(batches):
        for batch in batches:
            for part in text_slices([batch], "text", 4 << 20):
                out = {n: [] for n in ("n_words", "n_removed", "spans", "kept")}
                for text, runs in zip(part.column("text").to_pylist(), part.column("runs").to_pylist()):
                    words = text.encode().split()
                    spans: list[dict] = []
                    for a, b in sorted((r["start"], r["end"] + window - 1) for r in runs or []):
                        if spans and a <= spans[-1]["end"]:
                            spans[-1]["end"] = max(b, spans[-1]["end"])
                        else:
                            spans.append({"start": a, "end": b})
                    at, kept = 0, []
                    for s in spans:
                        kept += words[at : s["start"]]
                        at = s["end"]
                    kept += words[at:]
                    for name, value in zip(out, (len(words), len(words) - len(kept), spans, b" ".join(kept).decode())):
                        out[name].append(value)
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("text_key"), part.column("n_bytes"), part.column("first_id"), *(pa.array(v, t) for v, t in zip(out.values(), kinds))],
                                                 ["text_key", "n_bytes", "first_id", *out])

    return run


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, group: int = GROUP, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """Per input row its id, ``n_words``, ``n_removed``, ``spans`` (word ranges removed) and ``kept`` (words left, joined by one space).

    Ids are whole numbers; a null id is larger than all others. Rows of one id are one document: their windows do not
    remove each other. A null text has no words. A text of under ``window`` words stays as it is. Other columns are not
    read; an empty table gives an empty result. Texts are told apart by a 64-bit hash and their length, pieces by two
    64-bit hashes; inside a tree, words are compared by value.
    """
    text, id_ = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID))
    key, size = F.xxhash64(text).alias("text_key"), F.octet_length(text).cast("long").alias("n_bytes")
    rows = docs.select(F.struct(F.col(f"`{id_col}`")).alias("_row"), id_.alias("_id"), key, size)
    # every use below takes all columns of this table, so that its shuffle is made once and read three times
    texts = docs.select(key, size, id_.alias("id"), text.alias("text")).groupBy("text_key", "n_bytes").agg(F.first("text").alias("text"), F.min("id").alias("id"))
    found = texts.mapInArrow(_sample(window, gram), "anchor long, piece long, text_key long, n_bytes long, id long, at long")
    found = found.filter("anchor IS NOT NULL AND piece IS NOT NULL AND text_key IS NOT NULL AND n_bytes IS NOT NULL")
    # each table written here is what one side of a join reads as it is, so that a hot key on the other side can be split
    often = _written(found.groupBy("anchor").agg(F.min("id").alias("_low"), F.max("id").alias("_high")).filter("_low < _high").select("anchor"), "window-anchors")
    again = _written(found.join(often, "anchor"), "window-places")
    pieces = _written(again.groupBy("anchor", "piece").agg(F.min("id").alias("id"), F.max("id").alias("last_id"), F.first("text_key").alias("text_key"), F.first("n_bytes").alias("n_bytes"), F.first("at").alias("at")), "window-pieces")
    several = _written(pieces.groupBy("anchor").agg(F.count("*").alias("members")).filter("members > 1"), "window-groups")
    wanted = (pieces.join(several, "anchor").groupBy("text_key", "n_bytes").agg(F.collect_list(F.struct("anchor", "piece", "id", "members", "at")).alias("wanted")))
    cut = texts.join(wanted, ["text_key", "n_bytes"]).mapInArrow(_cut(window), "anchor long, piece long, id long, members long, before int, count int, words binary")
    members = _written(cut, "window-members").withColumn("skipped", F.lit(0)).withColumn("key", F.col("anchor"))
    columns = [c.split()[0] for c in MEMBER.split(", ")]
    few = members.filter(F.col("members") <= group).select(columns)
    longer = members.filter(F.col("members") > group).select(columns).mapInArrow(_lengthened(window, gram, CLASS), MEMBER)
    sizes = _written(longer.groupBy("key").agg(F.count("*").alias("members")), "window-prefixes")
    longer = longer.join(sizes, "key")
    trees = (few.unionByName(longer.filter(F.col("members") <= group).select(columns)).repartition("key").sortWithinPartitions("key")
             .mapInArrow(_trees(window, gram, tree_bytes), "anchor long, piece long, start int, end int"))
    whole = longer.filter(F.col("members") > group).select(columns).mapInArrow(_windows(window), "digest binary, anchor long, piece long, id long, skipped int")
    smallest = _written(whole.groupBy("digest").agg(F.min("id").alias("_low")), "window-digests")
    alone = whole.join(smallest, "digest").filter("_low < id").select("anchor", "piece", F.col("skipped").alias("start"), (F.col("skipped") + 1).alias("end"))
    beaten = trees.unionByName(alone).groupBy("anchor", "piece").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    judged = _written(pieces.select("anchor", "piece", F.col("id").alias("_first"), "last_id").join(beaten, ["anchor", "piece"], "left").filter("runs IS NOT NULL OR _first < last_id").select("anchor", "piece", "_first", "runs"), "window-judged")
    first = F.shiftright("at", 16)
    all_of_it = F.array(F.struct(F.lit(0).alias("start"), (F.col("at").bitwiseAND(F.lit(0xFF)) + 1).cast("int").alias("end")))
    runs = (again.join(judged, ["anchor", "piece"]).select("text_key", "n_bytes", first.alias("_from"), F.explode(F.when(F.col("id") > F.col("_first"), all_of_it).otherwise(F.col("runs"))).alias("run"))
            .groupBy("text_key", "n_bytes").agg(F.collect_list(F.struct((F.col("_from") + F.col("run.start")).alias("start"), (F.col("_from") + F.col("run.end")).alias("end"))).alias("runs")))
    left = (texts.join(runs, ["text_key", "n_bytes"], "left").withColumnRenamed("id", "first_id")
            .mapInArrow(_remove(window), "text_key long, n_bytes long, first_id long, n_words long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept string"))
    copy = (F.col("_id") > F.col("first_id")) & (F.col("n_words") >= window)
    whole_text = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    return rows.join(left, ["text_key", "n_bytes"]).select(
        "_row.*", "n_words", F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, whole_text).otherwise(F.col("spans")).alias("spans"), F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"))
