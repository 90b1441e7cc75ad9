"""Alignment of two tokenizers over a corpus.

Tokens of a byte-level BPE (A) and of a SentencePiece model (B) are laid over the same bytes. A task works on
slices of text, column-wise in Arrow: token lists are flattened with their parent indices, segmented cumulative
sums give byte ends inside each document, and one Acero hash join on (document, end) keys finds where both
tokenizers end together (groups) and, ordered, which tokens overlap (links). A slice's links are counted per
document and id pair with ``Table.group_by``; Spark merges the partial counts of all slices into corpus-wide
ones and sends each slice the counts of its own pairs, so no table of counts is broadcast or collected.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
import pyspark.sql.types as T
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from ..session import scratch_path
from .sentencepiece_codec import BYTE, MODEL, SPACE, PieceModel
from .texts import joined, text_slices

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
#: Text bytes of one slice: the unit in which counts are exchanged, and what a task holds at once.
SLICE_BYTES = 4 << 20
# Fixed value: how byte-level BPE vocabularies of this kind cut texts before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def byte_letters() -> dict[str, int]:
    """The letter of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(others)}


def byte_level_spelling(definition: str) -> list[bytes]:
    """Bytes of each id of a byte-level BPE; added tokens, which texts never yield here, are empty."""
    letters, vocabulary = byte_letters(), json.loads(definition)
    added = {t["id"] for t in vocabulary["added_tokens"]}
    spelled = {i: bytes(letters[c] for c in token) for token, i in vocabulary["model"]["vocab"].items() if i not in added}
    return [spelled.get(i, b"") for i in range(max([*spelled, *added]) + 1)]


def piece_spelling(model: bytes) -> list[bytes]:
    """Bytes of each piece: U+2581 is a space, a byte piece its byte."""
    return [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(SPACE, " ").encode() for p, _, kind in PieceModel.parse(model).pieces]


class Encoders:
    """Both tokenizers and the spelling of their ids.

    A's merges run in tiktoken over the ranks of the given file, several times as fast as the tokenizers library
    with equal ids; a text that its pattern engine refuses is left to that library.
    """

    def __init__(self, definition: str, model: bytes):
        self.spelling = (byte_level_spelling(definition), piece_spelling(model))
        self.definition, self.exact = definition, None
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={s: i for i, s in enumerate(self.spelling[0]) if s}, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.lengths = [pa.array([len(s) for s in spelling], pa.int64()) for spelling in self.spelling]
        self.bytes = [pa.array(spelling, pa.binary()) for spelling in self.spelling]
        self.decimals = [pa.array([str(i) for i in range(len(spelling))]) for spelling in self.spelling]

    def a(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        except Exception:  # the pattern engine's own limits
            if self.exact is None:
                self.exact = Tokenizer.from_str(self.definition)
                self.exact.encode_special_tokens = True
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """Id lists of A over space and text, and of B over the text."""
        ids = [self.a(f" {t}") for t in texts]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
        flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
        return (pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())),
                pa.array(self.pieces.encode(texts, num_threads=1) if texts else [], pa.list_(pa.int32())))


def token_ends(tokens: pa.ListArray, lengths: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(document, id, end) of each token: its list's index, itself, and its end in bytes inside the document."""
    doc, ids = pc.list_parent_indices(tokens), pc.list_flatten(tokens)
    total = pc.cumulative_sum(lengths.take(ids))
    before = pa.concat_arrays([pa.array([0], pa.int64()), total]).take(tokens.offsets[:-1])
    return doc, ids, pc.subtract(total, before.take(doc))


def spells(tokens: pa.ListArray, spelling: pa.Array, lengths: pa.Array, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per document whether its tokens join to its bytes; ``data`` holds those of all documents."""
    flat = pc.list_flatten(tokens)
    own = np.diff(np.concatenate(([0], np.cumsum(lengths.take(flat).to_numpy())))[tokens.offsets.to_numpy()])
    ok = own == sizes
    if ok.all():
        made, _ = joined(spelling.take(flat))
        if np.array_equal(made, data):
            return ok
    starts = np.cumsum(sizes) - sizes
    for i in np.flatnonzero(ok).tolist():
        made = b"".join(spelling.take(tokens[i].values).to_pylist())
        ok[i] = made == data[starts[i] : starts[i] + sizes[i]].tobytes()
    return ok


def _group_texts(flags: np.ndarray, decimals: pa.Array, ids: pa.Array) -> pa.Array:
    """Ids of each group joined by commas; ``flags`` marks the last token of a group."""
    cuts = np.concatenate(([0], np.flatnonzero(flags) + 1))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), decimals.take(ids)), ",")


def align(texts: list[str | None], encoders: Encoders) -> tuple[dict[str, list], pa.Table]:
    """Measures per document of one slice, and its links as a table (doc, pair, n).

    ``pair`` is A's id times 2**32 plus B's id. A text that is null, empty, or that either tokenizer does not
    spell byte by byte (such as one that holds U+2581) has no tokens: zeros and an empty ``groups``.
    """
    n = len(texts)
    measures = {name: np.zeros(n, np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")} | {"groups_sha256": [""] * n}
    held = [i for i, t in enumerate(texts) if t]
    a, b = encoders.encode([texts[i] for i in held])
    raw = [b" " + texts[i].encode() for i in held]
    sizes, data = np.array([len(x) for x in raw], np.int64), np.frombuffer(b"".join(raw), np.uint8)
    ok = spells(a, encoders.bytes[0], encoders.lengths[0], data, sizes) & spells(b, encoders.bytes[1], encoders.lengths[1], data, sizes)
    place = np.array(held, np.int64)[ok]
    if not len(place):
        return measures, pa.table({"doc": pa.array([], pa.int64()), "pair": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    if not ok.all():
        a, b = a.filter(pa.array(ok)), b.filter(pa.array(ok))
    sides = []
    for tokens, lengths, name in ((a, encoders.lengths[0], "a"), (b, encoders.lengths[1], "b")):
        doc, ids, end = token_ends(tokens, lengths)
        key = pc.bit_wise_or(pc.shift_left(pc.cast(doc, pa.int64()), 32), end)
        sides.append(pa.table({"key": key, name: ids}))
    # every end of either tokenizer, in order: the next end of A and of B are the tokens that overlap up to here
    both = sides[0].join(sides[1], "key", join_type="full outer", use_threads=False).sort_by("key").combine_chunks()
    in_a, in_b = (pc.is_valid(both[c]).to_numpy() for c in "ab")
    links = pa.table({"doc": pc.shift_right(both["key"], 32), "a": pc.fill_null_backward(both["a"]), "b": pc.fill_null_backward(both["b"])})
    doc = links["doc"].to_numpy()
    together = in_a & in_b
    measures["n_a"][place], measures["n_b"][place] = np.diff(a.offsets.to_numpy()), np.diff(b.offsets.to_numpy())
    measures["n_links"][place] = np.bincount(doc, minlength=len(place))
    n_groups = np.bincount(doc[together], minlength=len(place))
    measures["n_groups"][place] = n_groups
    groups = pc.binary_join_element_wise(_group_texts(in_b[in_a], encoders.decimals[0], pc.list_flatten(a)),
                                         _group_texts(in_a[in_b], encoders.decimals[1], pc.list_flatten(b)), "|")
    texts_of = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_groups))), pa.int32()), groups), ";")
    for i, text in zip(place.tolist(), texts_of):
        measures["groups_sha256"][i] = hashlib.sha256(text.as_buffer()).hexdigest()
    pair = pc.bit_wise_or(pc.shift_left(pc.cast(links["a"], pa.int64()), 32), pc.cast(links["b"], pa.int64()))
    counted = pa.table({"doc": links["doc"], "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    return measures, pa.table({"doc": pa.array(place).take(counted["doc"].combine_chunks()), "pair": counted["pair"], "n": counted["count_all"]})


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, mostly small, as compressed byte planes."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True) if n else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _slices(definition: str, model: bytes, limit: int):
    """Task: texts to one row per slice: its documents, its distinct pairs with counts, and who holds which pair."""
    def run(batches):
        encoders, number = Encoders(definition, model), 0
        for part in text_slices(batches, "_text", limit):
            measures, links = align(part.column("_text").to_pylist(), encoders)
            pairs = links.group_by("pair", use_threads=False).aggregate([("n", "sum")])
            links = links.append_column("code", pc.index_in(links["pair"], pairs["pair"])).sort_by([("doc", "ascending"), ("code", "ascending")])
            doc, code = links["doc"].to_numpy(), links["code"].to_numpy().astype(np.int64)
            step = np.diff(code, prepend=0)
            new = np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
            step[new] = code[new]
            docs = pa.StructArray.from_arrays([part.column("_row"), *(pa.array(v, pa.string() if k == "groups_sha256" else pa.int64()) for k, v in measures.items())], ["row", *measures])
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            flat = lambda column: column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            yield pa.RecordBatch.from_arrays(
                [pa.array([(TaskContext.get().partitionId() << 32) | number]), one(docs), one(flat(pairs["pair"])), one(flat(pairs["n_sum"])),
                 one(pa.array(np.bincount(doc, minlength=part.num_rows), pa.int32())), pa.array([packed(step)]), pa.array([packed(links["n"].to_numpy())])],
                ["slice", "docs", "pair", "n", "held", "codes", "times"])
            number += 1

    return run


def _summed():
    """Task: one slice and the corpus-wide counts of its pairs to its documents' sums."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        docs = left["docs"].combine_chunks().flatten()
        held = left["held"].combine_chunks().flatten().to_numpy()
        total = int(held.sum())
        step, times = (unpacked(left[c][0].as_py(), total).astype(np.int64) for c in ("codes", "times"))
        at = right["pos"].to_numpy()
        count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count[at], best[at] = right["count"].to_numpy(), right["is_best"].to_numpy()
        # a step is the distance to the document's previous code
        start = np.repeat(np.cumsum(held) - held, held)
        walked = np.cumsum(step)
        code = walked - (walked - step)[start] if total else step
        sums = {}
        for name, weight in (("n_best", best), ("count_sum", count)):
            # whole numbers stay whole: no floating-point bincount
            running = np.concatenate(([0], np.cumsum(times * weight[code]))) if total else np.zeros(1, np.int64)
            ends = np.cumsum(held)
            sums[name] = running[ends] - running[ends - held]
        columns = {"row": docs.field("row")} | {n: docs.field(n) for n in ("n_a", "n_b", "n_groups", "n_links")} | {k: pa.array(v) for k, v in sums.items()} | {"groups_sha256": docs.field("groups_sha256")}
        return pa.table(columns)

    return run


def align_tokenizers(docs: DataFrame, id_cols: list[str], text_col: str = "text", definition: str = BYTE_LEVEL, model: str = MODEL, slice_bytes: int = SLICE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs).

    ``documents``: per input row the columns ``id_cols``, ``n_a`` and ``n_b`` tokens, ``n_groups``, ``n_links``
    (overlapping tokens of A and B), ``n_best`` (links whose pair is the most frequent of its B id, ties
    included), ``count_sum`` (corpus-wide counts over the links) and ``groups_sha256`` (empty without tokens).
    ``pairs``: ``a``, ``b``, ``count``, ``is_best`` of every pair linked anywhere. Null and empty texts, and texts
    that one tokenizer does not spell byte by byte, have zeros; repeated rows count once each; an empty table
    gives empty results; columns beside those named are not read. A slice is a row of the written intermediate
    table, so its size is bounded by ``slice_bytes``, or by the longest single text.
    """
    spark = docs.sparkSession
    with open(definition, encoding="utf-8") as file, open(model, "rb") as other:
        known = (file.read(), other.read())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in id_cols]).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    # nothing of the input is null here, whatever its schema says
    row = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema["_row"].dataType.fields])
    whole = T.StructType().add("slice", "long").add("docs", T.ArrayType(T.StructType().add("row", row).add("n_a", "long").add("n_b", "long").add("n_groups", "long").add("n_links", "long").add("groups_sha256", "string")))
    for name, kind in (("pair", "array<bigint>"), ("n", "array<bigint>"), ("held", "array<int>"), ("codes", "binary"), ("times", "binary")):
        whole = whole.add(name, T._parse_datatype_string(kind) if "array" in kind else kind)
    path = scratch_path(spark, "token-slices")
    rows.mapInArrow(_slices(*known, slice_bytes), whole).write.parquet(path)
    made = spark.read.schema(whole).parquet(path)
    held = made.select("slice", F.posexplode(F.arrays_zip("pair", "n")).alias("pos", "_own")).select("slice", "pos", "_own.pair", "_own.n")
    counts = held.groupBy("pair").agg(F.sum("n").alias("count"))
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    highest = counts.groupBy(b.alias("b")).agg(F.max("count").alias("highest"))
    pairs = counts.withColumn("b", b).join(highest, "b").select("pair", F.shiftright("pair", 32).cast("int").alias("a"), F.col("b").cast("int").alias("b"), "count", (F.col("count") == F.col("highest")).alias("is_best"))
    table = scratch_path(spark, "token-pairs")
    pairs.write.parquet(table)
    pairs = spark.read.schema(pairs.schema).parquet(table)
    known_counts = held.join(pairs.select("pair", "count", "is_best"), "pair").select(F.col("slice").alias("of"), "pos", "count", F.col("is_best").cast("long").alias("is_best"))
    out = T.StructType().add("row", row)
    for name in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"):
        out = out.add(name, "long")
    found = made.select("slice", "docs", "held", "codes", "times").groupBy("slice").cogroup(known_counts.groupBy("of")).applyInArrow(_summed(), out.add("groups_sha256", "string"))
    return found.select("row.*", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), pairs.drop("pair")
