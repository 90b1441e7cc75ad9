"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is read field by field; normaliser, metaspace marker, unigram scores or BPE ranks and
byte fallback are rebuilt as a tokenizer of that library. It is built once on the driver and travels to the
tasks as text (a few MB, bounded by the vocabulary), so executors need no model file.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyspark.sql.types as T
import sentencepiece
from pyspark.sql import DataFrame
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

from .texts import text_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed values of the SentencePiece protobuf: the metaspace marker, kinds of models and of pieces.
SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Threads of one task's batch, and text bytes in a batch.
THREADS, BATCH_BYTES = 2, 4 << 20


def protobuf_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message; submessages and texts stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class PieceModel:
    """What a model file says; the defaults are those of the format."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        model = cls()
        for number, value in protobuf_fields(data):
            if number == 1:
                piece = dict(protobuf_fields(value))
                model.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, b"\0" * 4))[0], piece.get(3, NORMAL)))
            elif number == 2:
                spec = dict(protobuf_fields(value))
                model.kind, model.byte_fallback, model.unk_id = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), spec.get(40, 0)
            elif number == 3:
                spec = dict(protobuf_fields(value))
                model.charsmap = spec.get(2, b"")
                model.dummy_prefix, model.remove_extra_spaces, model.escape_spaces = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        return model


def bpe_merges(model: PieceModel) -> list[tuple[str, str]]:
    """Pairs of pieces that make a normal piece, best score first; of one piece, the pairs of low ids first."""
    number = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, UNUSED)}
    found = []
    for piece, score, kind in model.pieces:
        if kind == NORMAL and len(piece) > 1:
            pairs = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in number and piece[i:] in number]
            found += [(-score, number[piece], number[a], number[b], a, b) for a, b in pairs]
    return [(a, b) for *_, a, b in sorted(found)]


def build_tokenizer(model: PieceModel) -> Tokenizer:
    if model.kind == UNIGRAM:
        # control pieces never match a text: behind a noncharacter they can't, and keep their ids
        core = models.Unigram([(p if kind in (NORMAL, USER_DEFINED, BYTE) else f"\uffff{p}", s) for p, s, kind in model.pieces], unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, bpe_merges(model), unk_token=model.pieces[model.unk_id][0],
                          fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} has neither unigram scores nor merges")
    made = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE if model.escape_spaces else " "))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", SPACE))
    made.normalizer = normalizers.Sequence(steps)
    own = [AddedToken(p, normalized=False, special=False) for p, _, kind in model.pieces if kind == USER_DEFINED]
    if own:
        made.add_tokens(own)
    ends = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    made.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *ends])
    return made


def load(path: str = MODEL) -> tuple[str, bytes]:
    """The rebuilt tokenizer as text and the model's bytes, read on the driver."""
    with open(path, "rb") as file:
        data = file.read()
    return build_tokenizer(PieceModel.parse(data)).to_str(), data


class Codec:
    """Batches through the rebuilt tokenizer and, to compare, through the SentencePiece library.

    With unigram scores the rebuilt tokenizer would take the spelling of a byte piece, such as ``<0x41>``, for
    the byte; the library does not. Texts that spell one are left to the library.
    """

    SPELLED_BYTE = re.compile("<0x[0-9A-F]{2}>")

    def __init__(self, tokenizer: str, model: bytes, threads: int = THREADS):
        self.own, self.library, self.threads = Tokenizer.from_str(tokenizer), sentencepiece.SentencePieceProcessor(model_proto=model), threads
        self.spells = isinstance(self.own.model, models.Unigram)
        parsed = PieceModel.parse(model)
        self.prefix = parsed.dummy_prefix
        self.spelling = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(SPACE, " ").encode() if kind in (NORMAL, USER_DEFINED) else None
                         for p, _, kind in parsed.pieces]

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids = [e.ids for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]
        if self.spells:
            for i, text in enumerate(texts):
                if self.SPELLED_BYTE.search(text):
                    ids[i] = self.library.encode(text)
        return ids

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Pieces joined by their bytes; ids of control pieces and bytes that are no UTF-8 take the tokenizer's decoder."""
        out = []
        for row in ids:
            try:
                text = b"".join([self.spelling[i] for i in row]).decode()
                out.append(text[1:] if self.prefix and text[:1] == " " else text)
            except (TypeError, UnicodeDecodeError):
                out.append(self.own.decode(row, skip_special_tokens=False))
        return out

    def parity(self, texts: list[str], ids: list[list[int]], decoded: list[str]) -> list[bool]:
        theirs = self.library.encode(texts, num_threads=self.threads)
        return [a == b and c == d for a, b, c, d in zip(ids, theirs, decoded, self.library.decode(theirs, num_threads=self.threads))]


def encode_rows(docs: DataFrame, path: str = MODEL, text_col: str = "text", threads: int = THREADS, verify: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (array of int), ``decoded`` (text read back from the ids) and ``parity``.

    ``parity`` says whether the SentencePiece library itself encodes the text to the same ids and decodes them to
    the same text; it is null without ``verify``. A null text is empty: no ids, decoded to an empty text. Columns
    of these names in ``docs`` are replaced. Narrow; a task holds a few MB of text at once.
    """
    tokenizer, model = load(path)
    made = T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType()).add("parity", T.BooleanType())
    rest = [f for f in docs.schema.fields if f.name not in made.names]

    def run(batches):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        codec = Codec(tokenizer, model, threads)
        for part in text_slices(batches, text_col, BATCH_BYTES):
            texts = [t or "" for t in part.column(text_col).to_pylist()]
            ids = codec.encode(texts)
            decoded = codec.decode(ids)
            parity = codec.parity(texts, ids, decoded) if verify else [None] * len(ids)
            columns = [part.column(n) for n in names] + [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string()), pa.array(parity, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*names, *made.names])

    names = [f.name for f in rest]
    return docs.mapInArrow(run, T.StructType([*rest, *made.fields]))
