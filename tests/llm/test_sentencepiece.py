import os
import random
import struct

import pytest
import sentencepiece

from synthframe.llm import sentencepiece_codec as codec

needs_model = pytest.mark.skipif(not os.path.exists(codec.MODEL), reason="no model file")
ALPHABET = ["a", "b", " ", "  ", "\n", "▁", "é", "ﬁ", "🏔", "\x00", "\t", "<s>", "</s>", "<unk>", "<0x41>", "the", "ing", "ab", "ba", "bab", "Ａ", "\xa0", "中", "xx", "..."]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(fields):
    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += varint(number << 3 | 2) + varint(len(value)) + value
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3) + varint(value)
    return out


def unigram_model(byte_fallback, prefix, extra):
    pieces = [("<unk>", 0.0, codec.UNKNOWN), ("<s>", 0.0, codec.CONTROL), ("</s>", 0.0, codec.CONTROL)]
    if byte_fallback:
        pieces += [(f"<0x{i:02X}>", 0.0, codec.BYTE) for i in range(256)]
    words = ["▁", "a", "b", "t", "h", "e", "ab", "ba", "▁a", "▁ab", "the", "▁the", "bab", "x", "xx", "."]
    pieces += [(w, -1.3 - 0.37 * i, codec.NORMAL) for i, w in enumerate(words)]
    body = [(1, message([(1, p.encode()), (2, s), (3, k)])) for p, s, k in pieces]
    trainer = message([(3, codec.UNIGRAM), (4, len(pieces)), (35, int(byte_fallback)), (40, 0), (41, 1), (42, 2)])
    normal = message([(1, b"identity"), (2, b""), (3, int(prefix)), (4, int(extra)), (5, 1)])
    return message([*body, (2, trainer), (3, normal)])


def compare(data, seed):
    own = codec.Codec(codec.build_tokenizer(codec.PieceModel.parse(data)).to_str(), data, 1)
    theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
    r = random.Random(seed)
    for _ in range(1500):
        text = "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 12)))
        ids = own.encode([text])
        assert ids[0] == theirs.encode(text), repr(text)
        assert own.decode(ids)[0] == theirs.decode(ids[0]), repr(text)


@needs_model
def test_bpe_model_has_parity():
    with open(codec.MODEL, "rb") as file:
        compare(file.read(), 1)


@pytest.mark.parametrize("prefix", [True, False])
def test_unigram_model_has_parity(prefix):
    compare(unigram_model(True, prefix, False), 2)


@needs_model
def test_rows_keep_their_columns_and_round_trip(docs, edge_texts, prose):
    texts = edge_texts + prose(3, words=5000) + ["twice"] * 2
    frame = docs(texts).withColumnRenamed("source", "ids")
    got = {r.doc_id: r for r in codec.encode_rows(frame).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert got[i].parity and got[i].decoded == (text or "") and got[i].lang == "en"
    assert got[0].ids == []
    assert codec.encode_rows(frame.filter("false")).count() == 0
