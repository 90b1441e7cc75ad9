import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from synthframe.llm import suffix_dedup
from synthframe.llm.suffix_arrays import common_prefixes, packed_words, suffix_array


def removed(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    for d in data:
        mask = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                mask[i:i + length] = b"\1" * length
        yield d, mask


def brute(texts):
    out = []
    for d, mask in removed(texts):
        kept = bytes(b for b, m in zip(d, mask) if not m)
        spans = sum(m and (i == 0 or not mask[i - 1]) for i, m in enumerate(mask))
        out.append((len(d), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return out


def mixed_texts(seed):
    r = random.Random(seed)
    shared = ["".join(r.choice("abcdefgé ") for _ in range(r.randint(100, 600))) for _ in range(10)]
    def one():
        k = r.random()
        if k < 0.1:
            return r.choice([None, "", "ab" * r.randint(1, 400), "x" * r.randint(1, 900)])
        return "".join(r.choice(shared)[r.randint(0, 50):] if r.random() < 0.5 else "".join(r.choice("abcdefghij é") for _ in range(r.randint(1, 300))) for _ in range(r.randint(1, 4)))
    texts = [one() for _ in range(90)]
    # a passage that many texts share, with other letters around it
    texts += ["".join(r.choice("klm") for _ in range(90)) + shared[0] + "".join(r.choice("klm") for _ in range(90)) for _ in range(40)]
    return texts + texts[:4]


@pytest.mark.parametrize("pieces", [2000, 3])
def test_matches_brute_force_also_where_anchors_are_spread(docs, edge_texts, monkeypatch, pieces):
    monkeypatch.setattr(suffix_dedup, "SHARD_PIECES", pieces)
    texts = edge_texts + mixed_texts(pieces)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removal_report(docs(texts)).collect())
    assert got == [(i, *w) for i, w in enumerate(brute(texts))]


def test_kept_texts_are_whole_characters(docs, edge_texts):
    texts = edge_texts + mixed_texts(8)
    frame = docs(texts)
    kept = suffix_dedup.without_repeats(frame)
    assert kept.columns == frame.columns
    got = {r.doc_id: r.text for r in kept.collect()}
    for i, (data, mask) in enumerate(removed(texts)):
        if texts[i] is None:
            assert got[i] is None
            continue
        want, at = "", 0
        for c in texts[i]:
            size = len(c.encode())
            want += "" if all(mask[at:at + size]) else c
            at += size
        assert got[i] == want


def test_empty_table(docs):
    assert suffix_dedup.removal_report(docs(["a"]).filter("false").select("doc_id", "text")).count() == 0


def test_suffix_array_and_prefixes():
    r = random.Random(6)
    for text in (b"banana" * 30, bytes(r.choice(b"ab") for _ in range(700)), b"a" * 300, bytes(r.choice(b"abcdefgh") for _ in range(1000))):
        data = np.frombuffer(text, np.uint8)
        words = packed_words(data, 50)
        sa = suffix_array(words[: len(data)], 8)
        order = sorted(range(len(text)), key=lambda i: text[i:])
        assert sa.tolist() == order
        def common(a, b):
            n = 0
            while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            return n
        assert common_prefixes(words, len(data), sa, 50).tolist()[1:] == [min(50, common(a, b)) for a, b in zip(order, order[1:])]
