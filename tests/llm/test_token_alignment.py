import hashlib
import random

import pyspark.sql.functions as F
import pytest
import sentencepiece
from tokenizers import Tokenizer

from synthframe.llm.token_alignment import BYTE_LEVEL, MODEL, Encoders, align_tokenizers, byte_letters


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTE_LEVEL)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=MODEL)


def spelled(libraries, text):
    """Tokens of both as (id, begin, end), or None where the bytes differ."""
    a, b = libraries
    letters, out = byte_letters(), []
    ids = a.encode(" " + text, add_special_tokens=False).ids
    pieces = b.encode(text)
    for ids, said in ((ids, [bytes(letters[c] for c in a.id_to_token(i)) for i in ids]),
                      (pieces, [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in pieces])):
        if b"".join(said) != (" " + text).encode():
            return None
        at, tokens = 0, []
        for i, s in zip(ids, said):
            tokens.append((i, at, at + len(s)))
            at += len(s)
        out.append(tokens)
    return out


def brute_force(libraries, texts):
    made, counts = {}, {}
    for key, text in texts.items():
        both = spelled(libraries, text) if text else None
        links = [(x[0], y[0]) for x in both[0] for y in both[1] if x[1] < y[2] and y[1] < x[2]] if both else []
        made[key] = (both, links)
        for link in links:
            counts[link] = counts.get(link, 0) + 1
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    rows = {}
    for key, (both, links) in made.items():
        groups = ""
        if both:
            ends = sorted({e for *_, e in both[0]} & {e for *_, e in both[1]})
            parts, begin = [], 0
            for end in ends:
                parts.append("|".join(",".join(str(i) for i, s, e in side if begin <= s and e <= end) for side in both))
                begin = end
            groups = hashlib.sha256(";".join(parts).encode()).hexdigest()
        rows[key] = (*((len(both[0]), len(both[1]), len(ends)) if both else (0, 0, 0)), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), groups)
    return rows


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_equals_brute_force(spark, docs, prose, edge_texts, libraries):
    texts = [*edge_texts, *prose(12, words=40), *prose(2, words=40), "a▁b", "<s>x</s><|endoftext|> <0x41>", "  two  spaces ", "١٢ 你好 \U0001f468‍\U0001f469 é", "\x00nul", "it's  \r\n\n  end  "]
    found, pairs = align_tokenizers(docs(texts), ["doc_id"], slice_bytes=2000)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in found.collect()}
    assert got == brute_force(libraries, dict(enumerate(texts)))
    assert got[0] == got[1] == (0, 0, 0, 0, 0, 0, "")  # null, empty
    assert got[texts.index("a▁b")][0] == 0
    b = pairs.groupBy("b").agg(F.max("count").alias("m"), F.max(F.when(F.col("is_best"), F.col("count"))).alias("n"))
    assert b.filter("m != n OR n IS NULL").count() == 0


def test_slices_do_not_change_results(docs, prose, rows):
    texts = prose(30, words=60)
    assert rows(align_tokenizers(docs(texts), ["doc_id"], slice_bytes=500)[0]) == rows(align_tokenizers(docs(texts), ["doc_id"])[0])


def test_empty_table_clashing_names_and_null_ids(spark, docs, rows):
    assert align_tokenizers(docs(["x"]).limit(0), ["doc_id"])[0].collect() == []
    clashing = spark.createDataFrame([(None, "one two", 3, "s"), (4, "one two", 3, "s")], "doc_id long, text string, n_a int, slice string")
    found = align_tokenizers(clashing, ["doc_id"])[0].collect()
    assert {r["doc_id"] for r in found} == {None, 4} and all(r["n_best"] == r["n_links"] > 0 for r in found)


def test_fast_merges_equal_the_tokenizers_library(libraries):
    with open(BYTE_LEVEL, encoding="utf-8") as file, open(MODEL, "rb") as other:
        own = Encoders(file.read(), other.read())
    r = random.Random(5)
    stock = ["a", "ab", " ", "  ", "\n", "\t", " ", " ", "\u0085", "1", "½", "٣", "中", "'s", "'LL", "é", "é", "\U0001f600", "!", "<|endoftext|>", "_", "​", "᠎", "﻿", "\U0001e030", "Ᲊ"]
    for _ in range(3000):
        text = "".join(r.choice(stock) for _ in range(r.randint(1, 14)))
        assert own.a(text).tolist() == libraries[0].encode(text, add_special_tokens=False).ids, repr(text)
    assert own.a(" " * 300_000 + "x").tolist() == libraries[0].encode(" " * 300_000 + "x", add_special_tokens=False).ids
