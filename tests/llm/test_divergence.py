import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from synthframe.llm import perfect_hash
from synthframe.llm.divergence import source_divergence
from synthframe.llm.perfect_hash import PerfectHash, key_hashes

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(docs, least, top):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(FOLD))) for text, lang, source in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = [t for t, n in seen.items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2]) for s in {d[1] for d in own}}
        p, q = {s: share(c) for s, c in counts.items()}, share(Counter(t for d in own for t in d[2]))
        for s in counts:
            found = {"pair": [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s], "term": [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]}
            for part, rows in found.items():
                rows.sort(key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(rows) if part == "pair" or i < top]
    return sorted(out, key=str)


def frame(spark, docs):
    rows = [(text, lang, source, i, "x", 1) for i, (text, lang, source) in enumerate(docs)]
    return spark.createDataFrame(rows, "text string, lang string, source string, n long, term string, number int").repartition(3)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(11)
    stock = {lang: ["".join(r.choice("abcdeéß中") for _ in range(r.randint(1, 12))) for _ in range(150)] for lang in ("en", "de", None)}
    docs = [(" ".join(r.choice(stock[lang]) for _ in range(r.randint(0, 60))), lang, r.choice(["s0"] * 5 + [f"s{i}" for i in range(9)] + [None]))
            for lang in r.choices(["en", "de", None], [6, 3, 1], k=220)]
    return docs + [(None, "en", "silent"), ("", "fr", "a"), ("9 _ 9", "fr", "b"), ("Only One", "xx", "one"), ("A\x00b C-d", "en", "s1"), ("É é", "en", "s1")]


def test_equals_brute_force(spark, rows, corpus):
    assert rows(source_divergence(frame(spark, corpus), least_docs=12, top=7)) == brute_force(corpus, 12, 7)


def test_small_shards_passes_slots_and_tiles_do_not_change_results(spark, rows, corpus):
    cut = source_divergence(frame(spark, corpus), least_docs=12, top=7, shard_terms=20, pass_bytes=600, held_slots=50, tile_sources=2, tile_terms=9)
    assert rows(cut) == brute_force(corpus, 12, 7)


def test_nothing_kept_and_empty_table(spark, rows):
    docs = [("one two", "en", "a"), ("three", "en", "b"), (None, None, None)]
    assert rows(source_divergence(frame(spark, docs))) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert source_divergence(frame(spark, docs).limit(0)).collect() == []


def test_one_document_holds_a_term_very_often(spark, rows):
    docs = [("word " * 200_000, "en", "a"), ("word other", "en", "b"), ("other", "en", "b")]
    assert rows(source_divergence(frame(spark, docs), least_docs=2)) == brute_force(docs, 2, 50)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_perfect_hash_is_minimal_and_refuses_strangers(n):
    keys = pa.array([f"k{i}ä".encode() for i in range(n)], pa.binary())
    made = PerfectHash.build(keys)
    again = PerfectHash.unpacked(**made.packed())
    for perfect in (made, again):
        assert sorted(perfect.lookup(keys, key_hashes(keys)).tolist()) == list(range(n))
        others = pa.array([f"x{i}".encode() for i in range(500)] + [b""], pa.binary())
        assert (perfect.lookup(others, key_hashes(others)) == -1).all()


def test_perfect_hash_keeps_keys_of_equal_hash_apart(monkeypatch):
    monkeypatch.setattr(perfect_hash, "key_hashes", lambda keys: np.zeros(len(keys), np.uint64))
    keys = pa.array([b"a", b"b", b"c"], pa.binary())
    made = PerfectHash.build(keys)
    found = made.lookup(pa.array([b"c", b"z", b"a", b"b"], pa.binary()), np.zeros(4, np.uint64))
    assert found[1] == -1 and sorted(found[[0, 2, 3]].tolist()) == [0, 1, 2]
