import random

import numpy as np
import pytest

from synthframe.llm.prefix_trees import internal_nodes, node_classes, removed_windows


def brute_force(rows, window):
    """``rows``: (id, text) to {row number: (n_words, n_removed, kept)}."""
    last = (1 << 63) - 1
    smallest = {}
    for i, text in rows:
        words = (text or "").encode().split()
        for w in range(len(words) - window + 1):
            key = tuple(words[w : w + window])
            smallest[key] = min(smallest.get(key, last), last if i is None else i)
    out = []
    for i, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for w in range(len(words) - window + 1):
            if smallest[tuple(words[w : w + window])] < (last if i is None else i):
                gone |= set(range(w, w + window))
        out.append((i, len(words), len(gone), b" ".join(x for k, x in enumerate(words) if k not in gone).decode()))
    return sorted(out, key=str)


def found(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 1, "a", 2) for i, t in rows], "doc_id long, text string, key int, anchor string, n_words int").repartition(3)
    return sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in removed_windows(docs, **options).collect()], key=str)


@pytest.fixture(scope="module")
def corpus(prose):
    r = random.Random(7)
    texts = prose(12, seed=21, words=150)
    passage = prose(1, seed=22, words=75)[0].split()
    for _ in range(25):  # a passage in documents of their own
        own = prose(1, seed=r.randint(100, 10**6), words=80)[0].split()
        at = r.randint(0, len(own))
        texts.append(" ".join(own[:at] + passage + own[at:]))
    for _ in range(12):  # near copies of one text
        words = texts[0].split()
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = "changed"
        texts.append("\n ".join(words))
    texts += [texts[3], texts[3], None, "", " \t", "ha " * 160, "ha " * 130, "x " * 49, "x " * 49, "y " * 50, "y  " * 50, "é\x85ü " * 60, "é\x85ü\n" * 60, " ".join(passage[:50]), " ".join(passage[:49])]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return [*zip(ids, texts), (None, texts[1]), (None, texts[5] + " end"), (ids[2], texts[2]), (ids[4], texts[2])]


@pytest.mark.parametrize("options", [{}, {"group": 3}, {"group": 0, "tree_bytes": 1}], ids=["prefix of a gram", "longer prefixes", "whole windows"])
def test_equals_brute_force(spark, corpus, options):
    assert found(spark, corpus, **options) == brute_force(corpus, 50)


def test_small_windows(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 60)))) for i in range(60)]
    for options in ({}, {"group": 4}):
        assert found(spark, rows, window=9, gram=3, **options) == brute_force(rows, 9)


def test_spans_and_empty_table(spark):
    one = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, one), (2, "head " + one + " tail")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in removed_windows(docs).collect()}
    assert got[1]["spans"] == [] and [tuple(s) for s in got[2]["spans"]] == [(1, 61)] and got[2]["kept"] == "head tail"
    assert removed_windows(docs.limit(0)).collect() == []


def test_nodes_of_a_tree():
    shared = np.array([0, 3, 1, 2, 0, 2])
    nodes = internal_nodes(shared)
    assert sorted(map(tuple, nodes.tolist())) == [(1, 0, 0, 4), (2, 0, 4, 6), (2, 1, 2, 4), (3, 1, 0, 2)]
    assert node_classes(nodes, np.arange(6), 2).tolist() == [0, 0, 2, 2, 4, 4]
    assert node_classes(nodes, np.arange(6), 3).tolist() == [0, 0, 2, 3, 4, 5]
