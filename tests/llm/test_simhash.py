import random

import numpy as np
import xxhash

from synthframe.llm import simhash
from synthframe.llm.components import connected_components


def groups(n, links):
    parent = list(range(n))
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def code_of(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in h) > len(h))


def test_fingerprints_and_components_match_brute_force(docs, edge_texts, prose):
    r = random.Random(1)
    texts = edge_texts + prose(30, words=300)
    for t in texts[-30:-10]:
        w = t.split()
        w[r.randrange(len(w))] = "changed"
        texts += [" ".join(w).upper(), t]
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.simhash_components(docs(texts)).collect()}
    codes = [code_of(t) for t in texts]
    want = groups(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if (codes[a] ^ codes[b]).bit_count() <= 3])
    assert got == {i: (format(c, "016x"), g) for i, (c, g) in enumerate(zip(codes, want))}


def test_dense_codes_in_many_trees(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TREE_CODES", 16)
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(12)]
    codes = list({c ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 5))) & (1 << 64) - 1 for c in base for _ in range(40)})
    codes = [c & (1 << 64) - 1 for c in codes]
    frame = spark.createDataFrame([(i, c - (c >> 63 << 64)) for i, c in enumerate(codes)], "doc_id long, code long")
    got = {r.doc_id: r.component for r in simhash.near_components(frame).collect()}
    assert got == dict(enumerate(groups(len(codes), [(a, b) for a in range(len(codes)) for b in range(a) if (codes[a] ^ codes[b]).bit_count() <= 3])))


def test_tree_search_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 20, dtype=np.uint64)
    codes = np.unique(base[rng.integers(0, 20, 600)] ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64)))
    tree = simhash.bk_tree(codes)
    for radius in (0, 3, 9):
        q, node, d = simhash.search_tree(codes, tree, codes, radius)
        distance = np.bitwise_count(codes[:, None] ^ codes[None])
        assert {(a, b, c) for a, b, c in zip(q, node, d)} == {(a, b, distance[a, b]) for a, b in zip(*np.nonzero(distance <= radius))}


def test_every_choice_of_blocks_shares_a_key(spark):
    r = random.Random(4)
    for blocks in (4, 5, 6):
        rows = []
        for i in range(60):
            c = r.getrandbits(64)
            d = c
            for bit in r.sample(range(64), 3):
                d ^= 1 << bit
            rows.append((c - (c >> 63 << 64), d - (d >> 63 << 64)))
        from pyspark.sql import functions as F
        frame = spark.createDataFrame(rows, "c long, d long")
        same = frame.select(F.arrays_overlap(F.array(*simhash.block_keys(F.col("c"), 3, blocks)), F.array(*simhash.block_keys(F.col("d"), 3, blocks))).alias("ok"))
        assert all(x.ok for x in same.collect())


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_document_of_each_group_stays(docs, edge_texts, prose):
    r = random.Random(7)
    texts = edge_texts + prose(25, words=200)
    for t in texts[-25:-5]:
        w = t.split()
        for _ in range(r.choice([1, 2, 30])):
            w[r.randrange(len(w))] = "other"
        texts += [" ".join(w), t, t.upper()]
    sets = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    frame = docs(texts)
    kept = simhash.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(groups(len(texts), links)))
    assert simhash.drop_near_duplicates(frame.filter("false")).count() == 0


def test_null_ids_and_repeated_rows(spark, prose):
    one, two = prose(2, seed=5)
    frame = spark.createDataFrame([(None, one), (4, one), (4, one), (9, one), (None, two), (4, two + " end")], "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in simhash.drop_near_duplicates(frame).collect()), key=str)
    assert kept == sorted([(4, one), (4, two + " end")], key=str)


def stays(texts, similarity=0.8):
    """Positions that stay by brute force over all pairs."""
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    return sorted(set(groups(len(texts), links)))


def test_families_around_the_similarity_lose_no_link(docs, prose, monkeypatch):
    monkeypatch.setattr(simhash, "TREE_CODES", 16)  # sent with the plan, so tasks see it too
    texts = []
    for family, (base, span) in enumerate(zip(prose(8, seed=11, words=200), (10, 14, 16, 17, 18, 19, 20, 24))):
        r = random.Random(family)
        for number in range(40):
            w, at = base.split(), r.randrange(200 - span)
            w[at:at + span] = [f"f{family}n{number}w{i}" for i in range(span)]
            texts.append(" ".join(w))
    assert sorted(x.doc_id for x in simhash.drop_near_duplicates(docs(texts)).collect()) == stays(texts)


def test_similar_forest_joins_what_all_pairs_join():
    r = random.Random(12)
    for trial in range(60):
        sets = [[] for _ in range(trial % 3)]
        for _ in range(r.randint(1, 4)):
            base = [r.getrandbits(63) for _ in range(r.choice([5, 40, 100]))]
            for _ in range(r.randint(1, 12)):
                changed, at = int(len(base) * r.uniform(0, 0.15)), r.randrange(len(base))
                sets.append(sorted({r.getrandbits(63) if (i - at) % len(base) < changed else v for i, v in enumerate(base)}))
        r.shuffle(sets)
        links = simhash.similar_forest(np.array([v for s in sets for v in s], np.int64), np.array([len(s) for s in sets]), 0.8, np.arange(len(sets)))
        true = {(a, b) for a in range(len(sets)) for b in range(a) if len(set(sets[a]) & set(sets[b])) >= 0.8 * len({*sets[a], *sets[b]})}
        assert {(max(x), min(x)) for x in links} <= true and len(links) < len(sets)
        assert groups(len(sets), links) == groups(len(sets), true)


def test_repeated_phrases_do_not_part_equal_sets(docs, prose):
    texts = [x for t in prose(20, seed=13, words=805) for x in (t, " ".join(t.split() + t.split()[-5:] * 37))]
    assert stays(texts) == list(range(0, 40, 2))
    assert sorted(x.doc_id for x in simhash.drop_near_duplicates(docs(texts)).collect()) == stays(texts)


def test_similar_sets_are_found_in_the_tree_and_those_beyond_it_after_it(monkeypatch):
    r, found, search = random.Random(14), set(), simhash.search_tree

    def seen(codes, child, queries, radius):
        q, at, distance = search(codes, child, queries, radius)
        found.update(zip(queries[q].tolist(), codes[at].tolist()))
        return q, at, distance

    monkeypatch.setattr(simhash, "search_tree", seen)
    sets = []
    for _ in range(6):
        base = [r.getrandbits(63) for _ in range(100)]
        for _ in range(20):
            changed, at = r.randrange(14), r.randrange(100)
            sets.append(sorted({r.getrandbits(63) if (i - at) % 100 < changed else v for i, v in enumerate(base)}))
    values, sizes = np.array([v for s in sets for v in s], np.int64), np.array([len(s) for s in sets])
    want = groups(len(sets), [(a, b) for a in range(len(sets)) for b in range(a) if len(set(sets[a]) & set(sets[b])) >= 0.8 * len({*sets[a], *sets[b]})])
    codes = [simhash.simhash(np.array(s, np.uint64)) for s in sets]
    links = simhash.similar_forest(values, sizes, 0.8, np.arange(len(sets)))
    assert groups(len(sets), links) == want
    near = [(a, b) for a, b in links if (codes[a] ^ codes[b]).bit_count() <= simhash.WIDE_RADIUS]
    assert near and all((codes[max(x)], codes[min(x)]) in found for x in near)
    far = np.array([r.getrandbits(64) for _ in sets], np.uint64)
    old = 50
    assert groups(len(sets), simhash.similar_forest(values, sizes, 0.8, np.arange(len(sets)), 0, far)) == want
    for c in (np.array(codes, np.uint64), far):
        inside = [simhash.similar_forest(values[a:b], sizes[x:y], 0.8, np.arange(y - x), 0, c[x:y]) for x, y, a, b in ((0, old, 0, sizes[:old].sum()), (old, len(sets), sizes[:old].sum(), None))]
        across = simhash.similar_forest(values, sizes, 0.8, np.arange(len(sets)), old, c)
        assert groups(len(sets), inside[0] + [(a + old, b + old) for a, b in inside[1]] + across) == want


def test_fingerprints_near_each_other_are_a_shard_of_their_own(docs, prose, monkeypatch):
    """Without any shared minimum, texts whose fingerprints the operator links are still compared on the whole sets."""
    monkeypatch.setattr(simhash, "MINIMA", 0)  # sent with the plan, so tasks see it too
    texts = [x for t in prose(10, seed=15, words=805) for x in (t, t + " end")]
    assert stays(texts) == list(range(0, 20, 2))
    codes = [simhash.simhash(np.unique(simhash.shingle_hashes(t, 5))) for t in texts]
    assert all((a ^ b).bit_count() <= 3 for a, b in zip(codes[::2], codes[1::2]))
    assert sorted(x.doc_id for x in simhash.drop_near_duplicates(docs(texts)).collect()) == stays(texts)
