"""SimHash near-duplicates with BK-trees.

Fingerprints are dealt to shards such that any two within the radius meet in one: a fingerprint is cut
into blocks, and codes that differ in at most r bits agree on all but r of the blocks. Each shard builds a
BK-tree (children keyed by their integer Hamming distance to the parent) and every code follows only
edges within the radius. Trees are shuffled to their codes, not broadcast, for they grow with the corpus.
A shard returns a spanning forest of the links it found, nearest first, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import Column, DataFrame

from ..session import scratch_path
from .components import connected_components
from .texts import text_slices
from .words import mixed

SEED = 42
#: Codes of one tree; a shard with more is cut into several trees.
TREE_CODES = 4096
#: Up to this radius each edge that may be followed is looked up; beyond it most are, and a code's own edges are listed.
NARROW = 8
#: Codes that search a tree together.
QUERY_CODES = 256
#: Codes a shard should hold on average; more codes get more and narrower shards.
SHARD_CODES = 64


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each shingle of lower-cased (A-Z) words; a shorter text is one shingle, one without words none."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    whole = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = ends - [len(w) for w in found]
    n = max(1, len(found) - words + 1)
    last = ends[min(words, len(found)) - 1 :]
    return np.array([xxhash.xxh64_intdigest(whole[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """A bit is set if it is set in more than half of the hashes."""
    counts = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[low : low + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, ``code``): the 64-bit fingerprint of each row as a signed long; null and empty texts have code 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for part in text_slices(batches, "_text"):
            codes = np.array([simhash(shingle_hashes(t or "", words)) for t in part.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codes.view(np.int64))], [id_col, "code"])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, code long")


# --- trees -------------------------------------------------------------------------------------


def bk_tree(codes: np.ndarray) -> np.ndarray:
    """Children of each code (rows) by distance 0 to 64 (columns), -1 where none; code 0 is the root.

    ``codes`` are distinct. All codes go down the tree in step; of those that want one free place, the first takes it.
    """
    child = np.full((len(codes), 65), -1, np.int32)
    left, at = np.arange(1, len(codes)), np.zeros(len(codes) - 1, np.int64)
    while len(left):
        distance = np.bitwise_count(codes[left] ^ codes[at]).astype(np.int64)
        place = at * 65 + distance
        taken = child.ravel()[place]
        free = np.flatnonzero(taken < 0)
        spots, first = np.unique(place[free], return_index=True)
        child.ravel()[spots] = left[free[first]]
        at = child.ravel()[place].astype(np.int64)
        down = at != left
        left, at = left[down], at[down]
    return child


def search_tree(codes: np.ndarray, child: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, code, distance) of all codes within ``radius``; only edges whose distance can lead there are followed."""
    query, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
    found = []
    if radius > NARROW:
        above, edges = np.nonzero(child >= 0)
        children = child[above, edges].astype(np.int64)
        ends = np.searchsorted(above, np.arange(len(codes) + 1))
        many = np.diff(ends)
    while len(query):
        distance = np.bitwise_count(queries[query] ^ codes[node]).astype(np.int64)
        near = distance <= radius
        found.append((query[near], node[near], distance[near]))
        if radius > NARROW:
            parent = np.repeat(np.arange(len(node)), many[node])
            edge = np.arange(len(parent)) + np.repeat(ends[node] - np.cumsum(many[node]) + many[node], many[node])
            ok = np.abs(edges[edge] - distance[parent]) <= radius
            query, node = query[parent[ok]], children[edge[ok]]
            continue
        down = []
        for step in range(-radius, radius + 1):
            edge = distance + step
            ok = np.flatnonzero((edge >= 0) & (edge <= 64))
            below = child[node[ok], edge[ok]]
            some = below >= 0
            down.append((query[ok[some]], below[some].astype(np.int64)))
        query, node = (np.concatenate(v) for v in zip(*down))
    return tuple(np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def spanning_forest(a: np.ndarray, b: np.ndarray, distance: np.ndarray, n: int) -> np.ndarray:
    """Indices of links that join ``n`` points as all links do, nearest links first (Kruskal)."""
    parent, kept = list(range(n)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    order = np.argsort(distance, kind="stable")
    for low in range(0, len(order), 1 << 14):
        part = order[low : low + (1 << 14)]
        roots = np.array([root(x) for x in range(n)]) if n < len(part) else None
        if roots is not None:
            part = part[roots[a[part]] != roots[b[part]]]
        for i in part.tolist():
            x, y = root(int(a[i])), root(int(b[i]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                kept.append(i)
    return np.array(kept, np.int64)


def _tree_links(radius: int):
    """Task: rows sorted by (key, tree): members (``part`` = tree) and visitors, to forest links (a, b)."""
    def run(batches):
        held, last = [], None
        for batch in batches:
            columns = [batch.column(n).to_numpy() for n in ("key", "tree", "part", "code", "node")]
            bounds = np.flatnonzero((columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])) + 1
            for low, high in zip([0, *bounds.tolist()], [*bounds.tolist(), batch.num_rows]):
                here = (columns[0][low], columns[1][low])
                if here != last and held:
                    yield from _links(held, radius)
                    held = []
                last = here
                held.append([c[low:high] for c in columns[1:]])
        if held:
            yield from _links(held, radius)

    return run


def _links(held, radius: int) -> Iterator[pa.RecordBatch]:
    tree, part, code, node = (np.concatenate(v) for v in zip(*held))
    code = code.view(np.uint64)
    order = np.argsort(part != tree, kind="stable")  # members first
    part, code, node = part[order], code[order], node[order]
    members = int((part == tree[0]).sum())
    if members == 0 or len(code) < 2:
        return
    own, of = np.unique(code[:members], return_inverse=True)
    first = np.full(len(own), -1, np.int64)
    first[of[::-1]] = np.arange(members)[::-1]
    child = bk_tree(own)
    kept_a, kept_b, kept_d = (np.zeros(0, np.int64) for _ in range(3))
    for low in range(0, len(code), QUERY_CODES):
        query = np.arange(low, min(low + QUERY_CODES, len(code)))
        q, at, distance = search_tree(own, child, code[query], radius)
        a, b = query[q], first[at]
        ok = a != b
        a, b, distance = a[ok], b[ok], distance[ok]
        if len(a):
            # one forest over all searches so far: a tree never returns more links than it saw codes
            a, b, distance = np.concatenate((kept_a, a)), np.concatenate((kept_b, b)), np.concatenate((kept_d, distance))
            points, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
            kept = spanning_forest(ends[: len(a)], ends[len(a) :], distance, len(points))
            kept_a, kept_b, kept_d = a[kept], b[kept], distance[kept]
    yield pa.RecordBatch.from_arrays([pa.array(node[kept_a]), pa.array(node[kept_b])], ["a", "b"])


def near_links(keyed: DataFrame, radius: int) -> DataFrame:
    """Forest links (a, b) between nodes whose codes are within ``radius`` and that share a ``key``.

    ``keyed``: key (long), code (long), node (long). Keys with one row are dropped. A key with more than
    ``TREE_CODES`` rows is cut into trees by the node's hash; a code visits its own tree and the later ones.
    """
    sizes = keyed.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key", F.ceil(F.col("_n") / TREE_CODES).cast("int").alias("_trees"))
    placed = keyed.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("_trees")).cast("int"))
    visits = placed.withColumn("tree", F.explode(F.sequence("part", F.col("_trees") - 1))).select("key", "tree", "part", "code", "node")
    # a search costs far more than its bytes say, so these tasks must not be merged by size
    tasks = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (visits.repartition(tasks, "key", "tree").sortWithinPartitions("key", "tree", "code", "node")
            .mapInArrow(_tree_links(radius), "a long, b long"))


def block_keys(code: Column, radius: int, blocks: int) -> list[Column]:
    """Keys of a code for ``blocks`` blocks: one per choice of ``blocks - radius`` blocks that must agree."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.xxhash64(F.lit(number), code.bitwiseAND(F.lit(mask).cast("long"))))
    return keys


def _blocks(codes: int, radius: int) -> int:
    """Blocks to cut codes into: as few as leave ``SHARD_CODES`` to a shard on average."""
    blocks = radius + 1
    while blocks < radius + 4 and codes > SHARD_CODES << (64 * (blocks - radius) // blocks):
        blocks += 1
    return blocks


def near_components(codes: DataFrame, id_col: str = "doc_id", radius: int = 3) -> DataFrame:
    """(id, code, ``component``) per row: the smallest id reachable over codes that differ in ``radius`` bits or fewer.

    Rows with equal codes are linked; repeated rows stay. A null id is never the smallest unless alone.
    """
    alone = codes.groupBy("code").agg(F.min(id_col).alias("_id"))
    keys = F.explode(F.array(*block_keys(F.col("code"), radius, _blocks(alone.count(), radius)))).alias("key")
    links = near_links(alone.select(keys, "code", F.col("code").alias("node")), radius)
    found = connected_components(links)
    rooted = alone.join(found.withColumnRenamed("node", "code"), "code", "left").withColumn("_root", F.coalesce("component", "code")).drop("component")
    smallest = rooted.groupBy("_root").agg(F.min("_id").alias("component"))
    return codes.join(rooted.join(smallest, "_root").select("code", "component"), "code").select(id_col, "code", "component")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """(id, ``fingerprint`` as 16 hex digits, ``component_id``) per row of ``docs``; other columns are not read."""
    path = scratch_path(docs.sparkSession, "fingerprints")
    fingerprints(docs, id_col, text_col, words).write.parquet(path)
    found = near_components(docs.sparkSession.read.parquet(path), id_col, radius)
    return found.select(id_col, F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


# --- one document of each group -------------------------------------------------------------------

#: Words of a shingle, least Jaccard similarity of shingle sets, and minima per document: two documents of
#: similarity s share none of them with probability (1 - s)**MINIMA.
WORDS, SIMILARITY, MINIMA = 5, 0.8, 8
#: Bits within which a tree is searched for similar sets; pairs at 0.8 differ in 9.7 of 64 bits on average.
WIDE_RADIUS = 20
#: Pairs that a tree search may return at once.
SEARCH_PAIRS = 1 << 18
#: Shingles that a tree of a shard should hold on average, and that are sent on or checked at once.
TREE_SHINGLES, SENT_SHINGLES = 4 << 20, 1 << 20


def _sketches(words: int):
    """Task: texts to (content, code, shingles, minima): fingerprint and size of the shingle set, and the smallest shingle hash in each of some orders."""
    def run(batches):
        for part in text_slices(batches, "_text"):
            codes, sizes, minima = [], [], []
            for text in part.column("_text").to_pylist():
                hashes = np.unique(shingle_hashes(text, words))  # a shingle counts once, as in the similarity
                codes.append(simhash(hashes))
                sizes.append(len(hashes))
                minima.append([int(mixed(hashes + np.uint64(i * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)).min().view(np.int64)) for i in range(MINIMA)] if len(hashes) else [0])
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("content"), pa.array(np.array(codes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(minima, pa.list_(pa.int64()))],
                                              ["_id", "content", "code", "shingles", "minima"])

    return run


def _visiting_sets(words: int):
    """Task: (content, code, text, visits) to one row per visit with the distinct shingle hashes, sorted."""
    def run(batches):
        for part in text_slices(batches, "_text"):
            sets = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in part.column("_text").to_pylist()]
            visits = part.column("visits")
            of = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(visits).to_numpy())
            flat = visits.flatten()
            upto = np.cumsum(np.array([len(x) for x in sets], np.int64)[of])
            low = 0
            while low < len(of):
                high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + SENT_SHINGLES, "right")))
                yield pa.RecordBatch.from_arrays(
                    [flat.field(n)[low:high] for n in ("key", "tree", "part")] + [part.column(n).take(pa.array(of[low:high])) for n in ("content", "code")]
                    + [pa.array([sets[i] for i in of[low:high]], pa.list_(pa.int64()))], ["key", "tree", "part", "content", "code", "shingles"])
                low = high

    return run


def similar_forest(values: np.ndarray, sizes: np.ndarray, similarity: float, labels: np.ndarray, old: int = 0, codes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (a, b) that join sets as all pairs of Jaccard similarity ``similarity`` or more do; each link is such a pair.

    ``values`` are the sets one after another. With ``old``, pairs of one of the first ``old`` sets and one of
    the others are looked at, else all pairs. ``labels`` say which sets are joined already, and are updated.
    ``codes`` are the fingerprints of the sets, computed here if they are not given.

    Pairs come from a BK-tree over the fingerprints, within ``WIDE_RADIUS`` bits, the nearest of each set first; an exact
    check decides each one, and a pair that fails it stays unlinked. Pairs that are farther apart are checked after them.
    No pair is lost: of two similar sets, each has one of their common values among its first
    ``size - ceil(similarity * size) + 1`` in any order that both share (here rare values first), so pairs that
    share such a value are checked whole, except where checked links join them already.
    """
    n, links = len(sizes), []
    if codes is None:
        codes = np.array([simhash(x.view(np.uint64)) for x in np.split(values, np.cumsum(sizes)[:-1])], np.uint64)
    known, ids, found = np.unique(values, return_inverse=True, return_counts=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    marks = np.zeros(len(known), bool)

    def join(a: int, b: int) -> None:
        links.append((a, b))
        labels[labels == max(labels[a], labels[b])] = min(labels[a], labels[b])

    def check(a: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that are similar to ``a``."""
        marks[ids[starts[a] : ends[a]]] = True
        near = []
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes[others]) // SENT_SHINGLES)) + 1
        for some in np.split(others, cuts):
            upto = np.cumsum(sizes[some])
            at = np.arange(upto[-1]) + np.repeat(starts[some] - upto + sizes[some], sizes[some])
            common = np.add.reduceat(marks[ids[at]], upto - sizes[some], dtype=np.int64)
            near.append(some[common >= similarity * (sizes[a] + sizes[some] - common)])
        marks[ids[starts[a] : ends[a]]] = False
        return np.concatenate(near)

    def likely(a, b) -> np.ndarray:
        """Not joined, and of sizes that allow the similarity."""
        x, y = sizes[a], sizes[b]
        return (labels[a] != labels[b]) & (np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-6) & ((a < old) & (b >= old) if old else True)

    empty = np.flatnonzero(sizes == 0)
    for a, b in zip(empty[:-1].tolist(), empty[1:].tolist()):
        if labels[a] != labels[b]:
            join(a, b)
    rank = np.empty(len(known), np.int64)
    rank[np.argsort(found, kind="stable")] = np.arange(len(known))
    of = np.repeat(np.arange(n), sizes)
    order = np.lexsort((rank[ids], of))
    first = sizes - np.ceil(similarity * sizes - 1e-6).astype(np.int64) + 1
    kept = order[(np.arange(len(of)) - starts[of] < first[of]) & (found[ids[order]] > 1)]
    token, doc = ids[kept], of[kept]
    order = np.argsort(token, kind="stable")
    token, doc = token[order], doc[order]  # by value, then by set

    # each set's values among them, and the list of each value
    heads = np.searchsorted(token, token)
    tails = np.searchsorted(token, token, "right")
    by_doc = np.argsort(doc, kind="stable")
    doc_ends = np.searchsorted(doc[by_doc], np.arange(n + 1))

    def sharing(b: int) -> np.ndarray:
        """Which sets have one of these values in common with ``b``."""
        seen = np.zeros(n, bool)
        for i in by_doc[doc_ends[b] : doc_ends[b + 1]].tolist():
            seen[doc[heads[i] : tails[i]]] = True
        return seen

    def settle(b: int, others: np.ndarray) -> None:
        for a in check(b, others).tolist() if len(others) else []:
            if labels[a] != labels[b]:
                join(a, b)

    # what the tree finds
    own, of_code = np.unique(codes[: old or n], return_inverse=True)
    child = bk_tree(own)
    by_code = np.argsort(of_code, kind="stable")
    alike = np.bincount(of_code, minlength=len(own))
    group = max(1, SEARCH_PAIRS // len(of_code))
    for low in range(old, n, group):
        query, at, distance = search_tree(own, child, codes[low : min(low + group, n)], WIDE_RADIUS)
        many = alike[at]
        upto = np.cumsum(many)
        a = by_code[np.arange(many.sum()) + np.repeat((np.cumsum(alike) - alike)[at] - upto + many, many)]
        b, distance = np.repeat(query + low, many), np.repeat(distance, many)
        ok = likely(a, b) & (a < b)
        a, b, distance = a[ok], b[ok], distance[ok]
        order = np.lexsort((distance, b))
        a, b = a[order], b[order]
        nearest = np.flatnonzero(np.diff(b, prepend=-1))
        for x, y in zip(a[nearest].tolist(), b[nearest].tolist()):
            if labels[x] != labels[y]:
                settle(y, np.array([x]))
        ok = labels[a] != labels[b]
        a, b = a[ok], b[ok]
        for some in np.split(a, np.flatnonzero(np.diff(b)) + 1) if len(a) else []:
            y = int(b[0])
            b = b[len(some) :]
            some = some[labels[some] != labels[y]]
            if len(some):
                settle(y, some[sharing(y)[some]])

    # pairs beyond its radius: values in whose lists not everything is joined
    if len(token):
        starts_of = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        mixed_lists = np.minimum.reduceat(labels[doc], starts_of) != np.maximum.reduceat(labels[doc], starts_of)
        left = np.repeat(mixed_lists, np.diff(np.concatenate((starts_of, [len(token)]))))
        for b in np.unique(doc[left]).tolist():
            if b >= old:
                others = np.flatnonzero(sharing(b)[:b])
                others = others[likely(others, np.full(len(others), b))]
                settle(b, others[np.bitwise_count(codes[others] ^ codes[b]) > WIDE_RADIUS])
    return links


class _Tree:
    """The sets of one tree: members are held, visitors are looked at in groups, so that memory is bounded."""

    def __init__(self, similarity: float):
        self.similarity, self.members, self.visitors, self.labels, self.links = similarity, [], [], None, []

    def add(self, visits: bool, rows: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> None:
        (self.visitors if visits else self.members).append(rows)
        if visits and (sum(len(x[0]) for x in self.visitors) >= TREE_CODES or sum(len(x[2]) for x in self.visitors) >= TREE_SHINGLES):
            self.look()

    def look(self) -> None:
        if not self.members:
            return
        if self.labels is None:
            self.members = [tuple(np.concatenate(x) for x in zip(*self.members))]
            self.labels = np.arange(len(self.members[0][0]))
            self._link(self.members, self.labels, 0)
        if self.visitors:
            old = len(self.labels)
            more = sum(len(x[0]) for x in self.visitors)
            labels = np.concatenate((self.labels, np.arange(old, old + more)))
            self._link(self.members + self.visitors, labels, old)
            self.labels, self.visitors = labels[:old], []

    def _link(self, rows, labels: np.ndarray, old: int) -> None:
        node, sizes, values, codes = (np.concatenate(x) for x in zip(*rows))
        if len(node) > 1:
            self.links += [(node[a], node[b]) for a, b in similar_forest(values, sizes, self.similarity, labels, old, codes)]


def _checked_links(similarity: float):
    """Task: sets sorted by (key, tree), members (``part`` = tree) before visitors, to checked links (a, b)."""
    def run(batches):
        tree, last, links = None, None, []
        for batch in batches:
            key, number, part, node, code = (batch.column(n).to_numpy() for n in ("key", "tree", "part", "content", "code"))
            code = code.view(np.uint64)
            offsets, values = batch.column("shingles").offsets.to_numpy().astype(np.int64), batch.column("shingles").values.to_numpy()
            visits = part != number
            bounds = np.flatnonzero((key[1:] != key[:-1]) | (number[1:] != number[:-1]) | (visits[1:] != visits[:-1])) + 1
            for low, high in zip([0, *bounds.tolist()], [*bounds.tolist(), batch.num_rows]):
                here = (key[low], number[low])
                if here != last:
                    if tree:
                        tree.look()
                        links += tree.links
                    tree, last = _Tree(similarity), here
                tree.add(bool(visits[low]), (node[low:high], np.diff(offsets[low : high + 1]), values[offsets[low] : offsets[high]], code[low:high]))
            if len(links) >= 1 << 12:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"])
                links = []
        if tree:
            tree.look()
            links += tree.links
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"])

    return run


def similar_links(docs: DataFrame, keyed: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) of texts that share a ``key``, which join them as all pairs of the similarity do.

    ``docs``: content (long), _text; ``keyed``: key, content, code (longs), shingles (size of the set). Keys
    with one text are dropped, and of keys with the same texts one stays. A key with more than ``TREE_CODES``
    texts or ``TREE_SHINGLES`` shingles is cut into trees by the content; a text visits its own tree and the later ones.
    """
    node = F.col("content")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("_n"), F.sum("shingles").alias("_shingles"), F.bit_xor(F.xxhash64(node)).alias("_x"), F.bit_xor(F.xxhash64(node, F.lit(1))).alias("_y"))
    trees = F.ceil(F.greatest(F.col("_n") / TREE_CODES, F.least("_n", F.col("_shingles") / TREE_SHINGLES))).cast("int")
    sizes = sizes.filter("_n > 1").groupBy("_n", "_shingles", "_x", "_y").agg(F.min("key").alias("key")).select("key", trees.alias("_trees"))
    placed = keyed.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("content"), F.col("_trees")).cast("int"))
    visits = placed.withColumn("tree", F.explode(F.sequence("part", F.col("_trees") - 1)))
    visits = visits.groupBy("content", "code").agg(F.collect_list(F.struct("key", "tree", "part")).alias("visits"))
    texts = docs.groupBy("content").agg(F.first("_text").alias("_text"))
    sets = (texts.join(visits, "content").select("content", "code", "_text", "visits")
            .mapInArrow(_visiting_sets(words), "key long, tree int, part int, content long, code long, shingles array<long>"))
    # a check costs more than its bytes say, so these tasks must not be merged by size
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (sets.repartition(tasks, "key", "tree").sortWithinPartitions("key", "tree", F.col("part") != F.col("tree"), "content")
            .mapInArrow(_checked_links(similarity), "a long, b long"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest id.

    Groups are components of links between equal texts and between texts whose sets of ``words``-word shingles
    (A-Z folded) have a Jaccard similarity of ``similarity`` or more. Each set has a SimHash fingerprint; candidates
    are in one component of fingerprints 3 bits apart (``near_components``), or share one of ``MINIMA`` smallest shingle
    hashes. Each such shard has a BK-tree over its fingerprints, and all that it finds, then what lies beyond its radius,
    is decided on the whole sets before any link is left out (see ``similar_forest``). A null text is empty; texts without words are equal to each other. A null id counts as larger than any
    other, and of rows equal in id and text one stays. All columns stay, whatever their names. Texts are told apart by a
    64-bit hash alone: two texts of one hash count as equal, which at n distinct texts is expected n * n / 2 ** 65 times.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    content = F.xxhash64(text)
    path = scratch_path(spark, "sketches")
    (docs.select(F.col(f"`{id_col}`").alias("_id"), content.alias("content"), text.alias("_text"))
     .mapInArrow(_sketches(words), f"_id {kind}, content long, code long, shingles long, minima array<long>").write.parquet(path))
    first = F.struct(F.col("_id").isNull().alias("_null"), "_id")
    alone = spark.read.parquet(path).groupBy("content").agg(F.min(first).alias("_first"), *[F.first(c).alias(c) for c in ("code", "shingles", "minima")])
    path = scratch_path(spark, "near-codes")
    near_components(alone.select("content", "code"), "content").write.parquet(path)
    close = spark.read.parquet(path).select("content", F.xxhash64(F.lit("codes"), "component").alias("key")).join(alone, "content")
    keyed = alone.select("*", F.posexplode("minima")).withColumn("key", F.xxhash64("pos", "col"))
    keyed = keyed.select("key", "content", "code", "shingles").unionByName(close.select("key", "content", "code", "shingles"))
    path = scratch_path(spark, "near-links")
    similar_links(docs.select(content.alias("content"), text.alias("_text")), keyed, words, similarity).write.parquet(path)
    found = connected_components(spark.read.parquet(path)).withColumnRenamed("node", "content")
    rooted = alone.join(found, "content", "left").select(F.coalesce("component", "content").alias("_root"), "_first", "content")
    kept = rooted.groupBy("_root").agg(F.min(F.struct("_first", "content")).alias("_kept")).select(F.col("_kept.content").alias("_kept_content"), F.col("_kept._first._id").alias("_kept_id"))
    # whole rows travel in one column, so that no name of theirs meets another
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_id"), content.alias("_content"))
    return (rows.join(kept, (F.col("_content") == F.col("_kept_content")) & F.col("_id").eqNullSafe(F.col("_kept_id")), "left_semi")
            .dropDuplicates(["_id", "_content"]).select("_row.*"))
