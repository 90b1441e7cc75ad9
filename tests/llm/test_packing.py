import random
import zlib
from collections import Counter

from synthframe.llm.packing import CapacityTree, best_fit_decreasing, number_slots, pack_classes, pack_classes_evenly, pack_groups, pack_to_capacity
from synthframe.llm.queries import all_queries

from ..conftest import SMALL


def linear(sizes, capacity):
    rooms, bins = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(r, b) for b, r in enumerate(rooms) if r >= sizes[i]]
        if not fits:
            fits = [(max(capacity, sizes[i]), len(rooms))]
            rooms.append(fits[0][0])
        room, b = min(fits)
        rooms[b] = room - sizes[i]
        bins[i] = b
    return bins


def test_tree_packs_like_a_linear_search():
    r = random.Random(4)
    for _ in range(60):
        sizes = [r.choice([0, 1, 5, r.randint(1, 40)]) for _ in range(r.randint(0, 80))]
        assert best_fit_decreasing(sizes, 40) == linear(sizes, 40)
    tree = CapacityTree()
    for key in [(5, 0), (9, 1), (7, 2)]:
        tree.insert(key)
    assert [tree.take_tightest(6), tree.take_tightest(6), tree.take_tightest(6), tree.take_tightest(1)] == [(7, 2), (9, 1), None, (5, 0)]


def classes(sizes):
    return sorted(Counter(sizes).items())


def bins_of(runs, sizes):
    """Bin of each item, by its rank among the items of its size."""
    at = {(size, rank): found for size, first, end, found in runs for rank in range(first, end)}
    seen = Counter()
    out = []
    for s in sizes:
        out.append(at[s, seen[s]])
        seen[s] += 1
    assert len(at) == len(sizes)
    return out


def test_classes_are_packed_like_single_items():
    r = random.Random(8)
    for _ in range(200):
        sizes = [r.choice([0, 1, 5, 60, r.randint(1, 40)]) for _ in range(r.randint(0, 120))]
        assert bins_of(pack_classes(classes(sizes), 40), sizes) == best_fit_decreasing(sizes, 40)


def test_even_bins_are_near_equal_and_large_items_stand_alone():
    r = random.Random(5)
    sizes = [r.randint(1, 100) for _ in range(2000)]
    sums = [0] * 24
    for s, b in zip(sizes, bins_of(pack_classes_evenly(classes(sizes), 24), sizes)):
        sums[b] += s
    assert max(sums) - min(sums) <= 100
    with_giant = [10_000, 10_000, *sizes]
    bins = bins_of(pack_classes_evenly(classes(with_giant), 24), with_giant)
    assert bins.count(bins[0]) == bins.count(bins[1]) == 1 and max(bins) == 23
    assert pack_classes_evenly([], 3) == [] and pack_classes_evenly([(7, 1)], 3) == [(7, 0, 1, 0)] and pack_classes_evenly([(0, 5)], 3) == [(0, 0, 5, 0)]


def test_every_group_is_placed_by_the_packing(spark):
    r = random.Random(6)
    sizes = [r.choice([3, 7, 7, r.randint(0, 30), r.randint(100, 180)]) for _ in range(900)]
    rows = [(f"g{i}", s) for i, s in enumerate(sizes)] + [(None, None), ("big", 500), ("big", 50)]
    frame = spark.createDataFrame(rows, "k string, size long").repartition(3)
    groups = Counter()
    for k, s in rows:
        groups[k] += s or 0
    for got, plan in ((pack_groups(frame, "k", "size", 5), pack_classes_evenly(classes(groups.values()), 5)), (pack_to_capacity(frame, "k", "size", 200), pack_classes(classes(groups.values()), 200))):
        shard = {}
        for row in got.collect():
            assert shard.setdefault(row.k, row.shard) == row.shard
        assert shard.keys() == groups.keys()
        # as many groups of each size in each shard as the packing says
        assert Counter((groups[k], s) for k, s in shard.items()) == Counter({(size, found): n for (size, found), n in Counter((s, f) for s, a, b, f in plan for _ in range(b - a)).items()})
    loads = Counter()
    for k, s in shard.items():
        loads[s] += groups[k]
    assert all(v <= 200 or v == 550 for v in loads.values()) and len(loads) <= -(-sum(groups.values()) // 200) * 11 // 9 + 1


def test_groups_stay_together_also_a_hot_one(spark):
    rows = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"t{i // 2}", 100 + i % 7, 9) for i in range(6000)]
    frame = spark.createDataFrame(rows, "doc_id long, k string, size long, shard int")
    got = pack_groups(frame, "k", "size", 6).collect()
    assert len(got) == len(rows)
    assert all(len({r.shard for r in got if r.k == k}) == 1 for k in ("hot", None, "t40"))
    sums = {s: sum(r.size for r in got if r.shard == s) for s in range(6)}
    rest = sorted(v for s, v in sums.items() if s != next(r.shard for r in got if r.k == "hot"))
    assert rest[-1] <= 1.02 * rest[0]
    assert pack_groups(frame.filter("false"), "k", "size", 6).count() == 0


def test_slots_are_gapless_over_several_blocks(spark):
    frame = spark.range(1000).selectExpr("id", "cast(if(id % 3 = 0, 0, id % 5) as int) g")
    got = number_slots(frame, "g", ["id"], block_rows=50).collect()
    for g in {r.g for r in got}:
        mine = sorted(r.slot for r in got if r.g == g)
        assert mine == list(range(len(mine)))


def test_query_over_documents(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r for r in all_queries()["op10_best_fit_shards"](spark, SMALL).collect()}
    assert got.keys() == texts.keys()
    shard_of = {}
    for i, text in texts.items():
        assert (got[i].size, got[i].text_crc32, got[i].law, got[i].grown_shard) == (len(text.encode()) + 8, zlib.crc32(text.encode()), "bytes", None)
        assert shard_of.setdefault(text, got[i].shard) == got[i].shard
    for s in range(24):
        mine = sorted(r.slot for r in got.values() if r.shard == s)
        assert mine == list(range(len(mine)))
    groups = Counter()
    for i, text in texts.items():
        groups[text] += got[i].size
    assert Counter((groups[t], s) for t, s in shard_of.items()) == Counter((s, f) for s, a, b, f in pack_classes_evenly(classes(groups.values()), 24) for _ in range(b - a))
