import corpus_pipeline
from synthframe.llm import queries
from synthframe.llm.simhash import shingle_hashes

from ..conftest import SMALL
from .test_decontaminate import brute as hits
from .test_quality import plainly_kept
from .test_simhash import groups
from .test_suffix_dedup import removed


def test_every_operator_and_the_pipeline_are_registered():
    import __spark_entry__
    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert set(queries.all_oracles()) <= set(queries.all_queries())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near dedup", "substring dedup", "decontamination", "tokens"]


def test_pipeline_matches_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    good = plainly_kept(docs)
    kept = [i for i in sorted(docs) if good[i]]
    sets = [set(shingle_hashes(docs[i], 5).tolist()) for i in kept]
    links = [(a, b) for a in range(len(kept)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    kept = [kept[g] for g in sorted(set(groups(len(kept), links)))]
    texts = {}
    for i, (_, mask) in zip(kept, removed([docs[i] for i in kept])):
        text, at = "", 0
        for c in docs[i]:
            size = len(c.encode())
            text += "" if all(mask[at:at + size]) else c
            at += size
        texts[i] = text
    clean = set()
    for i, text in texts.items():
        n, hit, _ = hits(text, items)
        if not (hit and 20 * hit >= n):
            clean.add(i)
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert rows.keys() == clean
    assert all(r.round_trip and r.parity and r.n_tokens == len(r.ids) for r in rows.values())
    columns = spark.read.parquet(f"{SMALL}/documents.parquet").columns
    frame = spark.read.parquet(f"{SMALL}/documents.parquet").limit(20)
    assert all(stage(spark, frame, SMALL).columns == columns for _, stage in corpus_pipeline.STAGES[:-1])
