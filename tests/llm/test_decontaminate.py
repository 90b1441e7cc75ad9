import re

import pytest
from check_oracle import table

from synthframe.llm.decontaminate import contaminated, contamination, remove_contaminated
from synthframe.llm.queries import all_oracles, all_queries

from ..conftest import SMALL


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, said in items:
        v = words(said)
        n = min(13, len(v))
        for s in range(max(0, len(v) - 13) + 1 if v else 0):
            for at in range(len(w) - n + 1):
                if w[at:at + n] == v[s:s + n]:
                    hit |= set(range(at, at + n))
                    found.add(item)
    return len(w), len(hit), sorted(str(i) for i in found if i is not None)


@pytest.mark.parametrize("block", [1 << 24, 40])
def test_matches_brute_force(spark, docs, edge_texts, prose, block):
    said = prose(3, seed=9, words=20)
    items = [(1, said[0]), (2, said[1].upper()), (10, "short ITEM here"), (4, ""), (5, None), (None, "null id item"), (1, said[0]), (7, "é")]
    texts = edge_texts + [f"lead {said[0]} tail", f"{said[1]}. {said[1]}", " ".join(said[0].split()[:13]), " ".join(said[0].split()[:12]), "a Short item, here! null id item é",
                          said[2] * 1, "x ".join(prose(2, seed=8))] + ["again short item here"] * 2
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = docs(texts)
    got = {r.doc_id: r for r in contamination(frame, bench, block_bytes=block).withColumn("bad", contaminated()).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        n, hit, found = brute(text, items)
        assert (got[i].n_words, got[i].n_hit, got[i]["items"], got[i].bad) == (n, hit, found, hit > 0 and 20 * hit >= n)
    kept = remove_contaminated(frame, bench, block_bytes=block)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].bad}
    assert got[len(edge_texts)].longest_match == 20


def test_empty_tables(spark, docs, prose):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in contamination(docs(prose(3)), bench).collect()} == {0}
    assert contamination(docs(prose(1)).filter("false"), spark.createDataFrame([(1, "some words")], bench.schema)).count() == 0


def test_query_equals_sql(spark, con):
    df = all_queries()["op8_training_suffix_arrays"](spark, SMALL)
    cursor = con.execute(all_oracles()["op8_training_suffix_arrays"])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in cursor.description], cursor.fetchall())
