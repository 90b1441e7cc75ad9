import re

import pytest

from synthframe.llm import licenses
from synthframe.llm.queries import all_queries

from ..conftest import SMALL

LINES = ["Released under the MIT License.", "under the mlt license", "under the bsd license", "Apache License, Version 2.0", "apache licence version 2", "apache license version 1",
         "(CC-BY-NC)", "cc by nd", "GNU General Public License v3", "gnu lesser general publc license", "under the mit licenses", "xunder the mit license", "under  the\nMIT license under the mit license",
         "Redistribution and use in source and binary form", "nothing here", "all rights reserved", "under the mit" + "x" * 300]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_base_places_and_fuzzy_labels_match_whole_text_search(docs, edge_texts, prose):
    texts = edge_texts + LINES + [f"{p} {line} {q}" for line, p, q in zip(LINES, prose(20), prose(20, seed=4))] + ["under the mit license"] * 2
    got = {r.doc_id: r for r in licenses.scan_licenses(docs(texts)).collect()}
    for i, text in enumerate(texts):
        w = words(text)
        base = sorted((label, at) for label, phrase in licenses.BASE_NOTICES for at in range(len(w)) if w[at:at + len(phrase.split())] == phrase.split())
        assert (got[i].n_words, sorted((b.label, b.word) for b in got[i].base)) == (len(w), base)
        line = " ".join(w)
        for notice in licenses.notices():
            mine = [m for m in got[i].matches if m.label == notice.label and abs(m.score - (1 - m.errors / len(notice.phrase))) < 1e-12]
            whole = [m for m in notice.pattern().finditer("  " + line, overlapped=True) if notice.accepts(m[0])]
            assert bool(whole) <= bool(mine)
            if whole:
                assert min(m.errors for m in mine) <= min(sum(m.fuzzy_counts) for m in whole)
        for m in got[i].matches:
            assert " ".join(w[m.first_word:m.first_word + m.n_words]) == m.found and 0 <= m.score <= 1


@pytest.mark.parametrize("line, label", [("under the mlt license", "mit"), ("apache licence version 2", "apache-2"), ("gnu lesser general publc license", "lgpl")])
def test_errors_are_tolerated(docs, line, label):
    assert label in {m.label for m in licenses.scan_licenses(docs([line])).first().matches}


@pytest.mark.parametrize("line", ["under the bsd license", "apache license version 1", "cc by nd", "nothing here"])
def test_other_licences_stay_apart(docs, line):
    assert not {m.label for m in licenses.scan_licenses(docs([line])).first().matches} & {"mit", "apache-2", "cc-by-nc"}


def test_query_and_empty_table(spark, docs):
    rows = all_queries()["op4_fuzzy_notices"](spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and (r.n_base > 0) == (r.first_word is not None) and 0 <= r.score <= 1
    assert licenses.scan_licenses(docs(["a"]).filter("false")).count() == 0
