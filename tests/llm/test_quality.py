import random
import re

import statistics

import zstandard

from synthframe.llm.quality import CompressionRules, fit_bands, keep_quality, length_class, quality_report, repeated_window_words
from synthframe.llm.queries import all_queries

SF = "/root/testdata/sf0.01"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    marked = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(marked)


def test_statistics_and_base_rule_match_brute_force(docs, edge_texts, prose):
    r = random.Random(1)
    texts = edge_texts + prose(5) + ["one two three four five six seven eight nine ten\n" * k for k in (1, 2, 3)] + [
        "\n".join(" ".join(r.choice("ab#|") for _ in range(r.randint(0, 9))) for _ in range(12)) for _ in range(20)] + ["same"] * 2
    got = {r["doc_id"]: r for r in quality_report(docs(texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = brute(text)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want
        assert got[i].base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (got[i].base_failed and got[i].kept)


def test_bands_keep_prose_and_reject_noise_and_repetition(docs, prose):
    r = random.Random(2)
    noise = " ".join("".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60)) for _ in range(60))
    repeated = " ".join(f"{i} buy now" for i in range(2000))
    clean = prose(10) + prose(3, words=4000)
    kept = {r.doc_id: r.kept for r in quality_report(docs([noise, repeated, *clean])).collect()}
    assert not kept[0] and not kept[1]
    assert all(kept[i] for i in range(2, len(clean) + 2))


def test_keep_returns_whole_rows_and_takes_empty_tables(docs, prose):
    frame = docs([None, "", *prose(3)])
    assert {r.doc_id for r in keep_quality(frame).collect()} == {2, 3, 4}
    assert keep_quality(frame).columns == frame.columns
    assert quality_report(frame.filter("false")).count() == 0 and keep_quality(frame.filter("false"), CompressionRules()).count() == 0
    assert repeated_window_words(["a"] * 7) == 7


def plainly_kept(texts):
    """{id: kept} of {id: text}: the base rule, then bands from medians of lists, then the share of bad chunks."""
    def ratio(data):
        return len(zstandard.ZstdCompressor(level=3).compress(data)) / len(data)

    passed, classes, rules = {}, {}, CompressionRules()
    for i, text in texts.items():
        n, _, _, _, repeated = brute(text)
        if n >= 10 and 100 * repeated <= 20 * n:
            data = passed[i] = text.encode()
            classes.setdefault(length_class(len(data)), []).append(round(1000 * ratio(data)))
    kept = dict.fromkeys(texts, False)
    for i, data in passed.items():
        own = classes[length_class(len(data))]
        if len(own) >= 20:
            middle = statistics.median_low(own)
            spread = 1.4826 * max(statistics.median_low([abs(v - middle) for v in own]), 1)
            low, high = (middle - 3.5 * spread) / 1000, (middle + 6 * spread) / 1000
        else:
            low, high = next((b.low, b.high) for b in rules.document if len(data) <= b.max_bytes)
        n = len(data) // 4096 if len(data) > 4096 else 0
        bad = sum(not 0.15 <= ratio(data[k * 4096:(k + 1) * 4096 if k < n - 1 else len(data)]) <= 0.75 for k in range(n))
        kept[i] = low <= ratio(data) <= high and bad <= 0.25 * n
    return kept


def test_fitted_bands_decide_like_a_plain_computation(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in all_queries()["op2_compression_bands"](spark, SF).collect()}
    want = plainly_kept(texts)
    assert {i: r.kept for i, r in rows.items()} == want
    assert sum(not r.base_failed and not r.kept for r in rows.values()) > 20


def test_bands_reject_what_labels_call_bad(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in all_queries()["op2_compression_bands"](spark, SF).collect() if r.doc_id in labels and not r.base_failed]
    lost = [labels[r.doc_id] for r in rows if not r.kept]
    assert lost.count(0) >= 0.5 * sum(labels[r.doc_id] == 0 for r in rows) and lost.count(1) <= 0.1 * len(lost)


def test_length_classes_and_small_tables(docs, prose):
    for n in [*range(1, 300), 2**20 - 1, 2**20, 2**20 + 1]:
        c = length_class(n)
        assert 2 ** (c / 2) <= n < 2 ** ((c + 1) / 2)
    assert fit_bands(docs([None, ""])) == fit_bands(docs(["x"]).filter("false")) == CompressionRules()
    fitted = fit_bands(docs(prose(40)))
    assert [b.max_bytes for b in fitted.document] == sorted({b.max_bytes for b in fitted.document}) and fitted != CompressionRules()
