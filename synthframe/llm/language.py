"""Language of words and documents by a linear-chain conditional random field.

Every word has features: its first and last bytes, its byte n-grams and itself (a lexicon). Features are
hashed into a table of weights per language; learned transitions tie neighbouring words, so that
code-switched text is labelled in runs. Forward-backward gives each word's probabilities, and a document's
language is the one with the largest expected number of letters.

Training takes a bounded sample of labelled rows on the driver; prediction covers every word of every text.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame, Window

from .texts import text_slices
from .words import mixed


def _ranges(kinds: str, first: int, end: int) -> str:
    """Characters of a range whose Unicode category begins with one of ``kinds``, as the inside of a character class."""
    out, start = [], None
    for code in range(first, end + 1):
        inside = code < end and unicodedata.category(chr(code))[0] in kinds
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return "".join(out)


def _one(kinds: str, many: str = "") -> str:
    """A character of some kinds. The common plane is one table in the pattern engine; others are only tried on their like."""
    plane, above = 0x10000, sys.maxunicode + 1
    return f"(?:[{_ranges(kinds, 0, plane)}]{many}|(?=[\\U00010000-\\U0010ffff])[{_ranges(kinds, plane, above)}])"


#: A letter, then letters and the marks that belong to them, also past an apostrophe; digits, other numerals and signs
#: say nothing about a language.
WORD = re.compile(f"{_one('L')}{_one('LM', '++')}*+(?:['’]{_one('L')}{_one('LM', '++')}*+)*+")
#: Hash buckets of features. Bytes of prefixes and suffixes, and of n-grams.
BUCKETS, AFFIXES, GRAMS = 1 << 17, (2, 3, 4), (2, 3, 4)
#: Distinct texts per language in the training sample, pieces per language that are cut from them, and words of one
#: training chain, which two pieces make.
SAMPLE_TEXTS, SAMPLE_PIECES, CHAIN = 200, 4000, 40
#: Words that walk forward and backward in step before blocks of a document are joined; words held at once.
BLOCK, SLICE_BYTES = 64, 4 << 20


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # buckets x labels
    transitions: np.ndarray  # from x to


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every feature of some words, in numpy over all their bytes at once."""
    wrapped = b"".join(b"^" + w + b"$" for w in words)
    data = np.frombuffer(wrapped, np.uint8).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    word_of = np.repeat(np.arange(len(words)), lengths)
    buckets, owners = [], []

    def add(value: np.ndarray, salt: int, owner: np.ndarray) -> None:
        buckets.append((mixed(value + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & np.uint64(BUCKETS - 1)).astype(np.int64))
        owners.append(owner)

    packed = data.copy()
    for n in range(2, max(*AFFIXES, *GRAMS) + 2):
        packed = (packed[:-1] << np.uint64(8)) | data[n - 1 :] if len(packed) > 1 else packed[:0]
        at = np.arange(len(packed))
        inside = at + n <= ends[word_of[: len(packed)]] if len(packed) else np.zeros(0, bool)
        if n in GRAMS:
            add(packed[inside], n, word_of[: len(packed)][inside])
        if n - 1 in AFFIXES:  # one sign of the word's edge and n-1 bytes
            long = lengths > n
            add(packed[starts[long]], 20 + n, np.flatnonzero(long))
            add(packed[ends[long] - n], 40 + n, np.flatnonzero(long))
    add(np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64), 1, np.arange(len(words)))
    return np.concatenate(buckets), np.concatenate(owners)


def emissions(words: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Score of each label for each word: the mean weight of its features, times the root of their number."""
    if not words:
        return np.zeros((0, weights.shape[1]))
    bucket, owner = word_features(words)
    number = np.bincount(owner, minlength=len(words))
    sums = np.stack([np.bincount(owner, weights[bucket, k], minlength=len(words)) for k in range(weights.shape[1])], axis=1)
    return sums / np.sqrt(number)[:, None]


def text_words(text: str) -> list[bytes]:
    return [w.encode() for w in WORD.findall(text.lower())]


# --- training -------------------------------------------------------------------------------------


def _chain_gradient(e: np.ndarray, transitions: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood of chains (chains x words x labels) by emissions and by transitions."""
    m, t, k = e.shape
    step = np.exp(transitions)
    f = np.exp(e - e.max(axis=2, keepdims=True))
    alpha, beta = np.empty_like(f), np.empty_like(f)
    alpha[:, 0] = f[:, 0] / f[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        a = alpha[:, i - 1] @ step * f[:, i]
        alpha[:, i] = a / a.sum(axis=1, keepdims=True)
    beta[:, -1] = 1.0
    for i in range(t - 2, -1, -1):
        b = (beta[:, i + 1] * f[:, i + 1]) @ step.T
        beta[:, i] = b / b.sum(axis=1, keepdims=True)
    marginal = alpha * beta
    marginal /= marginal.sum(axis=2, keepdims=True)
    pair = alpha[:, :-1, :, None] * step[None, None] * (beta[:, 1:] * f[:, 1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    truth = np.eye(k)[gold]
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1.0)
    return truth - marginal, seen - pair.sum(axis=(0, 1))


def piece_bounds(n: int) -> list[tuple[int, int]]:
    """Pieces of half a chain that cover ``n`` words: the last one ends with the text, a shorter text is one piece."""
    half = CHAIN // 2
    return [(low, low + half) for low in range(0, n - half + 1, half)] + ([(max(0, n - half), n)] if n % half else [])


def train(rows: list[tuple[str, str]], epochs: int = 6, rate: float = 0.3, decay: float = 1e-4, seed: int = 7) -> Model:
    """A model from (text, label) rows. Pieces are cut from all of each text, and half of the chains join pieces of two texts, so
    that transitions between languages are learned. AdaGrad on the conditional likelihood; deterministic for given rows."""
    labels = sorted({label for _, label in rows})
    if not labels:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)))
    rng = np.random.default_rng(seed)
    vocabulary: dict[bytes, int] = {}
    halves, gold = [], []
    for text, label in sorted(rows):
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in text_words(text)]
        for low, high in piece_bounds(len(ids)):
            # a text shorter than a piece goes round
            halves.append((ids[low:high] * (CHAIN // 2))[: CHAIN // 2])
            gold.append(labels.index(label))
    if not halves:
        return Model(labels, np.zeros((BUCKETS, len(labels))), np.zeros((len(labels), len(labels))))
    words = list(vocabulary)
    bucket, owner = word_features(words)
    number = np.sqrt(np.bincount(owner, minlength=len(words)))
    first = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(words)))))
    bucket = bucket[np.argsort(owner, kind="stable")]
    halves, gold = np.array(halves), np.array(gold)
    k = len(labels)
    weights, transitions = np.zeros((BUCKETS, k)), np.zeros((k, k))
    squares, squares_t = np.full((BUCKETS, k), 1e-6), np.full((k, k), 1e-6)
    partners = np.arange(len(halves)) ^ 1
    partners[partners >= len(halves)] = 0
    for epoch in range(epochs):
        other = np.where(rng.random(len(halves)) < 0.5, partners, rng.integers(0, len(halves), len(halves)))
        order = rng.permutation(len(halves))
        for low in range(0, len(order), 64):
            one = order[low : low + 64]
            two = other[one]
            ids = np.concatenate((halves[one], halves[two]), axis=1)
            truth = np.repeat(np.stack((gold[one], gold[two]), axis=1), CHAIN // 2, axis=1)
            distinct, place = np.unique(ids, return_inverse=True)
            parts = [bucket[first[w] : first[w + 1]] for w in distinct]
            flat, of = np.concatenate(parts), np.repeat(np.arange(len(distinct)), [len(p) for p in parts])
            scale = number[distinct][:, None]
            e = np.stack([np.bincount(of, weights[flat, j], minlength=len(distinct)) for j in range(k)], axis=1) / scale
            by_word, by_transition = _chain_gradient(e[place.reshape(ids.shape)], transitions, truth)
            g = np.zeros((len(distinct), k))
            np.add.at(g, place.ravel(), by_word.reshape(-1, k))
            g = (g / scale)[of]
            touched, where = np.unique(flat, return_inverse=True)
            gradient = np.stack([np.bincount(where, g[:, j], minlength=len(touched)) for j in range(k)], axis=1) / len(one) - decay * weights[touched]
            squares[touched] += gradient**2
            weights[touched] += rate * gradient / np.sqrt(squares[touched])
            by_transition = by_transition / ids.size - decay * transitions
            squares_t += by_transition**2
            transitions += rate * by_transition / np.sqrt(squares_t)
    return Model(labels, weights.astype(np.float32), transitions)


# --- prediction -----------------------------------------------------------------------------------


def marginals(factors: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Probability of each label of each word. ``factors`` holds the words of all chains, one after another.

    Chains are cut into blocks. The blocks walk in step: first as matrices (what a block does to any message
    that enters it), then messages go from block to block, then the words of all blocks get theirs.
    """
    n, k = factors.shape
    if n == 0:
        return factors
    blocks = -(-lengths // BLOCK)
    chain = np.repeat(np.arange(len(lengths)), blocks)
    number = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = np.repeat(np.cumsum(lengths) - lengths, blocks) + number * BLOCK
    size = np.minimum(BLOCK, np.repeat(lengths, blocks) - number * BLOCK)
    padded = np.ones((len(begin), BLOCK, k))
    inside = np.arange(BLOCK)[None] < size[:, None]
    padded[inside] = factors
    whole = np.broadcast_to(np.eye(k), (len(begin), k, k)).copy()
    for i in range(BLOCK):
        live = np.flatnonzero(size > i)
        moved = (whole[live].reshape(-1, k) @ step).reshape(-1, k, k) * padded[live, i][:, None, :]
        whole[live] = moved / moved.sum(axis=(1, 2), keepdims=True)
    enter, leave = np.ones((len(begin), k)) / k, np.ones((len(begin), k)) / k
    first = np.cumsum(blocks) - blocks
    for i in range(1, int(blocks.max())):
        at = first[blocks > i] + i
        m = np.einsum("ij,ijk->ik", enter[at - 1], whole[at - 1])
        enter[at] = m / m.sum(axis=1, keepdims=True)
        back = first[blocks > i] + blocks[blocks > i] - 1 - i
        m = np.einsum("ijk,ik->ij", whole[back + 1], leave[back + 1])
        leave[back] = m / m.sum(axis=1, keepdims=True)
    alpha = np.ones_like(padded)
    message = enter
    for i in range(BLOCK):
        message = (message @ step) * padded[:, i]
        message = message / message.sum(axis=1, keepdims=True)
        alpha[:, i] = message
    beta = np.ones((len(begin), k))
    message = leave
    for i in range(BLOCK - 1, -1, -1):
        # a block shorter than BLOCK receives its message at its own end
        beta = np.where((size > i)[:, None], message, leave)
        alpha[:, i] *= beta
        message = np.where((size > i)[:, None], (beta * padded[:, i]) @ step.T, leave)
        message = message / message.sum(axis=1, keepdims=True)
    out = alpha[inside]
    return out / out.sum(axis=1, keepdims=True)


def label_texts(texts: list[str | None], model: Model) -> list[tuple[str, float, list[float]]]:
    """(label, score, share of letters per label) per text; ``und`` and 0 for a null text or one without letters."""
    vocabulary: dict[bytes, int] = {}
    ids, lengths = [], []
    for text in texts:
        words = text_words(text) if text else []
        ids += [vocabulary.setdefault(w, len(vocabulary)) for w in words]
        lengths.append(len(words))
    lengths = np.array(lengths, np.int64)
    k = len(model.labels)
    if not ids or not k:
        return [("und", 0.0, [0.0] * k)] * len(texts)
    words = list(vocabulary)
    scores = np.concatenate([emissions(words[i : i + 50_000], model.weights) for i in range(0, len(words), 50_000)])
    factors = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -30.0))
    letters = np.array([len(w) for w in words])[ids]
    some = lengths > 0
    found = marginals(factors[ids], lengths[some], np.exp(model.transitions)) * letters[:, None]
    shares = np.zeros((len(texts), k))
    shares[some] = np.add.reduceat(found, (np.cumsum(lengths) - lengths)[some])
    total = shares.sum(axis=1)
    return [(model.labels[int(s.argmax())], float(min(1.0, s.max() / n)), (s / n).tolist()) if n > 0 else ("und", 0.0, [0.0] * k) for s, n in zip(shares, total)]


def training_rows(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", texts: int = SAMPLE_TEXTS, pieces: int = SAMPLE_PIECES) -> list[tuple[str, str]]:
    """A bounded sample to train on: (piece, label), at most ``pieces`` of each label.

    The ``texts`` distinct texts of a label with the smallest hashes are cut into pieces over their whole length, and the pieces
    with the smallest hashes are taken, repeated ones once. Texts are ranked by their hashes alone; null texts and
    labels, and texts without letters, are left out.
    """
    text, label = F.col(f"`{text_col}`"), F.col(f"`{label_col}`")
    spelled = labelled.filter(text.isNotNull() & label.isNotNull()).select(text.alias("text"), label.alias("label"), F.xxhash64(text).alias("_hash"))
    first = Window.partitionBy("label").orderBy("_hash")
    chosen = spelled.filter(spelled["text"] != "").select("label", "_hash").distinct().withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= texts)
    # a few hundred hashes per label
    kept = spelled.join(F.broadcast(chosen.select("label", "_hash")), ["label", "_hash"], "left_semi").groupBy("label", "_hash").agg(F.first("text").alias("text"))

    def cut(batches):
        for batch in batches:
            for part in text_slices([batch], "text", SLICE_BYTES):
                found = [(k, " ".join(words[a:b])) for k, words in zip(part.column("label").to_pylist(), ([w.decode() for w in text_words(t)] for t in part.column("text").to_pylist())) for a, b in piece_bounds(len(words))]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([p for _, p in found], pa.string())], ["label", "piece"])

    made = kept.select("label", "text").mapInArrow(cut, "label string, piece string").distinct()
    some = made.withColumn("_n", F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("piece"), "piece"))).filter(F.col("_n") <= pieces)
    return [(r["piece"], r["label"]) for r in some.select("piece", "label").collect()]


def predict_language(docs: DataFrame, model: Model, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Per input row: ``id_cols``, ``lang_pred``, ``score`` (0 to 1) and ``shares`` (share of the letters per label, in label order).

    A null text or one without a letter is ``und`` with score 0. Only the text is looked at. Repeated rows are
    judged one by one. Narrow; the model (a few MB, bounded by ``BUCKETS``) travels with the plan.
    """
    def run(batches):
        for part in text_slices(batches, "_text", SLICE_BYTES):
            found = label_texts(part.column("_text").to_pylist(), model)
            labels, scores, shares = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.list_(pa.float64()))], ["_row", "lang_pred", "score", "shares"])

    kinds = ",".join(f"`{c}`:{docs.schema[c].dataType.simpleString()}" for c in id_cols)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in id_cols]).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    return rows.mapInArrow(run, f"_row struct<{kinds}>, lang_pred string, score double, shares array<double>").select("_row.*", "lang_pred", "score", "shares")
