"""Licence scans: short notices, exact and with a bounded number of errors.

A notice of length n may have k errors (insertions, deletions, substitutions). Cut into k + 1 seeds, one
seed must stand exactly in any such match, so exact search of the seeds finds every candidate, and the
regex library's bounded-error matching decides there and reports the span.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import regex
from pyspark.sql import DataFrame

from .texts import text_slices

#: Label and words of each notice. Words are runs of letters, digits and characters beyond ASCII, in lower case.
BASE_NOTICES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
NOTICES = (
    *BASE_NOTICES,
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache-2", "licensed under the apache license"),
    ("gpl", "gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl-2", "mozilla public license version 2"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by", "licensed under creative commons attribution"),
    ("all-rights-reserved", "all rights reserved"),
)
#: Characters of a notice per allowed error; shorter notices must stand exactly.
CHARS_PER_ERROR = 12


@dataclass(frozen=True)
class Notice:
    label: str
    phrase: str
    errors: int

    @property
    def seeds(self) -> list[tuple[int, str]]:
        """(offset, text) of ``errors + 1`` parts of the phrase."""
        cuts = [len(self.phrase) * i // (self.errors + 1) for i in range(self.errors + 2)]
        return [(a, self.phrase[a:b]) for a, b in zip(cuts, cuts[1:])]

    def pattern(self):
        """Whole words with at most that many errors; the best match of a place."""
        return regex.compile(rf"(?b)(?<!\S)(?:{regex.escape(self.phrase, special_only=True)}){{e<={self.errors}}}(?!\S)")

    def accepts(self, found: str) -> bool:
        """Numbers name versions: a match must have the notice's."""
        return regex.findall(r"\d+", found) == regex.findall(r"\d+", self.phrase)


def notices(pairs=NOTICES, chars_per_error: int = CHARS_PER_ERROR) -> list[Notice]:
    return [Notice(label, phrase, len(phrase) // chars_per_error) for label, phrase in pairs]


def _word_table() -> bytes:
    """For bytes.translate: A-Z folded, everything that is in no word a space."""
    keep = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    return bytes(b + 32 if 65 <= b <= 90 else b if b in keep else 32 for b in range(256))


def phrase_places(words: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which a phrase stands in words joined by single spaces, with a space at both ends."""
    places, at, word, counted = [], words.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        word += words.count(b" ", counted, at)
        counted = at
        places.append(word)
        at = words.find(b" " + phrase + b" ", at + 1)
    return places


def fuzzy_places(text: str, notice: Notice, pattern) -> list[tuple[int, int, int]]:
    """(start, end, errors) of the matches around the exact places of the notice's seeds, best ones first at each place."""
    reach, found = len(notice.phrase) + 2 * notice.errors + 3, {}
    # the library allows no insertion where a search begins, so it begins two characters early
    padded, starts = "  " + text, set()
    for offset, seed in notice.seeds:
        at = padded.find(seed)
        while at >= 0:
            starts.add(max(0, at - offset - notice.errors - 2))
            at = padded.find(seed, at + 1)
    for low in sorted(starts):
        high = min(len(padded), low + reach)
        match = pattern.search(padded, low, high)
        # what ends where the search had to end may go on behind it
        if match and (match.end() < high or high == len(padded) or padded[high] == " ") and notice.accepts(match[0]):
            span = (match.start() - 2, match.end() - 2)
            found[span] = min(sum(match.fuzzy_counts), found.get(span, notice.errors))
    return [(a, b, e) for (a, b), e in sorted(found.items())]


MATCH = "array<struct<label:string,first_word:int,n_words:int,errors:int,score:double,found:string>>"
FOUND = f"n_words long, base array<struct<label:string,word:int>>, matches {MATCH}"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pairs=NOTICES, base=BASE_NOTICES, chars_per_error: int = CHARS_PER_ERROR) -> DataFrame:
    """Per input row: the id, ``n_words``, ``base`` (label and word number of every place where a base phrase's words
    stand) and ``matches`` (label, first word, words, errors, score and found words of every place of any notice).

    The score is one less the errors per character of the notice. A null text has no words. Repeated rows are
    scanned one by one; other columns are not read. Narrow: nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    wanted, exact = notices(pairs, chars_per_error), [(label, phrase.encode()) for label, phrase in base]
    table = _word_table()

    def run(batches):
        patterns = [(n, n.pattern(), [s.encode() for _, s in n.seeds]) for n in wanted]
        for part in text_slices(batches, "_text"):
            counts, places, matches = [], [], []
            for text in part.column("_text").to_pylist():
                words = (text or "").encode().translate(table).split()
                whole = b" " + b" ".join(words) + b" "
                counts.append(len(words))
                places.append([{"label": label, "word": w} for label, phrase in exact for w in phrase_places(whole, phrase)])
                found, line, blanks = [], None, None
                for notice, pattern, seeds in patterns:
                    if any(s in whole for s in seeds):
                        if line is None:
                            line = whole[1:-1].decode()
                            blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), "<u4") == 0x20)
                        before = lambda at: int(np.searchsorted(blanks, at))  # noqa: E731, B023
                        found += [{"label": notice.label, "first_word": before(a), "n_words": before(b) - before(a) + 1, "errors": e,
                                   "score": 1 - e / len(notice.phrase), "found": line[a:b]} for a, b, e in fuzzy_places(line, notice, pattern)]
                matches.append(sorted(found, key=lambda m: (m["first_word"], m["label"], m["errors"])))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(places, _PLACES), pa.array(matches, _MATCHES)], [id_col, "n_words", "base", "matches"])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, {FOUND}")


_PLACES = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int32())]))
_MATCHES = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("errors", pa.int32()), ("score", pa.float64()), ("found", pa.string())]))
