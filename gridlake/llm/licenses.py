"""License scans: exact phrases, and short notices with a bounded number of edits.

A notice of n characters may differ in n // 12 edits. Cut into one piece more than that, one piece stands unchanged in every such
place (pigeonhole), so one Aho-Corasick pass over the pieces of all notices finds every candidate window; there the regex
library's bounded-error matching verifies the edits and gives the span.

Words are what `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` takes after A-Z are lower-cased; notices are matched on the words with single
spaces between. Defined results: null and empty texts have no words, no labels (an empty string) and score 0.0; repeated rows are
scanned each; an empty table gives no rows; very long texts are scanned whole in linear time; extra columns are kept by scan() unless their names clash.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from gridlake.llm.common import keep, slices

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "creative commons attribution noncommercial": "cc-by-nc",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license version 2 0": "mpl-2",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
CHARS_PER_EDIT = 12
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Scanner:
    """Finds notices with bounded edits; spans are word positions, end exclusive."""

    def __init__(self, notices: dict[str, str] = NOTICES, chars_per_edit: int = CHARS_PER_EDIT):
        import ahocorasick
        import regex

        self.seeds, self.rules = ahocorasick.Automaton(), []
        places: dict[str, list[tuple[int, int]]] = {}
        for notice, label in notices.items():
            edits = len(notice) // chars_per_edit
            cuts = [len(notice) * k // (edits + 1) for k in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:]):
                places.setdefault(notice[a:b], []).append((len(self.rules), a))
            self.rules.append((label, len(notice), edits, regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={edits}}}")))
        for seed, where in places.items():
            self.seeds.add_word(seed, (len(seed), where))
        self.seeds.make_automaton()

    def find(self, norm: str) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits) of the notices in a text of words with single spaces; start and end in characters.

        Seeds that imply nearly the same start share a window of bounded length, so a long text of many notices stays linear.
        Of places of a rule that overlap, the one with fewer edits stands, then the earlier one."""
        starts: dict[int, list[int]] = {}
        for last, (length, where) in self.seeds.iter(norm):
            for rule, offset in where:
                starts.setdefault(rule, []).append(last - length + 1 - offset)
        found = []
        for rule, mine in starts.items():
            label, size, edits, pattern = self.rules[rule]
            places = set()
            for low, high in _runs(sorted(set(mine)), 2 * edits, 2 * size):
                open_ = [(max(0, low - edits), min(len(norm), high + size + edits))]
                while open_:  # the best place first, then what lies left and right of it
                    a, b = open_.pop()
                    if m := pattern.search(norm, a, b):
                        places.add((sum(m.fuzzy_counts), m.start(), m.end()))
                        open_ += [(a, m.start()), (m.end(), b)]
            found += [(label, a, b, e) for a, b, e in _apart(sorted(places))]
        return found


def _runs(starts: list[int], gap: int, most: int):
    """(first, last) of runs of ascending numbers that lie at most `gap` apart, cut where a run gets longer than `most`."""
    first = before = starts[0]
    for at in starts[1:]:
        if at - before > gap or at - first > most:
            yield first, before
            first = at
        before = at
    yield first, before


def _apart(places: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the places (edits, start, end) that overlap none that comes before, by start."""
    starts: list[int] = []
    kept: list[tuple[int, int, int]] = []
    for e, a, b in places:
        k = bisect_left(starts, a)
        if (k == 0 or kept[k - 1][1] <= a) and (k == len(starts) or starts[k] >= b):
            starts.insert(k, a)
            kept.insert(k, (a, b, e))
    return kept


def _word_numbers(norm: str, places: list[int]) -> list[int]:
    """How many blanks stand before each place."""
    if not places:
        return []
    blanks = np.flatnonzero(np.frombuffer(norm.encode("utf-32-le", "replace"), "<u4") == 32)
    return np.searchsorted(blanks, places).tolist()


def base_places(norm: str) -> list[tuple[int, str]]:
    """(first word, label) of every place of a phrase."""
    padded, places, labels = f" {norm} ", [], []
    for phrase, label in PHRASES.items():
        at = padded.find(f" {phrase} ")
        while at >= 0:
            places.append(at)
            labels.append(label)
            at = padded.find(f" {phrase} ", at + 1)
    return list(zip(_word_numbers(padded, places), labels))


SPANS = ArrayType(StructType([StructField("label", StringType()), StructField("first_word", LongType()), StructField("end_word", LongType()), StructField("edits", LongType())]))
ADDED = [
    StructField("n_words", LongType()), StructField("n_base", LongType()), StructField("first_word", LongType()), StructField("last_word", LongType()),
    StructField("base_labels", StringType()), StructField("labels", StringType()), StructField("score", DoubleType()), StructField("notices", SPANS),
]
_SPANS_ARROW = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int64())]))


def scan_text(scanner: Scanner, text: bytes) -> tuple:
    words = words_of(text)
    norm = b" ".join(words).decode("utf-8", "replace")
    base = base_places(norm)
    fuzzy = scanner.find(norm)
    starts = [w for w, _ in base]
    labels = {label for _, label in base}
    near = max((1 - e / max(b - a, 1) for _, a, b, e in fuzzy), default=0.0)
    first, end = (_word_numbers(norm, [f[k] for f in fuzzy]) for k in (1, 2))
    notices = [{"label": f[0], "first_word": a, "end_word": b + 1, "edits": f[3]} for f, a, b in zip(fuzzy, first, end)]
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
        ",".join(sorted(labels | {f[0] for f in fuzzy})), 1.0 if base else round(max(0.0, near), 6), notices,
    )


def scan(docs: DataFrame) -> DataFrame:
    """docs with the columns of ADDED."""
    kept = docs.drop(*(f.name for f in ADDED))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _SPANS_ARROW]

    def run(batches):
        scanner = keep("licenses", Scanner)
        for batch in slices(batches):
            rows = [scan_text(scanner, t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            added = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *(f.name for f in ADDED)])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, *ADDED]))


def digest(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text")).select("doc_id", *(f.name for f in ADDED[:-1]))
