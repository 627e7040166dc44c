"""License notices, exact and with small errors.

Texts become words (A-Z lower-cased; words of ASCII letters, digits and non-ASCII characters) joined by single spaces.
Base phrases are found where their words stand consecutively.  Longer notices are found with errors: a notice that
may have k errors is split into k + 1 seeds, one of which must stand unchanged (pigeonhole); an Aho-Corasick automaton
finds seeds, and the regex library's bounded-error matching checks the text around each, never past the ends of the
seed's own text, and reports the span.  Numbers, and words that tell licenses apart, must stand unchanged in the span.

Nulls and empty texts have no words and no labels.  Repeated rows each keep a row, an empty table gives no rows, and
of two notices on one span (a tie) both are reported.  A text's labels hang on that text alone, whatever stands beside
it, and texts of any length are read whole.  Only the id (of any type) and text columns are read, so further columns may
have any name.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, arrow_batches, separators, slices, text_column, words

#: Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices, their labels, the errors they may have, words that must stand unchanged.
NOTICES = (
    ("released under the mit license", "mit", 3, ("mit",)),
    ("licensed under the mit license", "mit", 3, ("mit",)),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6, ()),
    ("licensed under the apache license version 2 0", "apache-2", 4, ()),
    ("licensed under cc by nc 4 0", "cc-by-nc", 2, ("cc", "by", "nc")),
    ("creative commons attribution noncommercial 4 0 international", "cc-by-nc", 5, ()),
    ("licensed under the gnu general public license version 3", "gpl-3", 5, ()),
    ("licensed under the gnu general public license version 2", "gpl-2", 5, ()),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 7, ()),
    ("mozilla public license version 2 0", "mpl-2", 3, ()),
    ("licensed under the gnu lesser general public license version 3", "lgpl-3", 5, ("lesser",)),
    ("licensed under the gnu lesser general public license version 2 1", "lgpl-2.1", 5, ("lesser",)),
    ("licensed under the gnu affero general public license version 3", "agpl-3", 5, ("affero",)),
    ("the software is provided as is without warranty of any kind express or implied", "mit", 6, ()),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse", "bsd", 7, ()),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 6, ()),
    ("distributed under the boost software license version 1 0", "bsl-1", 4, ("boost",)),
    ("eclipse public license version 2 0", "epl-2", 3, ("eclipse",)),
    ("this is free and unencumbered software released into the public domain", "unlicense", 6, ()),
    ("creative commons attribution sharealike 4 0 international", "cc-by-sa", 5, ("sharealike",)),
    ("cc0 1 0 universal public domain dedication", "cc0", 3, ("cc0",)),
)
_BREAKS = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


class Scanner:
    """The automaton over phrases and seeds and the notices' patterns (built once in each worker)."""

    def __init__(self, phrases: dict[str, str], notices):
        import ahocorasick
        import regex

        table: dict[str, list] = {}
        for phrase, label in phrases.items():
            table.setdefault(f" {phrase} ", []).append(("phrase", phrase, label))
        self.notices = []
        for k, (notice, label, errors, fixed) in enumerate(notices):
            size = -(-len(notice) // (errors + 1))
            for at in range(0, len(notice), size):
                table.setdefault(notice[at : at + size], []).append(("seed", k, at))
            keep = [w for w in notice.split() if w.isdigit() or w in fixed]
            self.notices.append((notice, label, errors, keep, regex.compile(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={errors}}}")))
        self.machine = ahocorasick.Automaton()
        for key, value in table.items():
            self.machine.add_word(key, (len(key), value))
        self.machine.make_automaton()

    def scan(self, text: str, bounds: list[int] | None = None) -> list[tuple[str, int, int, int, float, bool]]:
        """(label, first character, end, errors, right share of the notice, base?) of each place in `` words ... `` text.
        ``bounds``: where texts start and the last ends, if several stand one after the other."""
        bounds = bounds or [0, len(text)]
        out, tried = [], set()
        for end, (size, entries) in self.machine.iter(text):
            start = end - size + 1
            for kind, x, y in entries:
                if kind == "phrase":
                    out.append((y, start + 1, end, 0, 1.0, True))
                    continue
                notice, label, errors, keep, pattern = self.notices[x]
                if (x, start - y) in tried:
                    continue
                tried.add((x, start - y))
                k = bisect_right(bounds, start) - 1
                if end >= bounds[k + 1]:
                    continue  # the seed itself goes over the end of a text
                m = pattern.search(text, max(bounds[k], start - y - errors), min(bounds[k + 1], start - y + len(notice) + errors))
                if m:
                    a, b = m.span()
                    a, b = a + (text[a] == " "), b - (text[b - 1] == " ")
                    lo, hi = text.rfind(" ", 0, a + 1) + 1, text.find(" ", b)  # whole words
                    own = text[lo : hi if hi >= 0 else len(text)].split()
                    rest = iter(own)
                    if all(w in rest for w in keep) and all(w in keep for w in own if w.isdigit()):
                        wrong = sum(m.fuzzy_counts)
                        out.append((label, lo, hi if hi >= 0 else len(text), wrong, max(0.0, 1 - wrong / len(notice)), False))
        return out


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, notices=NOTICES) -> DataFrame:
    """``id``, ``n_words``, and ``places``: (label, first word, end word, errors, share of the notice that is right,
    base?) of every phrase and every distinct span of a notice, for each row."""
    phrases = PHRASES if phrases is None else phrases
    arrow_batches(docs.sparkSession)
    kind = docs.schema[id].dataType.simpleString()
    place = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("errors", pa.int64()), ("right", pa.float64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices)
        for batch in batches:
            for i, j, raw, off in slices(batch.column(1)):
                low = LOWER[raw]
                starts, ends, doc = words(low, off, _BREAKS)
                n = j - i
                count = np.bincount(doc, minlength=n)
                # all words of the slice joined by single spaces, two between texts and at both ends
                first = np.zeros(len(starts), bool)
                first[(np.cumsum(count) - count)[count > 0]] = True
                size = ends - starts
                at = np.cumsum(size + 1 + first) - size
                joined = np.full(int(at[-1] + size[-1] + 2) if len(at) else 2, 0x20, np.uint8)
                step = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                joined[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = low[step]
                found: list[list] = [[] for _ in range(n)]
                zero = np.cumsum(count) - count
                bounds = [*(at[zero[count > 0]] - 1).tolist(), len(joined)]  # the space before each text's first word
                for label, a, b, errors, right, base in set(scanner.scan(joined.tobytes().decode("latin-1"), bounds)) if len(at) else ():
                    w, v = int(np.searchsorted(at, a, side="right")) - 1, int(np.searchsorted(at, b, side="left"))
                    d = int(doc[w])
                    found[d].append({"label": label, "first_word": w - int(zero[d]), "end_word": v - int(zero[d]), "errors": errors, "right": right, "base": base})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(count, pa.int64()), pa.array([sorted(f, key=lambda p: (p["first_word"], p["label"], p["end_word"], p["errors"])) for f in found], pa.list_(place))], ["id", "n_words", "places"])

    rows = text_column(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "text")
    return rows.mapInArrow(run, f"id {kind}, n_words long, places array<struct<label:string,first_word:long,end_word:long,errors:long,right:double,base:boolean>>").withColumnRenamed("id", id)


def labels(scanned: DataFrame, id: str = "doc_id") -> DataFrame:
    """Places as one row of labels for each document."""
    base = F.filter("places", lambda p: p["base"])
    joined = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return scanned.select(
        id, "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["first_word"])).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["right"])), F.lit(0.0)).alias("score"),
    )
