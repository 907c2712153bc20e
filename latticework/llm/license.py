"""License scans by a positional index of rare words.

Every template (a notice or a phrase) is indexed by its rarest words, rarity measured over all documents.  Each
word of a file fetches the postings of its templates with the word's position in them; postings that agree on
where the template would begin are one candidate, which is then compared word by word and kept if the
mandatory key phrase stands there.  Base phrases are templates that must agree in full.

Edge cases: a null or empty text has no words, no labels and score 0; very long texts are scanned whole;
repeated rows are scanned each on its own; equally rare words are taken in their alphabetical order; an empty table gives no rows;
columns other than the two named are ignored, whatever their names; templates and their words are a fixed, small set.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, text_or_empty

#: Label -> phrase whose words must stand consecutively.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Label -> (notice, mandatory key phrase).  Own wordings of the usual notices.
NOTICES = {
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    "mit": ("released under the mit license", "mit license"),
    "apache-2": ("licensed under the apache license version 2 0", "apache license version 2"),
    "gpl-3": ("this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    "gpl-2": ("this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    "lgpl": ("licensed under the gnu lesser general public license", "lesser general public license"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source"),
    "mpl-2": ("subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "cc by nc"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "cc by sa"),
    "cc0": ("dedicated to the public domain under cc0 1 0", "cc0"),
    "proprietary": ("all rights reserved no part of this work may be reproduced without permission", "all rights reserved"),
}
#: Label -> short forms that stand without the sentence around them; all their words must agree.
SHORT = {
    "mit": ("mit license",),
    "apache-2": ("apache license 2 0", "apache license v 2 0", "apache license v2 0"),
    "gpl-3": ("gnu general public license version 3", "gnu general public license v 3", "gnu general public license v3"),
    "gpl-2": ("gnu general public license version 2", "gnu general public license v 2", "gnu general public license v2"),
    "lgpl": ("gnu lesser general public license",),
    "bsd": ("redistribution and use in source and binary forms",),
    "mpl-2": ("mozilla public license v 2 0", "mozilla public license version 2 0", "mozilla public license 2 0"),
    "cc-by-sa": ("cc by sa",),
    "proprietary": ("all rights reserved",),
}
RARE_WORDS = 3
#: Share of a notice's words that must agree in place.
COVER = 0.7

_WORDS = bytes(b + 32 if 65 <= b < 91 else b if b >= 128 or 48 <= b < 58 or 97 <= b < 123 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text_or_empty(text).encode().translate(_WORDS).split()


def templates() -> list[tuple[str, list[bytes], list[bytes], bool]]:
    """(label, words, key phrase, whether it is a base phrase)."""
    base = [(label, p.encode().split(), p.encode().split(), True) for label, p in BASE.items()]
    short = [(label, p.encode().split(), p.encode().split(), False) for label, forms in SHORT.items() for p in forms]
    return base + [(label, n.encode().split(), k.encode().split(), False) for label, (n, k) in NOTICES.items()] + short


def document_frequency(docs: DataFrame) -> tuple[dict[bytes, int], int]:
    """In how many of all documents each licence word stands, and the number of documents.

    Only counts of the templates' own words come to the driver, a set that doesn't grow with the input.
    """
    vocabulary = frozenset(w for _, words, _, _ in templates() for w in words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen[b""] += 1
                seen.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    rows = docs.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"].encode(): r["n"] for r in rows}
    return counts, counts.pop(b"", 0)


class Index:
    def __init__(self, counts: dict[bytes, int], n_docs: int):
        self.templates = templates()
        self.idf = {w: math.log((1 + n_docs) / (1 + counts.get(w, 0))) for _, words, _, _ in self.templates for w in words}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, words, _, base) in enumerate(self.templates):
            rare = sorted(set(words), key=lambda w: (-self.idf[w], w))[: 1 if base else RARE_WORDS]
            for at, w in enumerate(words):
                if w in rare:
                    self.postings[w].append((t, at))

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, share of words that agree) of every confirmed place."""
        postings, votes = self.postings, Counter()
        for at in [i for i, w in enumerate(words) if w in postings]:
            for t, offset in postings[words[at]]:
                votes[t, at - offset] += 1
        found = []
        for (t, start), n in votes.items():
            _, template, key, base = self.templates[t]
            if start < 0 and base or n < min(2, len(set(template))) and not base and len(key) > 1:
                continue
            place = words[max(start, 0) : start + len(template)]
            agree = sum(words[start + i] == w for i, w in enumerate(template) if 0 <= start + i < len(words))
            if base and agree == len(template) or not base and agree >= COVER * len(template) and any(place[i : i + len(key)] == key for i in range(len(place))):
                found.append((t, start, agree / len(template)))
        return found


def scan_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places of every row; a map."""
    arrow_limits(docs.sparkSession)
    index = Index(*document_frequency(docs.select(docs[text_column].cast("string"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = index.templates
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                found = index.scan(words)
                base = [start for t, start, _ in found if told[t][3]]
                labels = ",".join(sorted({told[t][0] for t, _, _ in found}))
                base_labels = ",".join(sorted({told[t][0] for t, _, _ in found if told[t][3]}))
                places = [f"{told[t][0]}:{start}:{len(told[t][1])}" for t, start, _ in sorted(found, key=lambda f: (f[1], f[0]))]
                rows.append((len(words), len(base), min(base, default=None), max(base, default=None), base_labels, labels, max((s for _, _, s in found), default=0.0), ",".join(places)))
            columns = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.string()]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    schema = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, places string"
    return docs.select(docs[id_column].cast("bigint"), docs[text_column].cast("string")).mapInArrow(run, schema)
