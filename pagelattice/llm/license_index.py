"""License scans by a positional index of rare words.

A template is a word sequence (a phrase, a notice, or the text of a licence) with a label and a mandatory key phrase. The index has, for each template word, its postings
(template, offset). In a file the licence words are looked up in order of falling IDF (document frequencies come from one pass
over the whole corpus); each occurrence votes for the start that its posting implies, and the starts on which a template's
rarest words agree are verified: the key phrase must stand there, and most of the template's weight. Both passes are maps; what
is collected is one count for each template word, a fixed number.

Defined results: null and empty texts have 0 words, no labels and score 0; repeated rows are judged alike; an empty table gives
an empty result; every other column of the input is ignored; texts are scanned whole.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes that are part of words stay, A-Z become lower case, all others become spaces.
_FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Template(NamedTuple):
    label: str
    words: str
    key: str  # must stand at its place in the template
    base: bool = False


#: The base phrases of the contract, and notices of common licences.
TEMPLATES = (
    Template("mit", "mit license", "mit license", True),
    Template("apache", "apache license", "apache license", True),
    Template("gpl", "general public license", "general public license", True),
    Template("agpl", "affero general public license", "affero general public license"),
    Template("lgpl", "lesser general public license", "lesser general public license"),
    Template("mpl", "mozilla public license", "mozilla public license"),
    Template("epl", "eclipse public license", "eclipse public license"),
    Template("boost", "boost software license", "boost software license"),
    Template("cc-by", "creative commons attribution", "creative commons attribution"),
    Template("cc-by", "licensed under cc by 4 0", "cc by 4"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc0", "creative commons zero", "creative commons zero"),
    Template("apache-notice", "licensed under the apache license version 2 0", "apache license version 2"),
    Template("mit-notice", "released under the mit license", "the mit license"),
    Template("gpl-3-notice", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "copy modify and or distribute"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    Template(
        "mit-full",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "without limitation the rights to use copy modify merge publish distribute sublicense",
    ),
    Template(
        "isc-full",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "with or without fee is hereby granted",
    ),
    Template(
        "bsd-2-full",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "redistributions in binary form must reproduce the above copyright notice",
    ),
    Template(
        "apache-header",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
        "you may not use this file except in compliance with the license",
    ),
    Template(
        "gpl-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "under the terms of the gnu general public license as published by the free software foundation",
    ),
)
#: How many of a template's rarest words vote (of one with more words, one more for each VOTER_STEP of them), how many must agree, and the
#: share of its weight that must stand there.
VOTERS, VOTER_STEP, AGREE, SHARE = 3, 20, 2, 0.7


def vocabulary(templates=TEMPLATES) -> frozenset[bytes]:
    return frozenset(w for t in templates for w in words(t.words))


def document_frequencies(docs: DataFrame, templates=TEMPLATES) -> tuple[int, dict[bytes, int]]:
    """The number of documents, and for each template word the number that have it; at most one row a word comes back."""
    vocab = vocabulary(templates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = Counter(), 0
        for batch in batches:
            n += batch.num_rows
            for t in batch.column("text"):
                found = words(t.as_py())
                if not vocab.isdisjoint(found):
                    df.update(vocab.intersection(found))
        df[b" "] = n
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in df], pa.string()), pa.array(list(df.values()), pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {r.word.encode(): r.n for r in rows}
    return df.pop(b" ", 0), df


class PositionalIndex:
    """Postings of the templates' words, ordered by IDF."""

    def __init__(self, n_docs: int, df: dict[bytes, int], templates=TEMPLATES):
        self.templates = templates
        self.idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) + 1 for w in vocabulary(templates)}
        self.seq = [words(t.words) for t in templates]
        self.key_at = []
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.need = []
        for k, (t, seq) in enumerate(zip(templates, self.seq, strict=True)):
            key = words(t.key)
            self.key_at.append((next(i for i in range(len(seq)) if seq[i : i + len(key)] == key), key))
            voters = sorted(set(seq), key=lambda w: (-self.idf[w], w))[: VOTERS + len(seq) // VOTER_STEP]
            self.need.append(min(AGREE, len(voters)))
            for i, w in enumerate(seq):
                if w in voters:
                    self.postings[w].append((k, i))

    def scan(self, found: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, share of its weight) of every place that is verified."""
        places = defaultdict(list)
        for i, w in enumerate(found):
            if w in self.postings:
                places[w].append(i)
        votes: dict[tuple[int, int], set] = defaultdict(set)
        for w in sorted(places, key=lambda w: (-self.idf[w], w)):
            for k, off in self.postings[w]:
                for i in places[w]:
                    votes[k, i - off].add(w)
        out = []
        for (k, start), who in votes.items():
            at, key = self.key_at[k]
            if len(who) < self.need[k] or start + at < 0 or found[start + at : start + at + len(key)] != key:
                continue
            weights = [self.idf[w] for w in self.seq[k]]
            there = [x for j, (w, x) in enumerate(zip(self.seq[k], weights, strict=True)) if 0 <= start + j < len(found) and found[start + j] == w]
            share = sum(there) / sum(weights)
            if share >= SHARE:
                out.append((k, start, min(1.0, share)))
        return out

    def verdict(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        found = words(text)
        if self.postings.keys().isdisjoint(found):
            return len(found), 0, None, None, "", "", 0.0
        hits = self.scan(found)
        base = [(self.templates[k].label, start) for k, start, _ in hits if self.templates[k].base]
        starts = [s for _, s in base]
        joined = lambda labels: ",".join(sorted(set(labels)))
        return (len(found), len(base), min(starts, default=None), max(starts, default=None), joined(x for x, _ in base), joined(self.templates[k].label for k, _, _ in hits), max((x for _, _, x in hits), default=0.0))


SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """A row for each row of docs, with the columns of SCHEMA."""
    index = PositionalIndex(*document_frequencies(docs, templates), templates)
    types = (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(),)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*(index.verdict(t.as_py()) for t in batch.column("text")), strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)


def places(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """The operator's full output: doc_id, label, start and end word, share of every verified place."""
    index = PositionalIndex(*document_frequencies(docs, templates), templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i.as_py(), templates[k].label, s, s + len(index.seq[k]), x) for i, t in zip(batch.column("doc_id"), batch.column("text"), strict=True) for k, s, x in sorted(index.scan(words(t.as_py())))]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["doc_id", "label", "start_word", "end_word", "share"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, label string, start_word bigint, end_word bigint, share double")


def op9_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))
