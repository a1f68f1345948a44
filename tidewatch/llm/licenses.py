"""License scan: exact base phrases and fuzzy search for short notices.

The fuzzy search cuts a notice of at most k errors into k + 1 parts: a copy with at most k edits must
hold one part unchanged (pigeonhole).  One Aho-Corasick pass over the normalised text finds the parts; around each hit the
``regex`` module's bounded-error matching (``{e<=k}``) verifies the edits, and the spans of verified matches are
reported in words of the text.

What tells one licence from another is exact: a notice's words in braces take no edits (three edits make any of "bsd", "isc" and
"mit" of any other).  A match begins and ends with a word, and where matches overlap the longest notice wins ("... attribution
noncommercial" is no plain attribution).

A text is normalised to its words, A-Z lower-cased, joined by single spaces, so line breaks, comment marks
and punctuation inside a notice don't matter.

Contract of ``scan``: one row per input row.  Null and empty texts have no words, no spans, null first and last
word, empty labels and score 0.  Repeated rows give repeated results; whole texts of any length are
read; an empty table gives an empty result; other input columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import memory
from tidewatch.llm.common import load, ship
from tidewatch.llm.textvec import ALNUM, Words, hash_bytes, pieces, words_of

#: Phrase -> label.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notice -> label, searched with errors but for the words in braces.  Each is longer than any base phrase, so that a few edits
#: don't turn prose into it.
NOTICES = {
    "gnu {general} public license": "gpl",
    "gnu {lesser} general public license": "lgpl",
    "gnu {library} general public license": "lgpl",
    "gnu {affero} general public license": "agpl",
    "gnu free {documentation} license": "gfdl",
    "licensed under the {apache} license version 2 0": "apache",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "neither the name of the copyright holder nor the names of its contributors": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "creative commons {attribution}": "cc-by",
    "creative commons {attribution sharealike}": "cc-by-sa",
    "creative commons {attribution share alike}": "cc-by-sa",
    "creative commons {attribution noderivatives}": "cc-by-nd",
    "creative commons {attribution no derivatives}": "cc-by-nd",
    "creative commons {attribution noncommercial}": "cc-by-nc",
    "creative commons {attribution non commercial}": "cc-by-nc",
    "creative commons {attribution noncommercial sharealike}": "cc-by-nc-sa",
    "creative commons {attribution noncommercial share alike}": "cc-by-nc-sa",
    "creative commons {attribution non commercial share alike}": "cc-by-nc-sa",
    "creative commons {attribution noncommercial noderivatives}": "cc-by-nc-nd",
    "creative commons {attribution noncommercial no derivatives}": "cc-by-nc-nd",
    "creative commons {attribution non commercial no derivatives}": "cc-by-nc-nd",
    "{mozilla} public license": "mpl",
    "{eclipse} public license": "epl",
    "european {union} public licence": "eupl",
    "boost {software} license": "boost",
    "artistic license {2} 0": "artistic",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "do what the {fuck} you want to public license": "wtfpl",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable": "zlib",
    "spdx license identifier": "spdx",
    "{all} rights reserved": "all-rights-reserved",
}
#: Names of licences that "released under the ... license" may name.
NAMED = {"mit": "mit", "bsd": "bsd", "isc": "isc", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "zlib": "zlib", "boost": "boost", "mozilla": "mpl"}
NOTICES |= {f"{verb} under the {{{name}}} license": label for verb in ("released", "licensed", "distributed") for name, label in NAMED.items()}


def errors_for(notice: str) -> int:
    """Edits allowed: one in ten characters, three at most."""
    return max(1, min(3, len(notice) // 10))


def seeds(notice: str, errors: int) -> list[tuple[int, str]]:
    """(offset, part): errors + 1 parts of nearly equal length."""
    n, k = len(notice), errors + 1
    cut = [n * i // k for i in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def pattern_of(marked: str, errors: int) -> regex.Pattern:
    """The notice between words, with errors outside its braces; the sum of all is checked by the caller."""
    parts = [p for p in re.split(r"(\{[^}]*\})", marked) if p]
    body = "".join(regex.escape(p[1:-1]) if p[0] == "{" else rf"(?:{regex.escape(p)}){{e<={errors}}}" for p in parts)
    return regex.compile(rf"(?b)(?<![^ ]){body}(?![^ ])")


class NoticeSearch:
    def __init__(self, notices: dict[str, str]):
        import ahocorasick

        plain = [(n.replace("{", "").replace("}", ""), n, label) for n, label in notices.items()]
        self.notices = [(n, label, errors_for(n)) for n, _, label in plain]
        self.pattern = [pattern_of(marked, errors_for(n)) for n, marked, _ in plain]
        parts: dict[str, list[tuple[int, int]]] = {}
        for k, (n, _, e) in enumerate(self.notices):
            for at, part in seeds(n, e):
                parts.setdefault(part, []).append((k, at))
        self.auto = ahocorasick.Automaton()
        for part, where in parts.items():
            self.auto.add_word(part, (len(part), tuple(where)))
        self.auto.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits), ends exclusive, not overlapping for one notice."""
        places: dict[int, set[int]] = {}
        for end, (size, where) in self.auto.iter(text):
            for k, at in where:
                places.setdefault(k, set()).add(end + 1 - size - at)
        found = []
        for k, starts in places.items():
            notice, _, e = self.notices[k]
            done = -1
            for s in sorted(starts):
                low = max(0, s - e, done)
                # To the end of the word, so that the match's own end is seen.
                high = text.find(" ", min(len(text), s + len(notice) + e))
                high = len(text) if high < 0 else high
                if high <= low:
                    continue
                m = self.pattern[k].search(text, low, high)
                if m and m.end() > m.start() and sum(m.fuzzy_counts) <= e:
                    found.append((k, m.start(), m.end(), sum(m.fuzzy_counts)))
                    done = m.end()
        return found

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """Of the matches those that no longer notice overlaps, in order."""
        kept: list[tuple[int, int, int, int]] = []
        for f in sorted(self.matches(text), key=lambda f: (-len(self.notices[f[0]][0]), f[3], f[1], f[0])):
            if all(f[2] <= o[1] or o[2] <= f[1] for o in kept):
                kept.append(f)
        return sorted(kept, key=lambda f: (f[1], f[2], f[0]))


_search: list[NoticeSearch] = []
memory.keeps("licenses", _search.clear)


def _base_places(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word index, phrase index) of every place of a base phrase."""
    at, which = [], []
    h, n = words.hash, len(words)
    text = words.text_of
    for k, phrase in enumerate(BASE):
        parts = [np.uint64(hash_bytes(w.encode())) for w in phrase.split(" ")]
        hit = np.flatnonzero(h == parts[0])
        hit = hit[hit + len(parts) <= n]
        for j, p in enumerate(parts[1:], 1):
            hit = hit[h[hit + j] == p]
        hit = hit[text[hit] == text[hit + len(parts) - 1]]
        at.append(hit)
        which.append(np.full(len(hit), k))
    return np.concatenate(at), np.concatenate(which)


def _normalised(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offset of each text): words joined by single spaces, one space after each text."""
    keep = ALNUM[words.data]
    data = np.where(keep, words.data, np.uint8(32))
    # Each word is followed by one space: of its gap the first byte, or a byte put in where a text ends with a word.
    size = words.end - words.start + 1
    begin = np.cumsum(size) - size
    out = np.full(int(size.sum()), 32, np.uint8)
    source = np.flatnonzero(keep)
    word = np.repeat(np.arange(len(words)), words.end - words.start)
    out[begin[word] + source - words.start[word]] = data[source]
    return out, np.append(begin, len(out))[words.first]


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,notice:string,start_word:long,end_word:long,edits:int>>"


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Base counts, labels, score and the verified notice spans of every row."""
    ship(docs.sparkSession)
    labels = list(BASE.values())

    @memory.task("licenses")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _search:
            _search.append(NoticeSearch(NOTICES))
        search = _search[0]
        span_type = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32())]))
        for part in pieces(batches, "text"):
            words = words_of(part.column("text"), ALNUM)
            n = part.num_rows
            at, which = _base_places(words)
            owner = np.searchsorted(words.first, at, "right") - 1
            n_base = np.bincount(owner, minlength=n)
            first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            local = at - words.first[owner]
            np.minimum.at(first, owner, local)
            np.maximum.at(last, owner, local)
            base = [set() for _ in range(n)]
            for d, k in zip(owner.tolist(), which.tolist(), strict=True):
                base[d].add(labels[k])
            flat, begin = _normalised(words)
            blob = flat.tobytes()
            spans = []
            for d in range(n):
                t = blob[begin[d] : max(begin[d], begin[d + 1] - 1)].decode("utf-8", "replace")
                got = []
                for k, s, e, edits in search.spans(t) if t else ():
                    start = t.count(" ", 0, s + (t[s : s + 1] == " "))
                    got.append({"label": search.notices[k][1], "notice": search.notices[k][0], "start_word": start, "end_word": start + t[s:e].strip().count(" ") + 1, "edits": edits})
                spans.append(got)
            every = [b | {s["label"] for s in g} for b, g in zip(base, spans, strict=True)]
            # A base phrase or exact notice is certain; each edit of a notice takes a quarter off.
            score = [max([1.0 if b else 0.0, *(max(0.25, 1 - 0.25 * s["edits"]) for s in g)]) for b, g in zip(base, spans, strict=True)]
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(words.counts.astype(np.int64)),
                    pa.array(n_base.astype(np.int64)),
                    pa.array(first, pa.int64(), mask=none),
                    pa.array(last, pa.int64(), mask=none),
                    pa.array([",".join(sorted(b)) for b in base]),
                    pa.array([",".join(sorted(e)) for e in every]),
                    pa.array(score, pa.float64()),
                    pa.array(spans, span_type),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


BASE_SQL = """WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
phrases AS (SELECT string_split(p, ' ') AS p, label FROM (VALUES %s) v(p, label)),
hits AS (SELECT doc_id, i - 1 AS place, label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) CROSS JOIN phrases WHERE w[i] = p[1] AND w[i : i + len(p) - 1] = p)
SELECT w.doc_id, len(w) AS n_words, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels FROM w LEFT JOIN hits USING (doc_id) GROUP BY w.doc_id, w""" % ", ".join(f"('{p}', '{label}')" for p, label in BASE.items())


def base(spark, sf_dir: str) -> DataFrame:
    """What SQL can say of op3: the base phrases."""
    return query(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: base phrases and notices of every document."""
    return scan(load(spark, sf_dir, "documents")).drop("spans")
