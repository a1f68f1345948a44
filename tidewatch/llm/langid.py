"""Language ID by segmentation-marginalised unigrams.

Pieces are the letter strings of a fixed public vocabulary (lower-cased, of any length) and all single bytes.  For each
language the pieces have probabilities, fitted by expectation-maximisation over all segmentations of its training words.
A forward pass sums the probabilities of every segmentation of a word (a run of letters, of any length) by logarithms; a text's
score for a language is the sum of its words' logarithms.  A trie lists the pieces at all places of all words of a piece
of the corpus at once; the passes step through the words' ends together.  A worker remembers the words met so far, up to a bound.

The model is fitted on at most DOCS_PER_LANGUAGE texts of each language (by hash of the id, a documented bound) with all their words,
one language in one task; only the fitted probabilities reach the driver, at most a row a piece and language.

Contract of ``predict``: one row per input row.  lang_pred is a learned language, or `und` with score 0 for a null text
or one without letters, and everywhere if nothing could be learned.  Ties go to the language first in code point order.
Rows with a null doc_id teach nothing; of an id's rows of one
language the first text in code point order teaches.  Repeated rows give repeated results; whole texts are read; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm import memory
from tidewatch.llm.common import load, remainder, sample_by, ship, stored
from tidewatch.llm.textvec import LETTERS, HashIndex, mix, pieces, sums, words_of

DOCS_PER_LANGUAGE = 1_500
ROUNDS = 3
#: Words a worker remembers.
MEMORY_WORDS = 250_000
#: Bytes of words whose segmentations are summed together, about.
CHUNK = 1 << 16
FOLDS, HELD_OUT = 5, 0


def vocabulary(path: str | None = None) -> list[bytes]:
    """All single bytes, then the letter pieces of a ranks file (base64 token, space, rank) in order of rank."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    found = {bytes([b]): None for b in range(256)}
    for t in tokens:
        piece = t.strip(b" ")
        try:
            piece = piece.decode().lower().encode()
        except UnicodeDecodeError:
            continue
        if piece and all(LETTERS[b] for b in piece):
            found[piece] = None
    return list(found)


class Segmenter:
    """Sums over all segmentations of words into pieces."""

    def __init__(self, vocab: list[bytes]):
        self.sizes = np.array([len(v) for v in vocab])
        data, begin = np.frombuffer(b"".join(vocab), np.uint8), np.cumsum(self.sizes) - self.sizes
        # A trie, level by level: a node is the place of its (parent, byte) among all such pairs, plus one; 0 is the root.
        node, alive, keys, self.piece = np.zeros(len(vocab), np.uint64), np.arange(len(vocab)), [], [np.array([-1])]
        count = 0
        for depth in range(int(self.sizes.max()) if len(vocab) else 0):
            edge, inverse = np.unique(node[alive] << np.uint64(8) | data[begin[alive] + depth], return_inverse=True)
            node[alive] = inverse + count + 1
            keys.append(edge)
            here = np.full(len(edge), -1)
            ends = self.sizes[alive] == depth + 1
            here[inverse[ends]] = alive[ends]
            self.piece.append(here)
            count += len(edge)
            alive = alive[~ends]
        self.piece = np.concatenate(self.piece)
        self.edges = HashIndex(mix(np.concatenate(keys)) if keys else np.zeros(0, np.uint64))

    def matches(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, first byte, end, piece) of every piece in every word, places within the word."""
        word = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(word)) - (np.cumsum(size) - size)[word]
        left = size[word] - at
        alive, node, found = np.arange(len(word)), np.zeros(len(word), np.uint64), []
        length = 0
        while len(alive):
            edge = self.edges.find(mix(node << np.uint64(8) | data[start[word[alive]] + at[alive] + length]))
            known = edge >= 0
            alive, node = alive[known], (edge[known] + 1).astype(np.uint64)
            length += 1
            piece = self.piece[node.astype(np.int64)]
            has = piece >= 0
            found.append((alive[has], np.full(int(has.sum()), length), piece[has]))
            more = left[alive] > length
            alive, node = alive[more], node[more]
        k, length, piece = (np.concatenate([f[j] for f in found]) if found else np.zeros(0, np.int64) for j in range(3))
        return word[k], at[k], at[k] + length, piece

    def _pass(self, by: np.ndarray, word: np.ndarray, base: np.ndarray, to: np.ndarray, near: np.ndarray, value, table: np.ndarray) -> None:
        """table[to] = log of the sum of exp(value) over each word's matches, in order of `by`; near: a place already known that
        keeps the exponents small."""
        order = np.lexsort((word, by))
        step = np.flatnonzero(np.diff(by[order], prepend=-1, append=-1))
        for a, z in zip(step, step[1:], strict=False):
            m = order[a:z]
            first = np.flatnonzero(np.diff(word[m], prepend=-1))
            ref = table[base[word[m]] + near[m]]
            total = np.add.reduceat(np.exp(value(m) - ref), first, axis=0)
            m = m[first]
            table[base[word[m]] + to[m]] = table[base[word[m]] + near[m]] + np.log(total)

    def forward(self, got, size: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """Log-probability of reaching each place of each word (words one after another, size + 1 places each); log_p is
        pieces, or pieces x languages."""
        word, at, end, piece = got
        base = np.cumsum(size + 1) - (size + 1)
        table = np.zeros((int((size + 1).sum()), *log_p.shape[1:]))
        self._pass(end, word, base, end, end - 1, lambda m: table[base[word[m]] + at[m]] + log_p[piece[m]], table)
        return table

    def backward(self, got, size: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        word, at, end, piece = got
        base = np.cumsum(size + 1) - (size + 1)
        table = np.zeros((int((size + 1).sum()), *log_p.shape[1:]))
        self._pass(int(size.max(initial=0)) - at, word, base, at, at + 1, lambda m: table[base[word[m]] + end[m]] + log_p[piece[m]], table)
        return table

    def log_probability(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """words x languages."""
        out = np.empty((len(size), log_p.shape[1]))
        for part in _chunks(size):
            table = self.forward(self.matches(data, start[part], size[part]), size[part], log_p)
            out[part] = table[np.cumsum(size[part] + 1) - 1]
        return out

    def fit(self, words: list[bytes], weight: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
        """Piece probabilities of one language, from its words."""
        size = np.array([len(w) for w in words])
        data, start = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        got = [(part, self.matches(data, start[part], size[part])) for part in _chunks(size)]
        p = 10.0 ** -(self.sizes + 1.0)
        for _ in range(rounds):
            uses, log_p = np.zeros(len(p)), np.log(p)
            for part, m in got:
                word, at, end, piece = m
                n = size[part]
                base = np.cumsum(n + 1) - (n + 1)
                a, b = self.forward(m, n, log_p), self.backward(m, n, log_p)
                share = np.exp(a[base[word] + at] + log_p[piece] + b[base[word] + end] - a[base[word] + n[word]])
                uses += np.bincount(piece, weight[part][word] * share, len(p))
            p = (uses + 1e-3) / (uses.sum() + 1e-3 * len(uses))
        return p


def _chunks(size: np.ndarray) -> Iterator[slice]:
    """Runs of words of about CHUNK bytes, one word at least."""
    total, at = np.cumsum(size), 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK, "right")))
        yield slice(at, end)
        at = end


_segmenters: list[Segmenter] = []
memory.keeps("langid", _segmenters.clear)


def segmenter() -> Segmenter:
    if not _segmenters:
        _segmenters.append(Segmenter(vocabulary()))
    return _segmenters[0]


def _lowered(part: pa.RecordBatch, text: str = "text") -> pa.Array:
    return pc.utf8_lower(part.column(text))


@memory.task("langid")
def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of each piece of the corpus (columns text, lang)."""
    for part in pieces(batches, "text"):
        words = words_of(_lowered(part), LETTERS, lower=False)
        coded = pc.dictionary_encode(part.column("lang"))
        codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        owner = codes[words.text_of]
        keys, at, inverse = np.unique(words.hash ^ mix(owner.astype(np.uint64)), return_index=True, return_inverse=True)
        n = np.bincount(inverse, minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in owner[at].tolist()], pa.string()), pa.array([words.word(k) for k in at.tolist()], pa.binary()), pa.array(n.astype(np.int64))], names=["lang", "word", "n"])


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """(lang, piece, p) of one language; piece -1 has the probability of every piece not listed."""
    pdf = pdf.sort_values("word")
    p = segmenter().fit([bytes(w) for w in pdf["word"]], pdf["n"].to_numpy(float))
    least = p.min()
    used = np.flatnonzero(p > least * (1 + 1e-9))
    return pd.DataFrame({"lang": pdf["lang"].iloc[0], "piece": np.append(used, -1), "p": np.append(p[used], least)})


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """(languages, pieces x languages probabilities) from rows of the training folds."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.filter((remainder("doc_id", FOLDS) != HELD_OUT) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = stored(sample_by(rows.select("doc_id", "lang"), "lang", DOCS_PER_LANGUAGE), "language-sample")
    texts = rows.join(chosen, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("text", "lang")
    words = texts.mapInArrow(_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    table = words.groupBy("lang").applyInPandas(_fit, "lang string, piece int, p double").toPandas()
    n = len(vocabulary())
    languages = sorted(set(table["lang"]))
    if not languages:
        return [], np.zeros((n, 0))
    out = np.empty((n, len(languages)))
    for k, language in enumerate(languages):
        mine = table[table["lang"] == language]
        piece, p = mine["piece"].to_numpy(), mine["p"].to_numpy()
        out[:, k] = p[piece == -1][0]
        out[piece[piece >= 0], k] = p[piece >= 0]
    # A share of every language's mass follows what all have in common, so that no piece is impossible.
    common = out.mean(axis=1, keepdims=True)
    return languages, 0.97 * out + 0.03 * (0.9 * common + 0.1 / n)


class WordScores:
    """Log-probabilities of words by language; remembers up to MEMORY_WORDS words."""

    def __init__(self, p: np.ndarray):
        self.log_p = np.log(p)
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros((0, p.shape[1]))
        self.known = HashIndex(self.keys)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def of(self, words) -> np.ndarray:
        out = np.empty((len(words), self.log_p.shape[1]))
        found = self.known.find(words.hash)
        has = found >= 0
        out[has] = self.rows[found[has]]
        rest = np.flatnonzero(~has)
        if len(rest):
            keys, at, inverse = np.unique(words.hash[rest], return_index=True, return_inverse=True)
            start = words.start[rest[at]]
            made = segmenter().log_probability(words.data, start, words.end[rest[at]] - start, self.log_p)
            out[rest] = made[inverse]
            self.waiting.append((keys, made))
            fresh = sum(len(k) for k, _ in self.waiting)
            if fresh * 3 >= len(self.keys) + 1 and len(self.keys) < MEMORY_WORDS:
                keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
                rows = np.concatenate([self.rows, *(r for _, r in self.waiting)])
                keys, at = np.unique(keys, return_index=True)
                self.keys, self.rows = keys, rows[at]
                self.known, self.waiting = HashIndex(self.keys), []
            elif len(self.keys) >= MEMORY_WORDS:
                self.waiting = []
        return out


RESULTS = "lang_pred string, score double, n_words long"


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep, then the best language of every row and its posterior, tempered by the square root of the number of words."""
    ship(docs.sparkSession)
    keep = tuple(c for c in keep if c not in ("lang_pred", "score", "n_words"))
    languages, p = model

    @memory.task("langid")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(p) if languages else None
        for part in pieces(batches, text):
            n = part.num_rows
            low = _lowered(part, text)
            words = words_of(low, LETTERS, lower=False)
            count = words.counts
            pred, sure = np.full(n, len(languages)), np.zeros(n)
            if languages and len(words):
                each = scores.of(words)
                total = np.stack([sums(each[:, k], words.first) for k in range(len(languages))], axis=1)
                best = total.argmax(axis=1)
                odds = np.exp((total - total.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(count, 1))[:, None])
                plain = (words.data[words.start] < 0x80) | (words.data[words.end - 1] < 0x80)
                has = sums(plain.astype(np.int64), words.first) > 0
                for d in np.flatnonzero((count > 0) & ~has).tolist():
                    has[d] = any(c.isalpha() for c in low[d].as_py())
                pred[has], sure[has] = best[has], (odds.max(axis=1) / odds.sum(axis=1))[has]
            names = np.array([*languages, "und"], object)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(names[pred].tolist(), pa.string()), pa.array(sure), pa.array(count.astype(np.int64))], names=[*keep, "lang_pred", "score", "n_words"])

    schema = T.StructType([docs.schema[c] for c in keep] + T._parse_datatype_string(RESULTS).fields)
    return docs.select(*keep, *([] if text in keep else [text])).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: predicted language of every document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs, train(docs))
    return out.select("doc_id", (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "n_words")
