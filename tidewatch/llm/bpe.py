"""BPE encoding and decoding by speculation and verification.

A text is normalised and split into pre-tokens; a worker encodes equal pre-tokens once while it remembers
them.  For a pre-token, greedy longest match *proposes* pieces (all new pre-tokens of a batch walk a trie side by side).  A sequence of pieces is the one that merging
by rank gives if and only if every two neighbours, encoded together, stay as they are; all
neighbouring pairs of a batch's proposals are checked at once against a table of pairs already judged
(sorted 64-bit keys), and pairs not yet judged are judged once, by merging the two alone.  Only pre-tokens with a failing
pair are merged exactly: those of equal length as rows of a matrix, one merge a row at a time, long ones by a heap over ranks.

Contract of ``encode_decode``: one row per input row with its other columns untouched; a null or
empty text has no ids (n_tokens 0, empty ids, empty decoded text).  Strings of the vocabulary's added special
tokens become their ids, as the tokenizer file asks.  Texts of any length; repeated rows give
repeated results; an empty table gives an empty one.  Columns named like the results are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewatch.llm import memory
from tidewatch.llm.common import ship
from tidewatch.llm.textvec import HashIndex, pieces

#: Pre-tokens a worker remembers; then it forgets those met in one batch only (all, if that isn't enough).
MEMORY_WORDS = 200_000
PAIRS_MEMORY = 2_000_000
LONGEST_REMEMBERED = 64
#: Bytes of a pre-token, at most, that is proposed and merged with others at once.
LONGEST_TOGETHER = 64
#: The rank of a pair that doesn't merge; spreads the bits of packed keys.
NEVER, SPREAD = np.int32(2**31 - 1), np.uint64(0x9E3779B97F4A7C15)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level BPE files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + extra)
            extra += 1
    return [table[b] for b in range(256)]


@functools.cache
def _ranges(name: str) -> str:
    """A character class as ranges, as the tokenizer's own regular expressions have it: Unicode versions differ."""
    from tokenizers import Regex, pre_tokenizers

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    runs = pre_tokenizers.Split(Regex(f"[{name}]+"), "removed", invert=True).pre_tokenize_str(every)
    return "".join(f"\\U{ord(r[0]):08x}-\\U{ord(r[-1]):08x}" for r, _ in runs)


class SpeculativeBpe:
    """Encoder and decoder for a word-end BPE file (JSON: vocab, merges, split pattern)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in reversed(list(enumerate(merges)))}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        latin = pattern  # for Latin-1, where all Unicode versions agree
        for name in (r"\p{L}", r"\p{N}", r"\s"):
            latin = latin.replace(name, "".join(f"\\x{c:02x}" for c in range(256) if regex.match(name, chr(c))))
            pattern = pattern.replace(name, _ranges(name))
        self.quick = re.compile(latin)
        self.split = re.compile(pattern)
        self.cut = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.mark = os.path.commonprefix(list(self.added))  # a text without it holds no added token
        self.symbol = _byte_symbols()
        self.text_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        #: Only pieces that merging can make (or single symbols) may be proposed.
        made = {a + b for a, b in merges} | {s + e for s in self.symbol for e in ("", self.suffix)}
        self.inner = {t: i for t, i in self.vocab.items() if t in made and not (self.suffix and t.endswith(self.suffix))}
        self.final = {t[: len(t) - len(self.suffix)]: i for t, i in self.vocab.items() if t in made and t.endswith(self.suffix)}
        self.longest = max(map(len, made))
        self.good = np.zeros(0, np.uint64)
        self.bad = np.zeros(0, np.uint64)
        self.once: set[str] = set()
        #: Of each remembered pre-token: ids as text, decoded text.
        self.words: dict[str, str] = {}
        self.names: dict[str, str] = {}
        self._tables(merges)

    def _tables(self, merges: list[tuple[str, str]]) -> None:
        """Arrays for many pre-tokens at once: symbols of bytes and tokens, merges by pair, the trie of pieces."""
        self.inner_symbol = np.array([self.vocab[c] for c in self.symbol], np.int32)
        self.final_symbol = np.array([self.vocab[c + self.suffix] for c in self.symbol], np.int32)
        pairs = list(self.rank)
        self.pairs = HashIndex(_packed(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])))
        self.pair_rank = np.array([*(self.rank[p][0] for p in pairs), NEVER], np.int32)  # the last: of no pair
        self.made = np.zeros(len(merges), np.int32)
        self.made[self.pair_rank[:-1]] = [self.rank[p][1] for p in pairs]
        byte, node = {c: b for b, c in enumerate(self.symbol)}, {(0, -1): 0}
        ends: dict[int, list[int]] = {}
        for which, table in enumerate((self.inner, self.final)):
            for piece, token in table.items():
                at = 0
                for c in piece:
                    at = node.setdefault((at, byte[c]), len(node))
                ends.setdefault(at, [-1, -1])[which] = token
        steps = [k for k in node if k[1] >= 0]
        self.steps = HashIndex(_packed(np.array([a for a, _ in steps]), np.array([b for _, b in steps])))
        self.step_to = np.array([*map(node.__getitem__, steps), -1], np.int64)
        self.ends = np.full((len(node), 2), -1, np.int64)
        self.ends[list(ends)] = list(ends.values())

    # -- exact merging -------------------------------------------------------------------------
    def merge(self, ids: list[int]) -> list[int]:
        """Merge by rank, leftmost first among equals, until nothing merges; n log n."""
        n = len(ids)
        ids, nxt, prev, alive = list(ids), [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(*self.rank[p], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.rank]
        heap = [(r, i, new, a, b) for r, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], nxt[i] = new, False, nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            for left, right in ((prev[i], i), (i, nxt[i])):
                if left >= 0 and right >= 0 and (p := (ids[left], ids[right])) in self.rank:
                    r, made = self.rank[p]
                    heapq.heappush(heap, (r, left, made, *p))
        return [x for x, a in zip(ids, alive, strict=True) if a]

    def symbols(self, token: int) -> list[int]:
        text = self.text_of[token]
        if self.suffix and text.endswith(self.suffix):
            text = text[: len(text) - len(self.suffix)]
            return [*(self.vocab[c] for c in text[:-1]), self.vocab[text[-1] + self.suffix]]
        return [self.vocab[c] for c in text]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.pair_rank[self.pairs.find(_packed(a, b))]

    def merge_many(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """merge() of many runs of ids, one after another: (ids, sizes).  Rows of equal length lose one id each at a time."""
        begin, made, left = np.cumsum(sizes) - sizes, [], np.zeros(len(sizes), np.int64)
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            if size > LONGEST_TOGETHER:
                for r in rows.tolist():
                    ids = self.merge(flat[begin[r] : begin[r] + size].tolist())
                    made.append((np.array([r]), np.array([ids], np.int32)))
                continue
            ids = flat[begin[rows][:, None] + np.arange(size)]
            rank = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), max(size - 1, 0))
            while len(rows):
                if size < 2:
                    made.append((rows, ids))
                    break
                at = rank.argmin(axis=1)
                low = rank[np.arange(len(rows)), at]
                live = low != NEVER
                if not live.all():
                    made.append((rows[~live], ids[~live]))
                    rows, ids, rank, at, low = rows[live], ids[live], rank[live], at[live], low[live]
                    if not len(rows):
                        break
                n = np.arange(len(rows))
                ids[n, at] = self.made[low]
                stay = np.ones(ids.shape, bool)
                stay[n, at + 1] = False
                ids, size = ids[stay].reshape(len(rows), size - 1), size - 1
                stay = np.ones(rank.shape, bool)
                stay[n, at] = False
                rank = rank[stay].reshape(len(rows), size - 1)
                for shift in (-1, 0):  # the pairs with the ids before and after the new one
                    k = np.flatnonzero((at + shift >= 0) & (at + shift < size - 1))
                    pair = at[k] + shift
                    rank[k, pair] = self.ranks(ids[k, pair], ids[k, pair + 1])
        for rows, ids in made:
            left[rows] = ids.shape[1]
        begin, out = np.cumsum(left) - left, np.zeros(int(left.sum()), np.int32)
        for rows, ids in made:
            out[begin[rows][:, None] + np.arange(ids.shape[1])] = ids
        return out, left

    # -- speculation ---------------------------------------------------------------------------
    def propose(self, word: str) -> list[int]:
        """Greedy longest match; the last piece carries the word end."""
        out, at, n = [], 0, len(word)
        while at < n:
            if n - at <= self.longest and (last := self.final.get(word[at:])) is not None:
                out.append(last)
                break
            for end in range(min(n - 1, at + self.longest), at, -1):
                if (piece := self.inner.get(word[at:end])) is not None:
                    out.append(piece)
                    at = end
                    break
            else:
                raise ValueError("the vocabulary lacks a byte symbol")
        return out

    def propose_many(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """propose() of words data[begin:end], none empty, side by side: (ids, sizes)."""
        live, at, met = np.arange(len(begin)), begin.astype(np.int64), []
        node, best, best_end, end = (np.zeros(len(begin), np.int64), np.full(len(begin), -1), at.copy(), end.astype(np.int64))
        while len(live):
            to = self.step_to[self.steps.find(_packed(node, data[at]))]
            moved = to >= 0
            node, at = np.where(moved, to, node), at + moved
            inner, final = self.ends[node].T
            last = at == end
            over = moved & last & (final >= 0)
            better = moved & ~last & (inner >= 0)
            best, best_end = np.where(better, inner, best), np.where(better, at, best_end)
            again = ~moved | (last & ~over)
            if (again & (best < 0)).any():
                raise ValueError("the vocabulary lacks a byte symbol")
            said = over | again
            met.append((live[said], np.where(over, final, best)[said]))
            at, node, best = np.where(again, best_end, at), np.where(again, 0, node), np.where(again, -1, best)
            if over.any():
                live, at, node, best, best_end, end = (x[~over] for x in (live, at, node, best, best_end, end))
        owner, ids = (np.concatenate([m[k] for m in met]) if met else np.zeros(0, np.int64) for k in (0, 1))
        return ids[np.argsort(owner, kind="stable")].astype(np.int32), np.bincount(owner, minlength=len(begin))

    # -- verification --------------------------------------------------------------------------
    def judge(self, keys: np.ndarray) -> np.ndarray:
        """For each packed pair of neighbours: do the two stay apart when encoded together?"""
        ok, bad = _among(keys, self.good), _among(keys, self.bad)
        new = np.unique(keys[~(ok | bad)])
        if len(new):
            pair = np.stack([new >> np.uint64(32), new & np.uint64(0xFFFFFFFF)], axis=1).astype(np.int32)
            apart = [[*self.symbols(a), *self.symbols(b)] for a, b in pair.tolist()]
            ids, sizes = self.merge_many(np.array([i for x in apart for i in x], np.int32), np.fromiter(map(len, apart), np.int64, len(apart)))
            verdict = sizes == 2
            first = (np.cumsum(sizes) - sizes)[verdict]
            verdict[verdict] = (ids[first] == pair[verdict, 0]) & (ids[first + 1] == pair[verdict, 1])
            self.good, self.bad = np.union1d(self.good, new[verdict]), np.union1d(self.bad, new[~verdict])
            ok |= _among(keys, self.good)
            if len(self.good) + len(self.bad) > PAIRS_MEMORY:
                self.good, self.bad = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return ok

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of pre-tokens, none empty, one after another."""
        raw = [w.encode() for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        data, end = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(length)
        short = length <= LONGEST_TOGETHER
        flat, few = self.propose_many(data, (end - length)[short], end[short])
        sizes = np.zeros(len(words), np.int64)
        sizes[short] = few
        if not short.all():
            long = {k: self.propose("".join(map(self.symbol.__getitem__, raw[k]))) for k in np.flatnonzero(~short).tolist()}
            sizes[list(long)] = [len(x) for x in long.values()]
            whole = np.zeros(int(sizes.sum()), np.int32)
            whole[np.repeat(short, sizes)] = flat
            whole[np.repeat(~short, sizes)] = [i for x in long.values() for i in x]
            flat = whole
        if len(flat) < 2:
            return flat, sizes
        first = np.zeros(len(flat), bool)
        first[np.cumsum(sizes)[:-1]] = True
        pair = np.flatnonzero(~first[1:])
        ok = self.judge(flat[pair].astype(np.uint64) << np.uint64(32) | flat[pair + 1].astype(np.uint64))
        failed = np.zeros(len(words), bool)
        failed[np.repeat(np.arange(len(words)), sizes)[pair[~ok]]] = True
        if not failed.any():
            return flat, sizes
        symbols = self.inner_symbol[data]
        symbols[end - 1] = self.final_symbol[data[end - 1]]
        exact, n = self.merge_many(symbols[np.repeat(failed, length)], length[failed])
        stay = flat[np.repeat(~failed, sizes)]
        sizes[failed] = n
        flat = np.zeros(int(sizes.sum()), np.int32)
        flat[np.repeat(failed, sizes)], flat[np.repeat(~failed, sizes)] = exact, stay
        return flat, sizes

    def learn(self, words: list[str]) -> None:
        """Remember ids as text and decoded text of each new pre-token."""
        if not words:
            return
        flat, sizes = self.encode_words(words)
        ids, at = flat.tolist(), 0
        shown, names = list(map(str, ids)), list(map(self.text_of.__getitem__, ids))
        for w, n in zip(words, sizes.tolist(), strict=True):
            self.words[w], self.names[w] = " ".join(shown[at : at + n]), " ".join(names[at : at + n])
            at += n

    def segments(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is an added token, text), in order."""
        if self.cut is None or self.mark not in text:
            yield False, text
            return
        at = 0
        for m in self.cut.finditer(text):
            if m.start() > at:
                yield False, text[at : m.start()]
            yield True, m[0]
            at = m.end()
        if at < len(text):
            yield False, text[at:]

    def pre_tokens(self, text: str) -> list[str]:
        """Normalised (NFC, lower case letter by letter) and split; white space is dropped."""
        if not text.isascii() and ("\u03a3" in text or not unicodedata.is_normalized("NFC", text)):
            # Only the capital sigma's lower case depends on its place in a whole string.
            text = "".join([c.lower() for c in unicodedata.normalize("NFC", text)])
        else:
            text = text.lower()
        if text.isascii():
            return self.quick.findall(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split.findall(text)
        return self.quick.findall(text)

    def encode_batch(self, texts: list[str | None]) -> list[tuple[str, int, str]]:
        """(ids joined by spaces, number of ids, decoded text) of each text."""
        cut = [[(special, [s] if special else self.pre_tokens(s)) for special, s in self.segments(t or "")] for t in texts]
        met: set[str] = set()
        for row in cut:
            for special, ws in row:
                if not special:
                    met.update(ws)
        self.once -= met
        known = self.words
        todo = [w for w in met if w not in known]
        if len(known) + len(todo) > MEMORY_WORDS:
            for w in self.once:
                del known[w], self.names[w]
            if len(known) > MEMORY_WORDS // 2:
                known.clear()
                self.names.clear()
                todo = list(met)
            self.once = set()
        self.learn(todo)
        self.once.update(todo)
        out = []
        for row in cut:
            if len(row) == 1 and not row[0][0]:
                ids, names = (" ".join(map(of.__getitem__, row[0][1])) for of in (known, self.names))
            else:
                ids = " ".join([str(self.added[w]) if special else known[w] for special, ws in row for w in ws])
                names = " ".join([w if special else self.names[w] for special, ws in row for w in ws])
            out.append((ids, ids.count(" ") + 1 if ids else 0, names))
        for w in [w for w in todo if len(w) > LONGEST_REMEMBERED]:
            del known[w], self.names[w]
            self.once.discard(w)
        return out


def _packed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of pairs, with their bits spread."""
    return (a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) * SPREAD


def _among(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys


_encoders: dict[str, SpeculativeBpe] = {}
memory.keeps("bpe", _encoders.clear)


def encoder(path: str | None = None) -> SpeculativeBpe:
    """The process's encoder of a file; None: the public file, wherever this machine has it."""
    path = path or tokenizer_path()
    if path not in _encoders:
        _encoders[path] = SpeculativeBpe(path)
    return _encoders[path]


RESULTS = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}


def encode_decode(docs: DataFrame, text: str = "text", path: str | None = None, results: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """docs with the asked RESULTS added: ids of each text and the text decoded from them."""
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c not in results]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(r, RESULTS[r]) for r in results])

    @memory.task("bpe")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for part in pieces(batches, text):
            rows = bpe.encode_batch(part.column(text).to_pylist())
            made = {
                "n_tokens": lambda: pa.array([r[1] for r in rows], pa.int64()),
                "ids": lambda: pa.array([list(map(int, r[0].split())) for r in rows], pa.list_(pa.int32())),
                "decoded": lambda: pa.array([r[2] for r in rows], pa.string()),
                "ids_sha256": lambda: pa.array([hashlib.sha256(r[0].encode()).hexdigest() for r in rows]),
                "decoded_sha256": lambda: pa.array([hashlib.sha256(r[2].encode()).hexdigest() for r in rows]),
            }
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [made[r]() for r in results], names=[*keep, *results])

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: digests of ids and of decoded text for every document."""
    from tidewatch.llm.common import load

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, results=("n_tokens", "ids_sha256", "decoded_sha256")).drop("text")
