"""A probabilistic suffix tree over words, with scores of whole texts.

Tokens are the words of a text, then one end; before the first word stands the same end mark as context.  The root state is the
smoothed unigram distribution (absolute discounting: the mass taken off is that of an unseen word).  Contexts grow level by
level to DEPTH words.  A context is a candidate if it has continuations seen LEAST_COUNT times or more, whatever the size of
the corpus, and its suffix (the context without its first word) was retained; it is retained if its next-word
distribution diverges from its suffix's: count * KL must exceed the description length of its parameters.  A state's
distribution is smoothed towards its suffix's (Dirichlet, weight BETA); a position is scored by its longest retained suffix.

Gathering counts.  Word counts cover all training texts.  For each level the n-grams are counted exactly by a shuffle of their hashed keys.  An
n-gram can be frequent only if the two parts that lack its first or last word are: a bitmap of the level before's hashed frequent keys (of bounded size; it lets
some others by, never stops a frequent one) keeps most of the rare ones out of the shuffle.  Another pass tells the parts of the frequent
ones, each by the texts of one tag (a byte of a text's hash), so that it comes from few tasks.

The states are a table of factors: the logarithm of a probability is the root's plus one term for each retained context of
the position and one for each listed continuation, by hashed key.  Up to SENT_FACTORS of them go to all tasks; beyond that
the most frequent go, and the others meet the texts in a shuffle join, behind a bitmap.  The result is the same.

Scoring.  Words with at least HEAD_SHARE of all tokens (at most 1 / HEAD_SHARE of them, since shares add up to 1) and
what of the factors is sent go to all tasks; the rest of a text's words meets the count table in a shuffle join.

Contract of ``score``: one row per input row.  Null and empty texts have one token, the end.  Without training rows every
probability is that of the empty counts.  Repeated rows count and score each; a null doc_id is in the training folds.
Whole texts are read; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import memory
from tidewatch.llm.common import discard, load, remainder, ship, stored
from tidewatch.llm.textvec import HashIndex, Words, block_hashes, mix, pieces, sums, words_of

FOLDS, HELD_OUT = 7, 2
#: Words of the longest context.
DEPTH = 4
LEAST_COUNT = 16
HEAD_SHARE = 2e-7
HEAD_LEAST = 2
BETA = 4.0
SENT_FACTORS = 2_500_000
#: Tokens whose n-grams a task counts before it reports them.
PART_TOKENS = 3_000_000
#: Bits of a bitmap of hashed keys, as a power of two, at most.
SIEVE_BITS = 27
END = np.uint64(0)
#: Tells the factor of a context from that of the same words as a continuation.
CONTEXT_SALT = np.int64(0x5851F42D4C957F2D)


def _words(column: pa.Array) -> Words:
    """Words of texts, hashed by blocks: every pass over the texts hashes all words again."""
    words = words_of(column, hashed=False)
    words.hash = block_hashes(words)
    return words


@memory.task("suffixlm")
def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): counts of a task, merged while they stay below some millions of words."""
    keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merge():
        nonlocal keys, n
        keys, inverse = np.unique(np.concatenate([keys, *(k for k, _ in held)]), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate([n, *(c for _, c in held)]), minlength=len(keys)).astype(np.int64)
        held.clear()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["word", "n"])

    for part in pieces(batches, "text"):
        words = _words(part.column("text"))
        k, c = np.unique(words.hash, return_counts=True)
        held.append((np.append(k, END), np.append(c, part.num_rows)))
        # Merging costs a sort of all: only when enough has come together.
        if sum(len(k) for k, _ in held) > 300_000 + len(keys) // 2:
            merge()
            if len(keys) > 1_500_000:
                yield out()
                keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if held:
        merge()
    if len(keys):
        yield out()


@dataclass
class Model:
    """What every task needs to score: counts of head words, and the factors that are sent."""

    tokens: int = 0
    words: int = 0
    discount: float = 0.5
    depth: int = 0
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sent_keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    sent_gain: np.ndarray = field(default_factory=lambda: np.zeros(0))
    # Where the factors are too many to send: a bitmap of the others, and their table.
    sieve: np.ndarray | None = None
    factors: DataFrame | None = None

    def __getstate__(self):
        return self.__dict__ | {"factors": None}

    def base(self, c):
        return np.log10((np.asarray(c, float) + 1) / (self.tokens + self.words + 1))

    def root(self, c):
        """log10 of the root state's probability of a word with count c; 0: any unseen word."""
        if not self.tokens:
            return np.zeros(len(np.atleast_1d(c)))
        c = np.asarray(c, float)
        return np.log10(np.where(c > 0, c - self.discount, self.discount * self.words) / self.tokens)


def _spread(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(sequence of word hashes, place of each text's start): start mark, words, end mark of each text in turn."""
    begin = np.arange(words.texts) * 2 + words.first[:-1]
    out = np.full(len(words) + 2 * words.texts, END.astype(np.int64))
    if len(words):
        out[np.arange(len(words)) + 1 + 2 * words.text_of] = words.hash.view(np.int64)
    return out, begin


def _gram(context: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """Hashed key of a context's continuation by a word (Grams.mixed); as a context itself, that of the longer one."""
    return mix(context.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mixed).view(np.int64)


class Grams:
    """Keys of the n-grams that end at each place of a sequence, longer ones made from shorter."""

    def __init__(self, words: Words):
        self.seq, self.begin = _spread(words)
        self.since = np.arange(len(self.seq)) - np.repeat(self.begin, np.diff(np.append(self.begin, len(self.seq))))
        self.mixed = mix(self.seq.view(np.uint64) + np.uint64(1))
        self.ends = [self.seq]  # ends[k]: of k + 1 words; only places with k before them in their text are meant

    def of(self, size: int) -> np.ndarray:
        while len(self.ends) < size:
            last, out = self.ends[-1], np.zeros(len(self.seq), np.int64)
            out[1:] = _gram(last[:-1], self.mixed[1:])
            self.ends.append(out)
        return self.ends[size - 1]

    def tags(self) -> np.ndarray:
        """A byte for each place: a hash of its text."""
        begin = np.append(self.begin, len(self.seq))
        whole = np.add.reduceat(self.seq.view(np.uint64), self.begin) if len(self.begin) else np.zeros(0, np.uint64)
        return np.repeat((mix(whole) >> np.uint64(57)).astype(np.int8), np.diff(begin))


def _sieve(keys: DataFrame) -> np.ndarray:
    """Bitmap of hashed keys (key): one bit for the leading bits of each."""
    bits = min(SIEVE_BITS, max(15, int(np.ceil(np.log2(16 * keys.count() + 1)))))
    slot = F.shiftrightunsigned("key", 64 - bits) + 1
    blocks = keys.groupBy(F.bitmap_bucket_number(slot).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros((1 << bits) // 32768, "V4096")
    for r in blocks.collect():
        out[r["block"] - 1] = bytes(r["bits"])
    return out.view(np.uint8)


def _passes(sieve: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys.view(np.uint64) >> np.uint64(64 - (len(sieve) * 8 - 1).bit_length())
    return (sieve[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


#: Mixed with a tag before it is added to an n-gram's key.
TAG_SALT = np.uint64(0xD1342543DE82EF95)


def _tagged(key: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Hashed keys of n-grams together with a text's tag."""
    return mix(key.view(np.uint64) + mix(tag.astype(np.uint64) ^ TAG_SALT)).view(np.int64)


def _count_grams(depth: int, sieve: np.ndarray):
    """Task: (key, tag, n) of n-grams of depth + 1 words, both of whose parts of depth words pass the sieve; tag is that of a
    text that holds the n-gram."""

    @memory.task("suffixlm")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        tokens = 0

        def report() -> pa.RecordBatch:
            key, tag = (np.concatenate([h[k] for h in held]) for k in range(2))
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            return pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(tag[order[first]]), pa.array(np.diff(np.append(first, len(key))))], names=["key", "tag", "n"])

        for part in pieces(batches, "text"):
            grams = Grams(_words(part.column("text")))
            short = grams.of(depth)
            at = np.flatnonzero(grams.since >= depth)
            ok = _passes(sieve, short)
            at = at[ok[at] & ok[at - 1]]
            held.append((_gram(short[at - 1], grams.mixed[at]), grams.tags()[at]))
            tokens += len(grams.seq)
            if tokens >= PART_TOKENS:
                yield report()
                held, tokens = [], 0
        if held:
            yield report()

    return run


def _find_parts(sieves: list[tuple[np.ndarray, np.ndarray]]):
    """Task: (level, key, context, suffix) of n-grams of level + 1 words that pass both sieves of their level, the keys' and
    that of keys with their tags; suffix is the n-gram without its first word."""

    @memory.task("suffixlm")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, ...]]] = [[] for _ in sieves]
        tokens = 0

        def report() -> Iterator[pa.RecordBatch]:
            for level, found in enumerate(held, 1):
                key, context, suffix = (np.concatenate([f[k] for f in found]) for k in range(3))
                key, first = np.unique(key, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), level, np.int32)), pa.array(key), pa.array(context[first]), pa.array(suffix[first])], names=["level", "key", "context", "suffix"])
                found.clear()

        for part in pieces(batches, "text"):
            grams = Grams(_words(part.column("text")))
            tags = grams.tags()
            for level, (keys, with_tags) in enumerate(sieves, 1):
                short, at = grams.of(level), np.flatnonzero(grams.since >= level)
                key = grams.of(level + 1)[at]
                ok = _passes(keys, key)
                ok[ok] = _passes(with_tags, _tagged(key[ok], tags[at[ok]]))
                held[level - 1].append((key[ok], short[at[ok] - 1], short[at[ok]]))
            tokens += len(grams.seq)
            if tokens >= PART_TOKENS:
                yield from report()
                tokens = 0
        if tokens:
            yield from report()

    return run


@memory.task("suffixlm")
def _tag_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key): the keys with their tags."""
    for batch in batches:
        key, tag = (batch.column(c).to_numpy() for c in ("key", "tag"))
        yield pa.RecordBatch.from_arrays([pa.array(_tagged(key, tag))], names=["key"])


def _frequent(docs: DataFrame, words: DataFrame, depth: int) -> list[DataFrame]:
    """Of each level from 1: (key, context, suffix, n) of the n-grams of level + 1 words seen LEAST_COUNT times.

    Most n-grams are rare, so counting ships their keys alone, each with the tag of one text that holds it, a byte.  What an n-gram
    consists of is then told for the frequent ones, by texts with that tag.
    """
    counted, sieves, keys = [], [], _sieve(words)
    for level in range(1, depth + 1):
        found = docs.mapInArrow(_count_grams(level, keys), "key long, tag tinyint, n long").groupBy("key").agg(F.min("tag").alias("tag"), F.sum("n").alias("n"))
        found = stored(found.filter(F.col("n") >= LEAST_COUNT), "suffix-counted")
        if not found.head(1):
            break
        keys = _sieve(found)
        sieves.append((keys, _sieve(found.mapInArrow(_tag_keys, "key long"))))
        counted.append(found.select(F.lit(level).alias("level"), "key", "n"))
    if not counted:
        return []
    every = counted[0]
    for more in counted[1:]:
        every = every.unionByName(more)
    parts = docs.mapInArrow(_find_parts(sieves), "level int, key long, context long, suffix long").groupBy("level", "key").agg(F.min("context").alias("context"), F.min("suffix").alias("suffix"))
    grams = stored(parts.join(every, ["level", "key"]), "suffix-grams")
    discard(*counted)
    return [grams.filter(F.col("level") == level).drop("level") for level in range(1, len(counted) + 1)]


def _grow(grams: DataFrame, before: DataFrame, n_all: float) -> tuple[DataFrame, DataFrame]:
    """(states, factors) of a level.  grams: its frequent n-grams; before: the states of the level above it: key, n, p (the
    probability of the key's last word by its longest retained suffix) and kept (its context is retained, or the root).

    States have the same columns; factors are (key, n, gain)."""
    grams = grams.join(before.select(F.col("key").alias("suffix"), F.col("p").alias("s"), F.col("kept").alias("open")), "suffix").join(before.select(F.col("key").alias("context"), F.col("n").alias("total")), "context")
    grams = stored(grams.select("key", "context", "n", "s", "open", "total"), "suffix-joined")
    s, total = F.col("s"), F.col("total")
    p = (F.col("n") + BETA * s) / (total + BETA)
    per = grams.filter("open").groupBy("context").agg(F.first("total").alias("total"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("covered"), F.sum(s).alias("covered_s"), F.sum(p * F.log(p / s)).alias("kl"))
    left, left_s = F.greatest(total - F.col("covered"), F.lit(0)), F.greatest(1 - F.col("covered_s"), F.lit(1e-9))
    rest = (left + BETA * left_s) / (total + BETA)
    kl = F.col("kl") + rest * F.log(rest / left_s)
    kept = per.filter(total * kl > 0.5 * (F.col("k") + 1) * float(np.log(max(n_all, 2)))).select("context", F.col("total").alias("n"), F.log10(rest / left_s).alias("gain"))
    kept = stored(kept, "suffix-kept")
    states = grams.join(kept.select("context", F.col("gain").alias("rest")), "context", "left").withColumn("kept", F.col("rest").isNotNull()).withColumn("p", F.when(F.col("kept"), p).otherwise(s))
    states = stored(states.select("key", "n", "p", "kept", "s", "rest"), "suffix-states")
    listed = states.filter("kept").select("key", "n", (F.log10(F.col("p") / s) - F.col("rest")).alias("gain"))
    discard(grams)
    return states, kept.select(F.col("context").bitwiseXOR(F.lit(int(CONTEXT_SALT))).alias("key"), "n", "gain").unionByName(listed)


def _by_key(keys, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed keys in order and their values: sorted once, as every task makes an index of them."""
    keys = keys.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], values[order]


def train(docs: DataFrame, depth: int = DEPTH) -> tuple[Model, DataFrame]:
    """(model, counts of all words) from docs (text); with no depth only what the words alone give, which is all that base scores need."""
    ship(docs.sparkSession)
    counts = stored(docs.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "suffix-words")
    stats = counts.agg(F.sum("n"), F.count(F.lit(1)), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    model = Model(int(stats[0] or 0), int(stats[1]))
    if not model.tokens:
        return model, counts
    if stats[2] and stats[3]:
        model.discount = stats[2] / (stats[2] + 2 * stats[3])
    head = counts.filter((F.col("n") >= max(HEAD_LEAST, HEAD_SHARE * model.tokens)) | (F.col("word") == int(END))).toArrow().to_pandas()
    model.keys, model.counts = _by_key(head["word"], head["n"].to_numpy(np.int64))
    if not depth:
        return model, counts
    # The root's states: words.  Frequent words follow from counts alone, so all levels' keys are hashes of the same kind.
    before = counts.filter(F.col("n") >= LEAST_COUNT).select(F.col("word").alias("key"), "n", ((F.col("n") - model.discount) / float(model.tokens)).alias("p"), F.lit(True).alias("kept"))
    levels, frequent = [], _frequent(docs, before.select("key"), depth)
    for d, grams in enumerate(frequent, 1):
        before, factors = _grow(grams, before, model.tokens)
        if not before.filter("kept").head(1):
            break
        levels.append(factors)
        model.depth = d
    discard(*frequent[:1])
    if not levels:
        return model, counts
    factors = levels[0]
    for more in levels[1:]:
        factors = factors.unionByName(more)
    factors = stored(factors, "suffix-factors")
    few = factors.count() <= SENT_FACTORS
    # Contexts and continuations of one length: at most tokens / n of each occur n times.
    sent = F.lit(True) if few else F.col("n") >= 2.0 * depth * model.tokens / max(SENT_FACTORS, 1e-9)
    head = factors.filter(sent).select("key", "gain").toArrow().to_pandas()
    model.sent_keys, model.sent_gain = _by_key(head["key"], head["gain"].to_numpy(float))
    if not few:
        model.factors = factors.filter(~sent).select("key", "gain")
        model.sieve = _sieve(model.factors)
    return model, counts


def _gains(model: Model, grams: Grams, sent: HashIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum of the sent factors of each place, keys that the table may have, their places in order)."""
    gain = np.zeros(len(grams.seq))
    keys, places = [], []

    def look(wanted: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Adds what is sent; which of the wanted keys are factors, or may be."""
        found = sent.find(wanted.view(np.uint64))
        has = found >= 0
        gain[at[has]] += model.sent_gain[found[has]]
        if model.sieve is not None:
            far = np.flatnonzero(~has)
            far = far[_passes(model.sieve, wanted[far])]
            keys.append(wanted[far])
            places.append(at[far])
            has[far] = True
        return has

    at = np.flatnonzero(grams.since >= 1)
    for d in range(1, model.depth + 1):
        # A context's suffix is retained if it is: places whose shorter context isn't are done.
        context = grams.of(d)
        at = at[grams.since[at] >= d]
        at = at[look(context[at - 1] ^ CONTEXT_SALT, at)]
        look(grams.of(d + 1)[at] if d < model.depth else _gram(context[at - 1], grams.mixed[at]), at)
    if not keys:
        return gain, np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, places = np.concatenate(keys), np.concatenate(places)
    order = np.argsort(places, kind="stable")
    return gain, keys[order], places[order]


def _scorer(model: Model):
    @memory.task("suffixlm")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 36
        index, sent = HashIndex(model.keys), HashIndex(model.sent_keys)
        base, root = model.base(model.counts), model.root(model.counts)
        end = np.flatnonzero(model.keys == END)
        end_base, end_root = (base[end[0]], root[end[0]]) if len(end) else (model.base(0), 0.0)
        for part in pieces(batches, "text"):
            words = _words(part.column("text"))
            n = part.num_rows
            ids = index.find(words.hash)
            head = np.flatnonzero(ids >= 0)
            owner = words.text_of
            s_base = np.bincount(owner[head], base[ids[head]], n) + end_base
            s_root = np.bincount(owner[head], root[ids[head]], n) + end_root
            far, far_n = np.zeros(0, np.int64), np.zeros(n, np.int64)
            if model.depth:
                grams = Grams(words)
                gain, far, at = _gains(model, grams, sent)
                bounds = np.append(grams.begin, len(grams.seq))
                s_root += sums(gain, bounds)
                far_n = np.diff(np.searchsorted(at, bounds))
            tail = np.flatnonzero(ids < 0)
            tail_n = np.bincount(owner[tail], minlength=n)
            listed = lambda count, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(n, dtype=np.int64)),
                    part.column("doc_id"),
                    pa.array((words.counts + 1).astype(np.int64)),
                    pa.array((words.counts + (1 if model.tokens else 0) - tail_n).astype(np.int64)),
                    pa.array(s_base),
                    pa.array(s_root),
                    listed(tail_n, words.hash[tail].view(np.int64)),
                    listed(far_n, far),
                ],
                names=["row", "doc_id", "n_tokens", "n_known", "base", "root", "tail", "far"],
            )
            row += n

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    ship(docs.sparkSession)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = stored(slim.mapInArrow(_scorer(model), "row long, doc_id long, n_tokens long, n_known long, base double, root double, tail array<long>, far array<long>"), "suffix-rows")
    # Words outside the head: those of the corpus that training met are in the count table.
    tail = rows.select("row", F.explode("tail").alias("word"))
    rare = counts.filter(F.col("n") < max(HEAD_LEAST, HEAD_SHARE * model.tokens))
    met = tail.join(rare, "word", "left")
    c = F.coalesce("n", F.lit(0)).cast("double")
    total = float(model.tokens + model.words + 1)
    base = F.log10((c + 1) / F.lit(total))
    root = F.log10(F.when(c > 0, c - model.discount).otherwise(model.discount * model.words) / float(model.tokens)) if model.tokens else F.lit(0.0)
    per = met.groupBy("row").agg(F.sum(base).alias("tail_base"), F.sum(root).alias("tail_root"), F.count("n").alias("tail_known"))
    out = rows.drop("tail", "far").join(per, "row", "left")
    if model.factors is None:
        out = out.withColumn("far_root", F.lit(0.0))
    else:
        far = rows.select("row", F.explode("far").alias("key")).join(model.factors, "key").groupBy("row").agg(F.sum("gain").alias("far_root"))
        out = out.join(far, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + zero("tail_known")).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("tail_base")).alias("base_score"),
        (F.col("root") + zero("tail_root") + zero("far_root")).alias("score"),
    )


def query(spark, sf_dir: str, depth: int = DEPTH) -> DataFrame:
    """op4: base and suffix-tree scores of every document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = train(docs.filter(remainder("doc_id", FOLDS) != HELD_OUT).select("text"), depth)
    out = score(docs, model, counts)
    return out.select("doc_id", (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: crc32 of a short ASCII text, as SQL has none.
CRC_SQL = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""
CRC_OF = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: xor(t[CAST(xor(c, b) & 255 AS INTEGER) + 1]::BIGINT, c >> 8)), 4294967295::BIGINT)"""

BASE_SQL = f"""WITH {CRC_SQL},
folded AS MATERIALIZED (SELECT doc_id, coalesce({CRC_OF} % {FOLDS} = {HELD_OUT}, false) AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), ' end') AS w FROM documents, crc),
tokens AS MATERIALIZED (SELECT doc_id, held_out, unnest(w) AS word FROM folded),
counts AS MATERIALIZED (SELECT word, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY word),
total AS (SELECT sum(c) AS n, count(*) AS v FROM counts)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 4) AS base_score
FROM tokens LEFT JOIN counts USING (word), total GROUP BY doc_id, held_out"""


def base(spark, sf_dir: str) -> DataFrame:
    """What SQL can say of op4: everything but the model's own score; so no contexts are counted."""
    return query(spark, sf_dir, 0).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))
