"""Toxicity by maximum-scoring segments.

Training (on labelled rows of the training fold) counts the toxic and the clean documents that hold a word.  A word's score is its
log-odds with a Dirichlet prior drawn from the pooled counts, kept only where a likelihood-ratio test tells the classes
apart; every other word costs a drift, chosen so that the expected score of clean text is
negative.  A linear-time scan (Ruzzo and Tompa) over a text's scores finds all maximal scoring segments.  Segment scores follow
an extreme-value law under clean text: lambda solves E[exp(lambda s)] = 1 over clean words, K is fitted to the largest segments
of clean training documents; so each segment has an E-value, significant ones are passages, and the
text's evidence is the sum of -ln E over its segments with E below 1.  A logistic curve fitted on the training rows turns evidence
into a probability.

The labelled rows used are at most LABELLED_ROWS per class (by hash of the id, a documented bound, so that the
model and its vocabulary, all telling words of those texts, are bounded and may be sent to every task); scores cover all rows.

Contract of ``score``: one row per input row.  Null and empty texts have no words and get the score of no evidence.
Without training rows of both classes every score is the prior (0 if there are none).  Labels repeated for a doc_id
count once (the largest); of an id's rows the first text in code point order teaches.  Repeated rows give repeated results; whole texts are read; an empty table gives an
empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm import memory
from tidewatch.llm.common import load, remainder, sample_by, ship, stored
from tidewatch.llm.textvec import ALNUM, HashIndex, Words, pieces, words_of

LABELLED_ROWS = 12_000
PRIOR_MASS = 500.0
#: Least signed root of the likelihood ratio.
Z_LEAST = 4.5
#: Largest E-value of a segment that counts as a passage.
SIGNIFICANT = 0.05
FOLDS, HELD_OUT = 4, 2
CUT = 0.3


@dataclass
class Model:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    drift: float = -0.05
    lam: float = 1.0
    log_k: float = 0.0
    slopes: tuple[float, float] = (0.0, 0.0)
    level: float = -20.0

    def probability(self, evidence: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(np.array(self.slopes) @ features(evidence, n) + self.level)))


def features(evidence: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the logistic curve sees: the evidence, ever less of it the more there is, and the evidence for the text's length (a long
    text gathers some by chance)."""
    return np.stack([60.0 * -np.expm1(-evidence / 60.0), np.log1p(100.0 * evidence / (n + 50.0))])


def maximal_segments(at: list[int], gain: list[float], drift: float, base: int = 0) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score) of a sequence that has `gain[i]` at position
    `at[i]` and `drift` (< 0) elsewhere.  Linear: runs of drift need one step each."""
    left, right, lo, hi = [], [], [], []  # candidate segments with cumulative sums before and at their ends
    total, last = 0.0, base
    for p, g in zip(at, gain, strict=True):
        total += drift * (p - last)
        before, total = total, total + g
        last = p + 1
        if g <= 0:
            continue
        l, r, a, b = p, p + 1, before, total
        while True:
            j = len(lo) - 1
            while j >= 0 and lo[j] >= a:
                j -= 1
            if j < 0 or hi[j] >= b:
                left.append(l), right.append(r), lo.append(a), hi.append(b)
                break
            l, a = left[j], lo[j]
            del left[j:], right[j:], lo[j:], hi[j:]
    return [(l, r, b - a) for l, r, a, b in zip(left, right, lo, hi, strict=True)]


def _scored(words: Words, index: HashIndex, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word positions, scores, text of each) of the words that have a score of their own."""
    found = index.find(words.hash)
    at = np.flatnonzero(found >= 0)
    return at, scores[found[at]], np.searchsorted(words.first, at, "right") - 1


def segments_of(words: Words, index: HashIndex, model: Model) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """(text, its maximal segments in words of the text) for texts with a word of positive score."""
    at, gain, owner = _scored(words, index, model.scores)
    cut = np.flatnonzero(np.diff(owner, prepend=-1, append=-1)) if len(owner) else np.zeros(0, int)
    for a, b in zip(cut, cut[1:], strict=False):
        d = int(owner[a])
        if (gain[a:b] > 0).any():
            yield d, maximal_segments((at[a:b] - words.first[d]).tolist(), gain[a:b].tolist(), model.drift)


def _evidence(segments: list[tuple[int, int, float]], n: int, model: Model) -> tuple[float, float, list[tuple[int, int, float]]]:
    """(evidence, smallest E-value's log, significant segments)."""
    evidence, best, kept = 0.0, np.inf, []
    for s, e, score in segments:
        log_e = model.log_k + np.log(max(n, 1)) - model.lam * score
        best = min(best, log_e)
        if log_e <= np.log(SIGNIFICANT):
            kept.append((s, e, float(np.exp(log_e))))
        evidence += max(0.0, -log_e)
    return evidence, best, kept


def _solve_lambda(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(weights * exp(lambda * values)) = 1; mean negative, some value positive."""
    low, high = 1e-6, 1.0
    f = lambda x: np.log(np.dot(weights, np.exp(x * values)))
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


_COUNTS = "word long, toxic long, clean long"


@memory.task("toxicity")
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by class of the labelled texts (columns text, toxic) that hold a word, a partial sum for each
    piece.  A text counts a word once: a word that one text repeats a thousand times tells no more than once."""
    for part in pieces(batches, "text"):
        words = words_of(part.column("text"), ALNUM)
        owner = words.text_of
        order = np.lexsort((words.hash, owner))
        h, owner = words.hash[order], owner[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(bool)[owner[fresh]]
        keys, inverse = np.unique(h[fresh], return_inverse=True)
        n = np.bincount(inverse, minlength=len(keys))
        t = np.bincount(inverse, weights=toxic, minlength=len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(t), pa.array(n - t)], names=["word", "toxic", "clean"])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit a Model on docs (doc_id, text) joined with labels (doc_id, toxic)."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    marked = marked.filter(remainder("doc_id", FOLDS) != HELD_OUT).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = stored(sample_by(marked, "toxic", LABELLED_ROWS).select("doc_id", "toxic"), "toxicity-labelled", 1)
    # At most 2 * LABELLED_ROWS ids: a bounded broadcast.  Of an id's rows the first text in code point order teaches.
    texts = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"), "toxicity-texts")
    size = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        return Model(level=20.0 if 1 in size else -20.0)
    words = stored(texts.mapInArrow(_counts, _COUNTS).groupBy("word").agg(F.sum("toxic").alias("y"), F.sum("clean").alias("x")), "toxicity-words")
    total = words.agg(F.sum("y").alias("y"), F.sum("x").alias("x")).first()
    n_y, n_x = float(total["y"] or 0), float(total["x"] or 0)
    if not n_y or not n_x:
        return Model()
    prior = (F.col("x") + F.col("y")) / F.lit(n_x + n_y) * F.lit(PRIOR_MASS)
    a, b = F.col("y") + prior, F.col("x") + prior
    odds = F.log(a / (F.lit(n_y + PRIOR_MASS) - a)) - F.log(b / (F.lit(n_x + PRIOR_MASS) - b))
    # Signed root of the likelihood ratio of "the classes differ": holds where a class lacks the word, as a standard error doesn't.
    both = F.col("x") + F.col("y")
    term = lambda c, n: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) * (n_x + n_y) / (both * n))).otherwise(0.0)
    z = F.signum(odds) * F.sqrt(F.greatest(F.lit(0.0), 2 * (term("y", n_y) + term("x", n_x))))
    top = words.select("word", "x", odds.alias("odds"), z.alias("z")).filter(F.abs("z") >= Z_LEAST).toPandas().sort_values("word")
    if not (top["odds"] > 0).any():
        return Model(level=float(np.log(size[1] / size[0])))
    keys, scores, clean = top["word"].to_numpy(np.int64).view(np.uint64), top["odds"].to_numpy(float), top["x"].to_numpy(float)
    # Drift: clean text must lose on average, and one telling word may bridge some tens of others.
    share = clean / n_x
    gain = float(np.dot(share, np.maximum(scores, 0)))
    drift = -max(0.02, 2 * gain / max(1e-9, 1 - share.sum()))
    model = Model(keys, scores, drift)
    model.lam = _solve_lambda(np.append(scores, drift), np.append(share, 1 - share.sum()))
    stats = texts.mapInArrow(_statistics(model), "toxic int, n long, best double, total array<double>").toPandas()
    # K: under clean text the mean of (lambda * largest - log n) is log K + Euler's constant.
    quiet = stats[(stats["toxic"] == 0) & (stats["n"] > 0)]
    model.log_k = float(np.mean(model.lam * quiet["best"] - np.log(quiet["n"])) - np.euler_gamma) if len(quiet) else 0.0
    evidence = np.array([sum(max(0.0, model.lam * s - model.log_k - np.log(max(n, 1))) for s in t) for t, n in zip(stats["total"], stats["n"], strict=True)])
    # The classes count as in the labelled fold, not as sampled.
    true = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = np.where(stats["toxic"] == 1, true[1] / size[1], true[0] / size[0])
    *slopes, model.level = _logistic(features(evidence, stats["n"].to_numpy(float)), stats["toxic"].to_numpy(float), weight)
    model.slopes = tuple(slopes)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.1) -> list[float]:
    """Weighted logistic regression of y on the rows of x by damped Newton steps; slopes, then the level."""
    X = np.vstack([x, np.ones(x.shape[1])])
    pull = np.diag([ridge] * len(x) + [1e-6])
    t = np.append(np.zeros(len(x)), np.log((w @ y + 1) / (w @ (1 - y) + 1)))
    loss = lambda t: float(np.sum(w * (np.logaddexp(0, t @ X) - y * (t @ X))) + t @ pull @ t / 2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-(t @ X)))
        step, size = np.linalg.solve((X * (w * p * (1 - p))) @ X.T + pull, X @ (w * (p - y)) + pull @ t), 1.0
        while size > 1e-4 and loss(t - size * step) > loss(t):
            size /= 2
        t = t - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return t.tolist()


def _statistics(model: Model):
    @memory.task("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = HashIndex(model.keys)
        for part in pieces(batches, "text"):
            words = words_of(part.column("text"), ALNUM)
            scores = [[] for _ in range(part.num_rows)]
            for d, segments in segments_of(words, index, model):
                scores[d] = [s for _, _, s in segments]
            yield pa.RecordBatch.from_arrays(
                [part.column("toxic"), pa.array(words.counts.astype(np.int64)), pa.array([max(s, default=0.0) for s in scores], pa.float64()), pa.array(scores, pa.list_(pa.float64()))],
                names=["toxic", "n", "best", "total"],
            )

    return run


RESULTS = "score double, predicted int, n_words long, evidence double, passages array<struct<start_word:long,end_word:long,e_value:double>>"


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep, then probability, prediction and significant passages of every row."""
    ship(docs.sparkSession)
    keep = tuple(c for c in keep if c not in ("score", "predicted", "n_words", "evidence", "passages"))

    @memory.task("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = HashIndex(model.keys)
        kind = pa.list_(pa.struct([("start_word", pa.int64()), ("end_word", pa.int64()), ("e_value", pa.float64())]))
        for part in pieces(batches, text):
            words = words_of(part.column(text), ALNUM)
            n = words.counts
            evidence, passages = np.zeros(part.num_rows), [[] for _ in range(part.num_rows)]
            for d, segments in segments_of(words, index, model):
                evidence[d], _, kept = _evidence(segments, int(n[d]), model)
                passages[d] = [{"start_word": s, "end_word": e, "e_value": v} for s, e, v in kept]
            p = model.probability(evidence, n)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), pa.array(p), pa.array((p >= CUT).astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(evidence), pa.array(passages, kind)],
                names=[*keep, "score", "predicted", "n_words", "evidence", "passages"],
            )

    schema = T.StructType([docs.schema[c] for c in keep] + T._parse_datatype_string(RESULTS).fields)
    return docs.select(*keep, *([] if text in keep else [text])).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: toxicity of every document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    ship(spark)
    model = train(docs, load(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select("doc_id", (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted", "n_words", F.size("passages").alias("n_passages"), "evidence")
