"""Hard-negative mining by orthogonal PCA rotation.

Components become integers floor(SCALE * x).  Vectors are rotated onto principal axes, which keeps inner products; the leading
axes are added up first, and what is left of a product is bounded by the product of the two residual norms plus the rounding that
single precision may have added.  A pair goes once its bound falls out of what is asked of its anchor; survivors get
their integer product, in whole numbers.

Anchors meet all rows in blocks of bounded bytes: blocks of rows by blocks of anchors, each pair of blocks one task.  It returns a
task's best of each anchor, which are ranked again over all blocks.  Two passes: the anchors' positives (best of the same
label; an anchor's own best lower bounds tell what can be dropped), then for each positive the negatives between its score and
LEAST_SHARE percent of it.  Blocks are dealt by hash of the id, so neither a hot label nor copies gather in one.

The axes come from at most SAMPLE rows; they order the work and don't touch results.

Contract of ``mine``: rows whose id or label is null, or whose vector is null, holds a null or non-finite component, or has another length
than the commonest (the larger on a tie), take no part; zero vectors do.  Of rows that repeat an id one takes part, that of the smallest label, then the
smallest vector.  Ties of scores go to the smaller id.  Anchors without another row of their label have no rows in the
result, nor have positives without negatives in range (none of a negative score).  Scores beyond 64 bits are cut to the largest
long.  Empty tables give no rows; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import load, stored
from tidewatch.llm.vectors import packed, unpack

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: Percent of a positive's score that its negatives have at least.
LEAST_SHARE = 80
#: Rows of a block: a BLOCKS-th of all, at least LEAST_ROWS and at most BLOCK_BYTES of doubles.
LEAST_ROWS, BLOCKS, BLOCK_BYTES = 128, 48, 16 << 20
#: Anchors of a block, at most (and BLOCK_BYTES).
ANCHORS = 4_096
SAMPLE = 20_000
#: Pairs that are bounded at once, and that get integer products at once.
CELLS, PAIRS = 1 << 21, 1 << 17
#: Shares of the axes after which bounds are tested.
STEPS = (0.25, 0.5, 0.75)
#: Where products may exceed this, plain Python integers are used.
_EXACT = 1 << 61


def integers(values, kind: str, d: int) -> np.ndarray:
    """floor(SCALE * x) of packed vectors, as doubles."""
    with np.errstate(over="ignore"):
        return np.floor(np.clip(SCALE * unpack(values, kind, d), -1e300, 1e300))


def principal_axes(rows: DataFrame, kind: str, d: int) -> np.ndarray:
    """Axes by falling mean square, as columns."""
    sample = rows.select("vec_id", "packed").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    x = integers(sample["packed"], kind, d) if len(sample) else np.zeros((0, d))
    x = x / np.maximum(1.0, np.abs(x).max(axis=1, keepdims=True)) if len(x) else x
    return np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, ::-1]) if d else np.eye(0)


def _products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs (a[i], b[j])."""
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), PAIRS):
        part = slice(at, at + PAIRS)
        out[part] = np.einsum("ij,ij->i", a[i[part]], b[j[part]])
    return out


def _huge_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All products by Python's integers, cut to longs."""
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, 1 - (1 << 63), (1 << 63) - 1).astype(np.int64)


class Rotated:
    """One side of a comparison: integers, their rotation in single precision, and residual norms after each step."""

    def __init__(self, x: np.ndarray, axes: np.ndarray):
        d = x.shape[1]
        self.ends = sorted({max(1, round(d * s)) for s in STEPS if d} | {d})[:-1]
        self.whole = x.astype(np.int64)
        turned = x @ axes
        self.turned = turned.astype(np.float32)
        self.rest = {s: np.sqrt((turned[:, s:] ** 2).sum(1)).astype(np.float32) for s in self.ends}
        self.norm = np.sqrt((turned**2).sum(1)).astype(np.float32)


def survivors(a: Rotated, b: Rotated, rows: np.ndarray, low: np.ndarray, high: np.ndarray, allowed: np.ndarray | None, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, product) of anchors `rows` and rows of b whose product may lie in the anchors' [low, high].

    best > 0: among an anchor's `best` products only; the best lower bounds then raise low.
    """
    # Rotation, sums and residual norms are each off by less than (axes + 4) half-units of single precision.
    slack = np.float32(4 * (b.turned.shape[1] + 4) * 2.0**-24) * np.outer(a.norm[rows], b.norm) + np.float32(1e-3)
    got, alive, start = np.zeros((len(rows), len(b.norm)), np.float32), None, 0
    low = low.astype(np.float32)
    for s in a.ends:
        got += a.turned[rows, start:s] @ b.turned[:, start:s].T
        start = s
        rest = np.outer(a.rest[s][rows], b.rest[s]) + slack
        if best and s == a.ends[-1] and got.shape[1] > best:
            least = got - rest
            if allowed is not None:
                least[~allowed] = -np.inf
            low = np.maximum(low, np.partition(least, -best, axis=1)[:, -best])
        alive = (got + rest >= low[:, None]) & (got - rest <= high[:, None])
        if allowed is not None:
            alive &= allowed
        if np.count_nonzero(alive) < 0.02 * alive.size:
            break
    if alive is None:
        alive = np.ones(got.shape, bool) if allowed is None else allowed
    i, j = np.nonzero(alive)
    return rows[i], j, _products(a.whole, b.whole, rows[i], j)


def _task(axes: np.ndarray, kind: str, d: int, same_label: bool):
    """Best rows of one block for each wish (anchor, positive, low, high) of one block of anchors."""

    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"anchor_id": [], "positive_id": [], "positive_score": [], "vec_id": [], "score": []}, dtype=np.int64)
        if not len(anchors) or not len(rows) or not d:
            return none
        wish = anchors[["anchor_id", "positive_id", "positive_score", "low", "high"]].to_numpy(np.int64)
        own, at = np.unique(wish[:, 0], return_index=True)
        anchor = np.searchsorted(own, wish[:, 0])
        x, y = integers(anchors["packed"].iloc[at], kind, d), integers(rows["packed"], kind, d)
        labels, others = anchors["label"].to_numpy(np.int64)[at], rows["label"].to_numpy(np.int64)
        ids = rows["vec_id"].to_numpy(np.int64)
        low, high = np.full(len(own), np.iinfo(np.int64).max), np.full(len(own), np.iinfo(np.int64).min)
        np.minimum.at(low, anchor, wish[:, 3])
        np.maximum.at(high, anchor, wish[:, 4])
        huge = d * float(np.abs(x).max()) * float(np.abs(y).max()) >= _EXACT
        a, b = (None, None) if huge else (Rotated(x, axes), Rotated(y, axes))
        found = []
        height = max(1, CELLS // len(ids))
        by_anchor = np.argsort(anchor, kind="stable")
        for top in range(0, len(own), height):
            part = np.arange(top, min(top + height, len(own)))
            allowed = (labels[part, None] == others[None, :]) == same_label
            if same_label:
                allowed &= own[part, None] != ids[None, :]
            if huge:
                i, j = np.nonzero(allowed)
                score = _huge_products(x[part], y)[i, j]
                i = part[i]
            else:
                i, j, score = survivors(a, b, part, low[part].astype(float), high[part].astype(float), allowed, POSITIVES if same_label else 0)
            # Each wish of these anchors takes its own range of what came out.
            order = np.lexsort((ids[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            begin, end = np.searchsorted(i, part, "left"), np.searchsorted(i, part, "right")
            for w in by_anchor[np.searchsorted(anchor[by_anchor], top, "left") : np.searchsorted(anchor[by_anchor], part[-1], "right")].tolist():
                p, q = begin[anchor[w] - top], end[anchor[w] - top]
                from_ = p + np.searchsorted(-score[p:q], -wish[w, 4], "left")
                to = min(from_ + (POSITIVES if same_label else NEGATIVES), p + np.searchsorted(-score[p:q], -wish[w, 3], "right"))
                if to > from_:
                    found.append((np.repeat(wish[w : w + 1, :3], to - from_, axis=0), ids[j[from_:to]], score[from_:to]))
        if not found:
            return none
        of = np.concatenate([f[0] for f in found])
        return pd.DataFrame({"anchor_id": of[:, 0], "positive_id": of[:, 1], "positive_score": of[:, 2], "vec_id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])})

    return run


_FOUND = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def _one_an_id(rows: DataFrame) -> DataFrame:
    """rows (vec_id, label, packed), of those that repeat an id the smallest."""
    again = stored(rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("vec_id"), "hardneg-again")
    if not again.head(1):
        return rows
    least = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "packed")).alias("x")).select("vec_id", "x.label", "x.packed")
    return stored(rows.join(again, "vec_id", "left_anti").unionByName(least), "hardneg-once")


def mine(table: DataFrame, anchors: Column, label: str | Column = "label", vec_id: str = "vec_id", vector: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors: which rows are, by ``vec_id``."""
    label = F.col(label) if isinstance(label, str) else label
    usable = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("embedding"), label.cast("long").alias("label")).filter("vec_id IS NOT NULL AND label IS NOT NULL")
    rows, kind, d = packed(usable, "vec_id", "embedding", keep=("label",), zeros=True)
    rows = _one_an_id(stored(rows.filter("packed IS NOT NULL"), "hardneg-rows"))
    n = rows.count()
    most = max(1, BLOCK_BYTES // (8 * max(1, d)))
    size = block_rows or min(most, max(LEAST_ROWS, n // BLOCKS))
    axes = principal_axes(rows, kind, d)
    queries = rows.filter(anchors)
    of_rows, of_anchors = max(1, -(-n // size)), max(1, -(-queries.count() // min(most, block_rows or ANCHORS)))
    place = lambda key, parts, salt: F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    right = rows.select("*", place("vec_id", of_rows, 1).alias("b")).withColumn("a", every(of_anchors))

    def best(wishes: DataFrame, same_label: bool, most: int, name: str) -> DataFrame:
        left = wishes.select("*", place("anchor_id", of_anchors, 2).alias("a")).withColumn("b", every(of_rows))
        found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(_task(axes, kind, d, same_label), _FOUND)
        ranked = stored(found, name).withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")))
        return ranked.filter(F.col("rank") <= most)

    # The first pass asks for anything; an anchor stands for its positive, which isn't known yet.
    asked = queries.select(F.col("vec_id").alias("anchor_id"), "label", "packed")
    anything = asked.select("*", F.col("anchor_id").alias("positive_id"), F.lit(0).cast("long").alias("positive_score"), F.lit(1 - (1 << 63)).alias("low"), F.lit((1 << 63) - 1).alias("high"))
    positives = best(anything, True, POSITIVES, "hardneg-positives").select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # Least whole number of LEAST_SHARE percent; 80 p = 100 q + r without leaving the longs.
    low = F.expr(f"positive_score div 100 * {LEAST_SHARE} + ceil(positive_score % 100 * {LEAST_SHARE} / 100D)").cast("long")
    ranges = positives.filter("positive_score >= 0").join(asked, "anchor_id").select("anchor_id", "label", "packed", "positive_id", "positive_score", low.alias("low"), F.col("positive_score").alias("high"))
    found = best(stored(ranges, "hardneg-ranges"), False, NEGATIVES, "hardneg-negatives")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE_SQL = """WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and([coalesce(isfinite(x), false) for x in embedding])),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT a, p.b AS p, s.b AS n, p.score AS ps, s.score AS ns, row_number() OVER (PARTITION BY a, p.b ORDER BY s.score DESC, s.b) AS rank FROM p JOIN s USING (a) WHERE NOT same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT a AS anchor_id, p AS positive_id, rank::INTEGER AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 5"""


def query(spark, sf_dir: str) -> DataFrame:
    """op12: hard negatives of every hundredth row, with every seventh label turned."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)
