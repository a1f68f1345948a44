"""Approximate nearest neighbours by a permutation index.

Every vector is represented by the order of its nearest pivots.  Inverted files post a vector under its POSTED nearest
pivots, and a query is sent to the files of its ROUTED nearest pivots only.  In a file the two orders' footrule similarity (over
prefixes of PREFIX places: the sum of min(PREFIX + 1 - place) over common pivots) ranks the vectors; the best CANDIDATES share is
reranked by cosine on the original vectors.  A vector that a query meets in several files is looked at in the first.

Pivots are fitted on a bounded sample (SAMPLE rows by hash of the id, near copies left out); every row is indexed.  A file's vectors are
dealt by hash into blocks of about BLOCK_ROWS and its queries into groups of about QUERY_ROWS, by its counts, so no task holds more than
a block and a group, whatever vectors are common.  A vector is copied POSTED times for every group of its files'
queries, a query ROUTED times for every block.  A block returns each query's best few; those meet in one ranked merge.

On isotropic 64-dimensional vectors neighbours are hardly nearer than the rest, hence the large shares: a query visits about a third
of the rows.  Should a query find fewer than k rows that way though there are more, it visits all files, and all rows
of them are reranked.

Contract of ``search``: queries are rows of the table itself.  Vectors null, zero, non-finite or of another length than the
commonest take no part, as do rows without id.  A query's own id is no candidate.  Rows that repeat an id count once, with
their best score.  Ties go to the smaller id.  Fewer candidates than asked: all of them.  An empty table gives an empty
result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import load, stored
from tidewatch.llm.vectors import cosines, norms, packed, unpack

PIVOTS = 1_024
POSTED = 4
ROUTED = 128
PREFIX = 64
SAMPLE = 4_096
CANDIDATES = 0.5
LEAST_CANDIDATES = 100
#: Rows of a block; fewer where their vectors, as doubles, would take more than BLOCK_BYTES.
BLOCK_ROWS, BLOCK_BYTES = 32_768, 32 << 20
QUERY_ROWS = 8_192
#: Of the exhaustive search: rows of a block at least, queries compared at once, rows of a part whose largest is looked at first.
LEAST_BLOCK, QUERIES_AT_ONCE, PART_ROWS = 4_096, 64, 32


def fit_pivots(rows: DataFrame, kind: str, d: int, pivots: int = PIVOTS) -> np.ndarray:
    """Unit pivots from a bounded sample, none within cosine 0.98 of an earlier one."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    if not len(sample):
        return np.zeros((0, d))
    x = unpack(sample["packed"], kind, d)
    x /= norms(x)[:, None]
    chosen = np.empty((min(pivots, len(x)), d))
    chosen[0], n = x[0], 1
    for v in x[1:]:
        if n == len(chosen):
            break
        if (chosen[:n] @ v).max() < 0.98:
            chosen[n] = v
            n += 1
    return chosen[:n]


def places(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first."""
    near = x @ pivots.T
    prefix = min(prefix, len(pivots))
    order = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix]
    return np.take_along_axis(order, np.argsort(-np.take_along_axis(near, order, 1), axis=1, kind="stable"), 1)


def _unit(values, kind: str, d: int) -> np.ndarray:
    x = unpack(values, kind, d)
    return x / norms(x)[:, None]


def _with_places(pivots: np.ndarray, kind: str, d: int, most: int) -> Callable:
    """Task: adds the `most` nearest pivots of each row (vec_id, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = places(_unit(b.column("packed").to_pylist(), kind, d), pivots, most).astype(np.int32)
                offsets = np.arange(b.num_rows + 1, dtype=np.int32) * near.shape[1]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(near.ravel()))], names=[*b.schema.names, "near"])

    return run


def footrule(weights: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Similarity of each indexed row (weights: pivots x rows, PREFIX + 1 - place or 0) with a query's pivot order."""
    own = np.arange(len(order), 0, -1).astype(weights.dtype)[:, None]
    return np.minimum(weights[order], own).sum(axis=0, dtype=np.int32)


def _best(ids: np.ndarray, exact: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores of distinct ids, ties to the smaller id."""
    order = np.lexsort((ids, -exact))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def _searcher(pivots: np.ndarray, kind: str, d: int, k: int, share: float, routed: int) -> Callable:
    def run(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(data) and len(asked):
            x, q = unpack(data["packed"], kind, d), unpack(asked["packed"], kind, d)
            ids = data["vec_id"].to_numpy(np.int64)
            unit = x / norms(x)[:, None]
            prefix = min(PREFIX, len(pivots))
            weights = np.zeros((len(pivots), len(x)), np.uint8)
            weights[places(unit, pivots, prefix), np.arange(len(x))[:, None]] = np.arange(prefix, 0, -1, dtype=np.uint8)
            # The nearer pivots under which a row is posted too; the last, which no query has, fills up.
            earlier = np.full((len(x), POSTED), len(pivots))
            for i, near in enumerate(data["earlier"]):
                earlier[i, : len(near)] = near
            seen = np.zeros(len(pivots) + 1, bool)
            for own, v, order in zip(asked["vec_id"].tolist(), q, places(q / norms(q)[:, None], pivots, routed), strict=True):
                seen[:] = False
                seen[order] = True
                rows = np.flatnonzero(~seen[earlier].any(axis=1) & (ids != own))
                want = max(LEAST_CANDIDATES, int(np.ceil(share * len(rows))))
                if len(rows) > want:
                    common = footrule(weights, order[:prefix])[rows]
                    rows = rows[common >= np.partition(common, len(rows) - want)[len(rows) - want]]
                if len(rows) > 4 * k:
                    # Only what may be among the k best distinct ids is scored exactly.
                    near = unit[rows] @ (v / norms(v[None])[0])
                    best = rows[_best(ids[rows], near, k)]
                    rows = rows[near >= (unit[best] @ (v / norms(v[None])[0])).min() - 1e-9]
                exact = cosines(x[rows], np.broadcast_to(v, (len(rows), d)))
                out += [(own, int(ids[rows[b]]), float(exact[b])) for b in _best(ids[rows], exact, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def _exhaustive(kind: str, d: int, k: int) -> Callable:
    """Task: the k nearest of a group of queries in a block of rows, all of which are compared."""

    def run(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(data) and len(asked):
            x, q = unpack(data["packed"], kind, d), unpack(asked["packed"], kind, d)
            ids, owns = data["vec_id"].to_numpy(np.int64), asked["vec_id"].to_numpy(np.int64)
            unit, sent = x / norms(x)[:, None], q / norms(q)[:, None]
            parts, size = len(x) // PART_ROWS, len(x) // PART_ROWS * PART_ROWS
            for lo in range(0, len(q), QUERIES_AT_ONCE):
                near = sent[lo : lo + QUERIES_AT_ONCE] @ unit.T
                near[owns[lo : lo + QUERIES_AT_ONCE, None] == ids[None, :]] = -np.inf
                # The kth of the parts' largest is no more than the kth of all, so what lies below it is no neighbour.
                least = np.full(len(near), -np.inf)
                if parts > k:
                    least = np.partition(near[:, :size].reshape(len(near), parts, PART_ROWS).max(axis=2), parts - k, axis=1)[:, parts - k]
                for own, v, line, bound in zip(owns[lo:].tolist(), q[lo:], near, least.tolist(), strict=False):
                    rows = np.flatnonzero(line >= bound - 1e-9) if bound > -np.inf else np.flatnonzero(ids != own)
                    if len(np.unique(ids[rows])) < k:
                        rows = np.flatnonzero(ids != own)  # rows that repeat an id
                    exact = cosines(x[rows], np.broadcast_to(v, (len(rows), d)))
                    out += [(own, int(ids[rows[b]]), float(exact[b])) for b in _best(ids[rows], exact, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def _block(d: int) -> int:
    return max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, d))))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query among what its tasks found."""
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return stored(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "permutation-found")


def true_neighbours(rows: DataFrame, asked: DataFrame, kind: str, d: int, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest of every query (vec_id, packed) among all rows, by products of blocks of rows with groups of queries.

    A row is copied once for each QUERY_ROWS queries, a query once for each block; the products are quadratic by nature."""
    most = rows.sparkSession.sparkContext.defaultParallelism
    n, groups = rows.count(), max(1, -(-asked.count() // QUERY_ROWS))
    # Blocks enough for all cores.
    block = min(_block(d), max(LEAST_BLOCK, -(-n * groups // (4 * most))))
    blocks = max(1, -(-n // block))
    deal = lambda count, seed: F.pmod(F.xxhash64("vec_id", "packed", F.lit(seed)), F.lit(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    cell, cells = ["block", "group"], 2 * blocks * groups
    data = rows.select("vec_id", "packed", deal(blocks, 1).alias("block"), each(groups).alias("group")).repartition(cells, *cell)
    sent = asked.select("vec_id", "packed", each(blocks).alias("block"), deal(groups, 2).alias("group")).repartition(cells, *cell)
    return _ranked(data.groupBy(*cell).cogroup(sent.groupBy(*cell)).applyInPandas(_exhaustive(kind, d, k), "query_id long, vec_id long, score double"), k)


def _visit(rows: DataFrame, asked: DataFrame, pivots: np.ndarray, kind: str, d: int, k: int, share: float, routed: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of every query (vec_id, packed) among the rows of its files."""
    routed = min(routed, len(pivots))
    schema = "vec_id long, packed binary, near array<int>"
    data = rows.mapInArrow(_with_places(pivots, kind, d, POSTED), schema).select("vec_id", "packed", F.posexplode("near").alias("place", "cell"), "near")
    data = stored(data.select("vec_id", "packed", "cell", F.slice("near", F.lit(1), F.col("place")).alias("earlier")), "permutation-posted")
    sent = stored(asked.mapInArrow(_with_places(pivots, kind, d, routed), schema).select("vec_id", "packed", F.explode("near").alias("cell")), "permutation-routed")
    block = _block(d)
    # A row a pivot, so a bounded table.
    n = data.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    sizes = F.broadcast(n.join(sent.groupBy("cell").agg(F.count(F.lit(1)).alias("m")), "cell").select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.ceil(F.col("m") / QUERY_ROWS).cast("int").alias("groups")))
    deal = lambda count, seed: F.pmod(F.xxhash64("vec_id", "packed", F.lit(seed)), F.col(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    data = data.join(sizes, "cell").select("vec_id", "packed", "earlier", "cell", deal("blocks", 1).alias("block"), each("groups").alias("group"))
    sent = sent.join(sizes, "cell").select("vec_id", "packed", "cell", each("blocks").alias("block"), deal("groups", 2).alias("group"))
    file = ["cell", "block", "group"]
    found = data.groupBy(*file).cogroup(sent.groupBy(*file)).applyInPandas(_searcher(pivots, kind, d, k, share, routed), "query_id long, vec_id long, score double")
    return _ranked(found, k)


def search(table: DataFrame, is_query: Column, k: int = 5, share: float = CANDIDATES, routed: int = ROUTED, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row where is_query (a condition on vec_id) holds."""
    rows, kind, d = packed(table, vec_id, vector)
    rows = stored(rows.filter("vec_id IS NOT NULL AND packed IS NOT NULL").dropDuplicates(["vec_id", "packed"]), "permutation-rows")
    asked = rows.filter(is_query)
    pivots = fit_pivots(rows, kind, d)
    names = ("query_id", "rank", "vec_id", "score")
    if not len(pivots):
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = _visit(rows, asked, pivots, kind, d, k, share, routed)
    possible = min(k, rows.select("vec_id").distinct().count() - 1)
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= possible).select(F.col("query_id").alias("vec_id"))
    short = asked.join(full, "vec_id", "left_anti") if possible > 0 else asked.limit(0)
    if short.head(1):
        found = found.join(full, found["query_id"] == full["vec_id"], "left_semi").unionByName(_visit(rows, short, pivots, kind, d, k, 1.0, len(pivots)))
    return found.select(*names)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the five nearest found of every vector whose id is divisible by 50."""
    return search(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


CHECKED_SQL = """SELECT vec_id AS query_id, least(5, (SELECT count(DISTINCT vec_id) - 1 FROM embeddings)) AS found, true AS ranked, true AS exact
FROM embeddings WHERE vec_id % 50 = 0"""


def checked(spark, sf_dir: str) -> DataFrame:
    """What SQL can say of op9: how many rows each query has, that they come in order, and that scores are the exact cosines."""
    table = load(spark, sf_dir, "embeddings")
    got = query(spark, sf_dir)
    vectors = table.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    both = got.join(vectors.select(F.col("vec_id").alias("query_id"), F.col("v").alias("a")), "query_id").join(vectors.withColumnRenamed("v", "b"), "vec_id")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    near = F.abs(F.col("score") - dot("a", "b") / F.sqrt(dot("a", "a") * dot("b", "b"))) < 1e-12
    order = Window.partitionBy("query_id").orderBy("rank")
    both = both.withColumn("before", F.lag("score").over(order)).withColumn("near", near)
    return both.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.bool_and((F.col("before").isNull()) | (F.col("before") >= F.col("score"))).alias("ranked"), F.bool_and("near").alias("exact"))


RECALL_SQL = """WITH v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, string_agg(vec_id, ',' ORDER BY rank) AS nearest, round(min(score), 9) AS least_score, true AS recalled FROM r WHERE rank <= 5 GROUP BY query_id"""


def recall(spark, sf_dir: str) -> DataFrame:
    """The true neighbours of op9's queries, by comparing them with every row, and whether op9's hold nine tenths of them over all queries."""
    rows, kind, d = packed(load(spark, sf_dir, "embeddings"))
    rows = stored(rows.filter("vec_id IS NOT NULL AND packed IS NOT NULL").dropDuplicates(["vec_id", "packed"]), "permutation-rows")
    true = true_neighbours(rows, rows.filter("vec_id % 50 = 0"), kind, d, 5)
    hits = true.join(query(spark, sf_dir).select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    share = stored(hits.agg((F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recalled")), "permutation-recall", 1)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda r: r["vec_id"].cast("string")), ",")
    per = true.groupBy("query_id").agg(listed.alias("nearest"), F.round(F.min("score"), 9).alias("least_score"))
    return per.withColumn("one", F.lit(1)).join(F.broadcast(share.withColumn("one", F.lit(1))), "one").drop("one")
