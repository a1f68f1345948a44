"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors are scaled to length 1, equal vectors become one, and all are rotated onto principal axes.  Along the first axis they are cut into
tiles of bounded size (TILE_BYTES, or tile_rows); two tiles are compared only if their ranges on that axis come within the distance that the
threshold allows.  The table of tiles has a row for some thousand vectors; pairs of tiles come out of it on the executors.  A comparison adds up the leading axes first: leading product + product of the two
suffix norms bounds the cosine, and a pair is dropped once that bound stays below the threshold.  What is left gets the
exact cosine in double precision.

A tile pair returns each vector's number of links and a spanning forest of its links, at most a row a vector each, so
large groups of near copies never become rows of all their pairs.  Forests are joined by distributed components.
The axes come from a bounded sample (SAMPLE rows); they only order the work and don't touch results.

Contract of ``near_duplicates``: one row per input row.  Vectors null, zero, non-finite or of another length than the
commonest link with nothing (n_links 0, a component of their own), as do rows without id (null component, kept).
Rows that repeat an id are one node with the links of each; the row's own copies count as other vectors.  An empty table
gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import load, stored
from tidewatch.llm.components import components
from tidewatch.llm.vectors import cosines, norms, packed, unpack

THRESHOLD = 0.95
#: Rows of a tile: a TILES-th of all, at least LEAST_ROWS; a tile's vectors, as doubles, take TILE_BYTES at most (a task holds two tiles and some
#: copies of theirs), so tiles aim at half of it.
LEAST_ROWS, TILES, TILE_BYTES = 512, 24, 32 << 20
#: Products that are tested at once.
STRIP_CELLS = 1 << 22
SAMPLE = 20_000
#: Axes added up before each test of the bound.
STEPS = (16, 32)
_SLACK = 1e-4  # of the single-precision bound
_PAIRS_AT_ONCE = 100_000


def principal_axes(rows: DataFrame, kind: str, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(axes by falling variance, as columns; the sample's sorted places on the first)."""
    sample = rows.select("vec_id", "packed").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    if not len(sample):
        return np.eye(d), np.zeros(0)
    x = unpack(sample["packed"], kind, d)
    x /= norms(x)[:, None]
    value, axes = np.linalg.eigh(np.cov(x.T)) if len(x) > 1 else (np.ones(d), np.eye(d))
    axes = np.ascontiguousarray(axes[:, ::-1])
    return axes, np.sort(x @ axes[:, 0])


def links_between(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of a, rows of b) of all pairs with cosine >= threshold, in portions."""
    ua, ub = (x / norms(x)[:, None] @ axes for x in (a, b))
    fa, fb = ua.astype(np.float32), ub.astype(np.float32)
    tail = {s: (np.sqrt(np.maximum(0, 1 - (fa[:, :s] ** 2).sum(1))), np.sqrt(np.maximum(0, 1 - (fb[:, :s] ** 2).sum(1)))) for s in STEPS}
    first = min(STEPS[0], a.shape[1])
    height = max(16, STRIP_CELLS // max(1, len(b)))
    for at in range(0, len(a), height):
        strip = slice(at, at + height)
        bound = fa[strip, :first] @ fb[:, :first].T
        bound += tail[STEPS[0]][0][strip, None] * tail[STEPS[0]][1]
        rows, cols = np.nonzero(bound >= threshold - _SLACK)
        if len(rows) > 0.05 * bound.size:
            # Much is alike here: one product in double precision, only what is on the edge is done again.
            full = ua[strip] @ ub.T
            rows, cols = np.nonzero(full >= threshold - 1e-9)
            sure = full[rows, cols] >= threshold + 1e-9
            rows += at
            yield rows[sure], cols[sure]
            rows, cols = rows[~sure], cols[~sure]
        else:
            rows += at
        for k in range(0, len(rows), _PAIRS_AT_ONCE):
            i, j = rows[k : k + _PAIRS_AT_ONCE], cols[k : k + _PAIRS_AT_ONCE]
            for s in STEPS[1:]:
                stay = (fa[i, :s] * fb[j, :s]).sum(1) + tail[s][0][i] * tail[s][1][j] >= threshold - _SLACK
                i, j = i[stay], j[stay]
            stay = cosines(a[i], b[j]) >= threshold
            yield i[stay], j[stay]


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give the ends of all links equal labels, the smallest node of each group."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(jump := label[label], label):
            label[:] = jump


def _compare(axes: np.ndarray, kind: str, d: int, threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        ids, copies = pdf["vec_id"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64)
        x = unpack(pdf["packed"], kind, d)
        side = pdf["side"].to_numpy()
        left = np.flatnonzero(side == 0)
        same = bool(pdf["same"].iloc[0])
        right = left if same else np.flatnonzero(side == 1)
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i, j in links_between(x[left], x[right], axes, threshold):
            i, j = left[i], right[j]
            if same:
                i, j = i[i < j], j[i < j]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            _join(label, i, j)
        out = np.flatnonzero((links > 0) | (label != np.arange(len(ids))))
        return pd.DataFrame({"vec_id": ids[out], "links": links[out], "other": ids[label[out]]})

    return run


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", vector: str = "embedding", tile_rows: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of table."""
    spark = table.sparkSession
    rows, kind, d = packed(table, vec_id, vector)
    rows = stored(rows, "tiles-rows")
    full = rows.filter("vec_id IS NOT NULL AND packed IS NOT NULL")
    alone = stored(full.groupBy("packed").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")), "tiles-distinct")
    n = alone.count()
    tile_rows = tile_rows or min(max(1, TILE_BYTES // (16 * max(1, d))), max(LEAST_ROWS, n // TILES))
    axes, along = principal_axes(alone, kind, d)
    slabs = max(1, -(-n // tile_rows))
    cuts = along[[len(along) * k // slabs for k in range(1, slabs)]] if len(along) else np.zeros(0)
    axis = axes[:, 0].copy() if d else np.zeros(0)

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            x = unpack(batch.column("packed").to_pylist(), kind, d)
            at = (x / norms(x)[:, None]) @ axis
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(np.searchsorted(cuts, at, "right").astype(np.int32))], names=[*batch.schema.names, "along", "slab"])

    placed = stored(alone.mapInArrow(place, "packed binary, vec_id long, copies long, along double, slab int"), "tiles-placed")
    # A slab that came out too large (vectors alike on the axis) is dealt into several tiles by hash.
    ends = placed.groupBy("slab").agg(F.count(F.lit(1)).alias("n"), F.min("along").alias("low"), F.max("along").alias("high")).toPandas().sort_values("slab")
    parts = np.maximum(1, -(-ends["n"].to_numpy(np.int64) // (2 * tile_rows)))
    tiles = ends.loc[ends.index.repeat(parts), ["slab", "low", "high"]].reset_index(drop=True)
    tiles["part"] = tiles.groupby("slab").cumcount()
    # A tile's partners follow it up to the last that begins within reach of its end: an interval, not a list.
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    tiles["last"] = np.searchsorted(tiles["low"].to_numpy(float), tiles["high"].to_numpy(float) + reach, "right") - 1
    tiles["tile"] = np.arange(len(tiles))
    table_of = [(int(r.tile), int(r.slab), int(r.part), int(r.last)) for r in tiles.itertuples()]
    tile_table = spark.createDataFrame(table_of, "tile long, slab int, part int, last long")
    split = spark.createDataFrame([(int(k), int(p)) for k, p in zip(ends["slab"], parts, strict=True)], "slab int, parts int")
    dealt = placed.join(split, "slab").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).join(tile_table, ["slab", "part"]).select("tile", "last", "vec_id", "copies", "packed")
    pairs = stored(tile_table.select(F.col("tile").alias("a"), F.explode(F.sequence("tile", "last")).alias("b")), "tiles-pairs")
    sides = pairs.select("a", "b", F.col("a").alias("tile"), F.lit(0).alias("side")).unionByName(pairs.filter("a <> b").select("a", "b", F.col("b").alias("tile"), F.lit(1).alias("side")))
    sent = dealt.drop("last").join(sides, "tile").select("a", "b", (F.col("a") == F.col("b")).alias("same"), "side", "vec_id", "copies", "packed")
    links = stored(sent.groupBy("a", "b").applyInPandas(_compare(axes, kind, d, threshold), "vec_id long, links long, other long"), "tiles-links")
    count = links.groupBy("vec_id").agg(F.sum("links").alias("links"))
    # Rows that repeat an id with different vectors tie those vectors together.
    member = full.join(alone.select("packed", F.col("vec_id").alias("rep"), "copies"), "packed").select("vec_id", "rep", "copies")
    several = member.groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a <> z").select("vec_id", "a")
    edges = links.select(F.col("vec_id").alias("u"), F.col("other").alias("v")).unionByName(member.join(several, "vec_id").filter("rep <> a").select(F.col("a").alias("u"), F.col("rep").alias("v")))
    group = components(edges)
    per = alone.join(count, "vec_id", "left").join(group.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    per = per.select("packed", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component"))
    out = rows.join(per, "packed", "left")
    named = F.col("vec_id").isNotNull()
    component = F.when(named, F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.when(named, F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


ORACLE_SQL = """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
usual AS (SELECT len(e) AS d FROM v WHERE e IS NOT NULL GROUP BY len(e) ORDER BY count(*) DESC, len(e) DESC LIMIT 1),
good AS MATERIALIZED (SELECT vec_id, e FROM v, usual WHERE len(e) = d AND vec_id IS NOT NULL AND list_bool_and(list_transform(e, lambda x: coalesce(isfinite(x), false))) AND list_dot_product(e, e) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a, good b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
near AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT n.vec_id, l.b FROM near n JOIN links l ON l.a = n.other),
own AS (SELECT vec_id, min(other) AS component_id FROM near GROUP BY ALL),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY ALL)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, component_id = vec_id AS kept FROM v JOIN own USING (vec_id) LEFT JOIN n ON n.a = v.vec_id"""


def query(spark, sf_dir: str) -> DataFrame:
    """op10: links and component of every vector."""
    return near_duplicates(load(spark, sf_dir, "embeddings"))
