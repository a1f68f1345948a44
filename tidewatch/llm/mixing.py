"""Mixing sources to target weights by the cube method.

Every document of a source is to be taken ``m = target / source_size`` times on average, 0 <= m <= 3.
The whole part of m is taken outright; its fraction is an inclusion probability, settled by the cube
method: in a flight, probabilities move through the null space of the balancing constraints
(document count and token total) until at most two per flight stay fractional.  Flights run over groups
of bounded size, groups of a source are dealt by a hash of the document, so a hot source is many groups; what stays
fractional flies again with its source's other remainders, and only a landing problem of at most two documents
a source is rounded, by keeping the token total as near as it can.

Contract of ``mix``: one row per input row.  A null text has size 0; a null source is a source of its
own, last in order.  A source of size 0 has target 0 and takes nothing.  Rows without size
are taken 0 words.  Repeated rows count each; equal rows are units of their own in the flights, dealt like others, and take
what they get in the order of a hash of all their columns.
Results depend on the rows alone, not on their order or partitions, up to equal rows changing places.
An empty table gives an empty result.  Input columns named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import load, numbered, ship, stored

#: Rows of a first flight, about.
GROUP_ROWS = 4_000
#: Remainders of a later flight, about.
FAN_IN = 500
WEIGHTS = (5, 2, 1)
#: Copies by row are sent to every task up to this many rows (some tens of MB); more are joined by a shuffle.
SENT_ROWS = 400_000
MOST_TIMES = 3
_WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of white-space-parted words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _ranked(by: DataFrame) -> DataFrame:
    """by (a row a source) with rank: its place from 0 by code point, null last.  Ranges of sources are ranked each on its own
    and follow one another, so no task sees all."""
    order = F.col("source").asc_nulls_last()
    ranged = stored(by.repartitionByRange(order).withColumn("range", F.spark_partition_id()), "mix-sources")
    n = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    own = F.row_number().over(Window.partitionBy("range").orderBy(order))
    return ranged.withColumn("own", own).join(F.broadcast(n.select("range", before.alias("before"))), "range").withColumn("rank", F.col("own") + F.col("before") - 1).drop("own", "before", "range")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST_TIMES) -> DataFrame:
    """(source, source_size, n_docs, target) from rows (source, size): water-filling under target <= most * source_size.

    The level starts as if no source were at its cap and rises by rounds: what the sources above their cap leave
    goes to the others by weight, until none is above.  A round is one sum over the table of sources.
    """
    by = _ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")))
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    by = stored(by.withColumn("cap", F.col("source_size") * float(most)), "mix-weights")
    filled = by.filter("source_size > 0")
    budget = share * float(by.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > F.col("cap")
        full, open_, n = filled.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.count_if(over)).first()
        if n == capped or not open_:
            break
        level, capped = (budget - full) / open_, n
    target = F.when(F.col("source_size") > 0, F.least(F.col("cap"), F.col("weight") * F.lit(level))).otherwise(0.0)
    return by.select("source", "source_size", "n_docs", target.alias("target"))


_EPS = 1e-9


def flight(p: np.ndarray, balance: np.ndarray) -> np.ndarray:
    """Move p (in 0..1) through the null space of balance (constraints x units) until at most
    len(balance) entries are fractional; sums of balance * p stay.  Linear in the units.

    The direction's two ways are drawn by a fixed rule (the way that settles a unit sooner goes first, turn about),
    so that reruns agree.
    """
    p = p.astype(float).copy()
    k = len(balance)
    live = [int(i) for i in np.flatnonzero((p > _EPS) & (p < 1 - _EPS))]
    hand, rest = live[: k + 1], iter(live[k + 1 :])
    turn = False
    while len(hand) > k:
        a = balance[:, hand]
        if k == 2:  # cross product of the two rows
            v = [a[0, 1] * a[1, 2] - a[0, 2] * a[1, 1], a[0, 2] * a[1, 0] - a[0, 0] * a[1, 2], a[0, 0] * a[1, 1] - a[0, 1] * a[1, 0]]
            if max(map(abs, v)) < 1e-12:  # rows in proportion: any direction that keeps the first
                i = 1 if a[0, 1] or not a[0, 2] else 2
                v = [0.0, 0.0, 0.0]
                v[0], v[i] = (a[0, i], -a[0, 0]) if (a[0, 0] or a[0, i]) else (1.0, 0.0)
        else:
            v = list(np.linalg.svd(a)[2][-1])
        q = [p[i] for i in hand]
        up = min(((1 - x) / d if d > 0 else x / -d) for x, d in zip(q, v, strict=True) if d)
        down = min((x / d if d > 0 else (1 - x) / -d) for x, d in zip(q, v, strict=True) if d)
        turn = not turn
        step = up if (up < down) == turn else -down
        for i, x, d in zip(hand, q, v, strict=True):
            x += step * d
            p[i] = 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x
        stay = [i for i in hand if _EPS < p[i] < 1 - _EPS]
        if len(stay) == len(hand):  # rounding kept all: settle the nearest
            i = min(hand, key=lambda i: min(p[i], 1 - p[i]))
            p[i] = round(p[i])
            stay.remove(i)
        for i in rest:
            stay.append(i)
            if len(stay) > k:
                break
        hand = stay
    return p


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the last few (at most two units): the choice whose tokens, then documents, come nearest."""
    p = p.copy()
    open_ = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    if len(open_) > 12:
        raise ValueError("landing problems are small")
    want_size, want_n = float((p[open_] * size[open_]).sum()), float(p[open_].sum())
    best = min(range(1 << len(open_)), key=lambda b: (abs(sum(size[i] for j, i in enumerate(open_) if b >> j & 1) - want_size), abs(bin(b).count("1") - want_n), b))
    for j, i in enumerate(open_):
        p[i] = float(best >> j & 1)
    return np.round(p)


_FLOWN = "source string, source_null boolean, key binary, copy long, size long, p double, final boolean"


def _flyer(landing: bool):
    return lambda pdf: _fly(pdf, landing)


def _fly(pdf: pd.DataFrame, landing: bool) -> pd.DataFrame:
    # Long documents settle first, so that short ones are left for the landing.
    pdf = pdf.sort_values(["size", "key", "copy"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    size = pdf["size"].to_numpy(np.float64)
    p = flight(pdf["p"].to_numpy(), np.stack([size / max(size.max(), 1.0), np.ones(len(size))]))
    if landing:
        p = land(p, size)
    pdf["p"] = p
    pdf["final"] = (p <= _EPS) | (p >= 1 - _EPS)
    return pdf[["source", "source_null", "key", "copy", "size", "p", "final"]]


def _row_key(doc_id: str, text: str, source: str) -> Column:
    """Equal for rows equal in id, text and source; those are told apart by a running number where it matters."""
    part = lambda c: F.coalesce(F.md5(F.col(c).cast("string").cast("binary")), F.lit("-"))
    return F.unhex(F.md5(F.concat(part(doc_id), part(text), part(source)).cast("binary")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST_TIMES, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every row: what the mix takes."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), size_of(F.col(text)).alias("size"), _row_key(doc_id, text, source).alias("key"))
    rows = stored(rows, "mix-sizes")
    by = targets(rows, weights, share, most)
    # The table of sources goes to every task only if the planner finds it small.
    full = rows.alias("r").join(by.alias("s"), F.expr("r.source <=> s.source"), "left").select("r.*", "s.source_size", "s.n_docs", "s.target")
    m = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    full = full.withColumn("m", F.when(F.abs(m - F.round(m)) < 1e-12, F.round(m)).otherwise(m))
    full = full.withColumn("whole", F.floor("m").cast("long")).withColumn("p", F.col("m") - F.floor("m"))
    full = stored(full.select("doc_id", "source", "size", "source_size", "n_docs", "target", "whole", "p", "key"), "mix-rows")
    # Equal rows: as many units, told apart by a number, so that a text of a million copies is spread like others.
    open_ = full.filter((F.col("p") > _EPS) & (F.col("size") > 0)).groupBy("key").agg(F.first("source").alias("source"), F.first("size").alias("size"), F.first("p").alias("p"), F.first("n_docs").alias("n_docs"), F.count(F.lit(1)).alias("rows"))
    units = open_.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    groups = F.ceil(F.col("n_docs") / F.lit(GROUP_ROWS))
    fly = units.select("source", F.col("source").isNull().alias("source_null"), "key", "copy", "size", "p", F.pmod(F.xxhash64("key", "copy"), groups).alias("group"))
    settled = []
    number = full.agg(F.max(groups)).first()[0] or 1
    while True:
        last = number <= 1
        got = stored(fly.groupBy("source", "source_null", "group").applyInPandas(_flyer(last), _FLOWN), "mix-flight")
        settled.append(got.filter("final").select("key", "p"))
        if last:
            break
        # Remainders of about FAN_IN groups fly together; in the end those of a whole source.
        number = -(-number * 2 // FAN_IN)
        fly = got.filter("NOT final").select("source", "source_null", "key", "copy", "size", "p", F.pmod(F.xxhash64("key", "copy", F.lit(number)), F.lit(number)).alias("group"))
    done = settled[0]
    for more in settled[1:]:
        done = done.unionByName(more)
    taken = done.groupBy("key").agg(F.sum("p").cast("long").alias("units"), F.count(F.lit(1)).alias("rows"))
    plain = taken.filter("rows = 1 OR units = 0 OR units = rows").select("key", (F.col("units") > 0).cast("long").alias("extra"))
    odd = taken.filter("rows > 1 AND units > 0 AND units < rows")
    joined = full.join(plain, "key", "left")
    if odd.head(1):
        spare = numbered(joined.join(odd.select("key"), "key", "left_semi"), "key").join(odd.select("key", "units"), "key").withColumn("extra", (F.col("k_") <= F.col("units")).cast("long")).drop("units", "k_")
        joined = joined.join(odd, "key", "left_anti").unionByName(spare.select(joined.columns))
    copies = F.col("whole") + F.coalesce(F.col("extra"), F.lit(0))
    copies = F.when(F.col("size") > 0, copies).otherwise(0)
    return joined.select("doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), "key")


def mixed(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, columns unchanged."""
    columns = docs.columns
    plan = stored(mix(docs, text=text, source=source, doc_id=doc_id, **options).select("key", "copies"), "mix-plan")
    keyed = docs.withColumn("key_", _row_key(doc_id, text, source))
    once = plan.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("copies"))
    once = stored(once.filter("copies > 0").select(F.col("key").alias("key_"), "rows", "copies"), "mix-copies")
    if once.count() <= SENT_ROWS:
        once = F.broadcast(once)
    got = keyed.join(once, "key_")
    # Rows that share a key share its copies: each takes the whole part, the first ones one more.
    single = got.filter("rows = 1")
    shared = got.filter("rows > 1")
    shared = numbered(shared, "key_").withColumn("copies", F.floor(F.col("copies") / F.col("rows")).cast("long") + (F.col("k_") <= F.col("copies") % F.col("rows")).cast("long")).drop("k_").filter("copies > 0")
    out = single.unionByName(shared)
    return out.withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: sizes, targets and taken words of every document."""
    return mix(load(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "copies")


TARGETS_SQL = f"""WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
by_ AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [{", ".join(map(str, WEIGHTS))}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS INTEGER)]::DOUBLE AS weight FROM sized GROUP BY source),
ordered AS (SELECT *, {MOST_TIMES}.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY {MOST_TIMES}.0::DOUBLE * source_size / weight, source NULLS LAST) AS k, sum(source_size) OVER () AS budget FROM by_ WHERE source_size > 0),
levels AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ordered),
lambda_ AS (SELECT max(level) FILTER (level * weight <= cap) AS l FROM levels),
target AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0 ELSE least({MOST_TIMES}.0::DOUBLE * source_size, coalesce(l * weight, {MOST_TIMES}.0::DOUBLE * source_size)) END AS target FROM by_, lambda_)
SELECT doc_id, size, s.source_size, round(target, 3) AS target, true AS bounded, true AS near FROM sized d JOIN target s ON d.source IS NOT DISTINCT FROM s.source"""


def target_query(spark, sf_dir: str) -> DataFrame:
    """What SQL can say of op5: sizes and targets, that no document is taken over MOST_TIMES, and that each source's words come within
    one document of the source's target."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    got = mix(docs).join(docs.select("doc_id", "source"), "doc_id")
    per = got.groupBy("source").agg((F.abs(F.sum("taken") - F.first("target")) <= F.max("size")).alias("near"))
    out = got.join(per, got["source"].eqNullSafe(per["source"]))
    return out.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), (F.col("taken") <= MOST_TIMES * F.col("size")).alias("bounded"), "near")
