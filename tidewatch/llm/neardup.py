"""MinHash near-duplicates with odd sketches.

Texts with equal shingle sets are one *representative* from the start.  Each representative has
SAMPLES MinHash values; bands of them are bucket keys.  The MinHash sample is also folded into an
odd sketch, a parity bitmap: the population count of two sketches' XOR estimates how many samples differ,
most precisely where the similarity is high, and so judges a bucket's pairs without their sets.  What
passes is confirmed on full shingle sets (64-bit hashes of shingles, from 62-bit ones of words).

1. In each bucket every member is compared with the bucket's most central one, whose buckets are the fullest (linear in
   the bucket).  Confirmed links give first components.
2. Buckets that still hold several components compare members *across* components, by a join whose
   condition is the sketch test and then the exact one, so that only links leave it.  Pairs within a component need no
   look: they are connected already.

Hot buckets (over HOT_ROWS members) are few by their size; their tables of a row a bucket are sent to every task (up to SENT_BUCKETS rows; more
are joined by shuffles whose large partitions Spark splits), so that no hot bucket is dealt to one task.  Results are the same either way.  In step 2 the members of hot buckets are
compared in finer bands (fine_banding): unlike texts that share a passage rarely share one.  A finer bucket over CELL_ROWS members is dealt into groups by hash, and
each two groups are a cell of their own: every pair meets in one cell, and no key holds more than about 2 * CELL_ROWS rows.

No bucket is capped.  Bands follow from the threshold (banding): a pair at 0.85 shares none of 24 bands of 6 rows, a pair at 0.8 none of 29
of 5, with probability 1.3e-5 at most; the finer ones (30 of 7 and 38 of 6), where hot buckets are all they share, are held to the same
MISSED; and the sketch, whose estimate has a standard error of 0.023 there, rejects a pair with probability 5e-5.

Contract of ``link``: a text's words are parted by white space after A-Z are lower-cased; its
set holds distinct runs of SHINGLE words (the whole sequence where there are fewer).  Null and empty texts have
empty sets, link with nothing and are kept.  Rows that repeat a doc_id are one node; rows with a null doc_id
take no part, have a null component and are kept.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import memory
from tidewatch.llm.common import discard, few, load, numbered, sent, ship, stored
from tidewatch.llm.components import components
from tidewatch.llm.textvec import Words, mix, pieces, words_of

SHINGLE = 5
#: MinHash values in all; the bands take the first of them, finer bands and the sketch all.
SAMPLES = 256
SKETCH_BITS = 1024
#: Percent.
THRESHOLD = 80
#: Bands at most, and the largest probability that a pair at the threshold shares none.
MOST_BANDS, MISSED = 29, 1.3e-5
#: Members of a cell's side, about; larger finer buckets are dealt into several.
CELL_ROWS = 512
#: Members of a hot bucket, more than; the tables of hot buckets are sent up to this many rows.
HOT_ROWS, SENT_BUCKETS = 1_000, 400_000
#: Ids of documents in pairs are sent to every task up to this many (some MB); more are joined by a shuffle.
SENT_IDS = 400_000
#: A row with whole sets counts as so many rows of a task.
SET_ROWS = 10
#: A sketch passes a pair if its estimate of the similarity is this much below the threshold at most.
SKETCH_SLACK = 0.09

_MULTIPLIERS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_M32 = (_MULTIPLIERS >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_A32 = _MULTIPLIERS.astype(np.uint32)


def banding(threshold: int = THRESHOLD) -> tuple[int, int]:
    """(bands, rows): the longest rows for which MOST_BANDS bands miss a pair at the threshold with probability MISSED at most."""
    for rows in range(8, 0, -1):
        bands = int(np.ceil(np.log(MISSED) / np.log1p(-((threshold / 100) ** rows)))) if threshold < 100 else 1
        if bands <= MOST_BANDS:
            return bands, rows
    return MOST_BANDS, 1


def fine_banding(threshold: int = THRESHOLD) -> tuple[int, int]:
    """(bands, rows) of hot buckets: the longest rows for which all SAMPLES hold bands enough to miss a pair at the threshold with probability MISSED at most."""
    for rows in range(8, 1, -1):
        bands = int(np.ceil(np.log(MISSED) / np.log1p(-((threshold / 100) ** rows)))) if threshold < 100 else 1
        if bands * rows <= SAMPLES:
            return bands, rows
    return SAMPLES, 1


def _keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """texts x bands: a key for each run of `rows` samples."""
    n = samples.shape[1]
    banded = samples[: bands * rows].reshape(bands, rows, n).astype(np.uint64)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64)[:, None] + np.uint64(rows << 32), (bands, n)).copy()
    for r in range(rows):
        keys = mix(keys * np.uint64(0x100000001B3) + banded[:, r])
    return keys.T


def shingle_hashes(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): distinct shingle hashes of each text, texts one after another, sorted within."""
    h, counts = words.hash, words.counts
    mult = [pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(size)]
    n_sh = np.maximum(counts - size + 1, 0)
    text = np.repeat(np.arange(words.texts), n_sh)
    begin = np.cumsum(n_sh) - n_sh
    at = words.first[:-1][text] + np.arange(len(text)) - begin[text]
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        total += h[at + k] * np.uint64(mult[k])
    few = np.flatnonzero((counts > 0) & (counts < size))
    whole = np.zeros(len(few), np.uint64)
    for j, d in enumerate(few.tolist()):
        part = h[words.first[d] : words.first[d + 1]]
        whole[j] = np.bitwise_xor.reduce(part * np.array(mult[: len(part)], np.uint64)) + np.uint64(len(part))
    text, total = np.concatenate([text, few]), mix(np.concatenate([total, whole]))
    order = np.lexsort((total, text))
    text, total = text[order], total[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (total[1:] != total[:-1])
    text, total = text[fresh], total[fresh]
    return total, np.searchsorted(text, np.arange(words.texts + 1))


def minhashes(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SAMPLES x texts of 32-bit minima; texts with empty sets get the largest value."""
    low, n = sets.astype(np.uint32) ^ (sets >> np.uint64(32)).astype(np.uint32), len(first) - 1
    out = np.full((SAMPLES, n), 0xFFFFFFFF, np.uint32)
    filled = np.flatnonzero(first[1:] > first[:-1])
    if len(filled):
        starts, step = first[filled], np.empty(len(low), np.uint32)
        for k in range(SAMPLES):
            np.multiply(low, _M32[k], out=step)
            step += _A32[k]
            step ^= step >> np.uint32(15)
            step *= np.uint32(0x85EBCA6B)
            out[k, filled] = np.minimum.reduceat(step, starts)
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """texts x SKETCH_BITS/64 words: bit b holds the parity of the number of (k, sample k) that hash to b."""
    k, n = samples.shape
    cell = (mix(samples.astype(np.uint64) | (np.arange(k, dtype=np.uint64) << np.uint64(32))[:, None]) % np.uint64(SKETCH_BITS)).astype(np.int64)
    counts = np.bincount((cell + np.arange(n) * SKETCH_BITS).ravel(), minlength=n * SKETCH_BITS)
    return np.packbits((counts & 1).astype(np.uint8).reshape(n, SKETCH_BITS), axis=1, bitorder="little").view(np.int64)


def sketch_limit(threshold: int = THRESHOLD) -> int:
    """Most differing bits of two sketches that may still belong to a link."""
    differ = 2 * SAMPLES * (1 - threshold / 100 + SKETCH_SLACK)
    return int(SKETCH_BITS / 2 * (1 - np.exp(-2 * differ / SKETCH_BITS))) + 4


def signatures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, digest_a, digest_b, bands, sketch) of each row."""
    ship(docs.sparkSession)
    bands, rows = banding(threshold)

    @memory.task("neardup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            sets, first = shingle_hashes(words_of(part.column("text")), size)
            n = part.num_rows
            samples = minhashes(sets, first)
            filled = first[1:] > first[:-1]
            digest = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
            if filled.any():
                digest[0][filled] = np.add.reduceat(sets, first[:-1][filled])
                digest[1][filled] = np.add.reduceat(mix(sets + np.uint64(77)), first[:-1][filled])
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * bands)
            sketch = odd_sketches(samples)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.diff(first).astype(np.int64)),
                    pa.array(digest[0].view(np.int64)),
                    pa.array(digest[1].view(np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(_keys(samples, bands, rows).ravel().view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * sketch.shape[1]), pa.array(sketch.ravel())),
                ],
                names=["doc_id", "n_shingles", "digest_a", "digest_b", "bands", "sketch"],
            )

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_shingles long, digest_a long, digest_b long, bands array<long>, sketch array<long>")


def _differing_bits(a: str, b: str) -> Column:
    total = F.lit(0)
    for k in range(SKETCH_BITS // 64):
        total = total + F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k]))
    return total


def _sets(docs: DataFrame, text: str, doc_id: str, size: int, threshold: int) -> DataFrame:
    """(doc_id, shingles, fine) of each row."""
    bands, rows = fine_banding(threshold)

    @memory.task("neardup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            sets, first = shingle_hashes(words_of(part.column("text")), size)
            fine = _keys(minhashes(sets, first), bands, rows)
            listed = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), listed(first, sets), listed(np.arange(part.num_rows + 1) * bands, fine.ravel())], names=["doc_id", "shingles", "fine"])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, "doc_id long, shingles array<long>, fine array<long>")


def _sets_of(ids: DataFrame, docs: DataFrame, text: str, doc_id: str, size: int, threshold: int) -> DataFrame:
    """(doc_id, shingles, fine) of the documents with these ids; the sets are made again, of those documents only."""
    ids = sent(stored(ids, "neardup-ids"), SENT_IDS)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(ids, "doc_id", "left_semi")
    return stored(_sets(slim, "text", "doc_id", size, threshold), "neardup-sets")


def _alike(threshold: int) -> Column:
    """Do the full sets sa and sb pass?  100 i >= t (total - i)  <=>  (100 + t) i >= t total."""
    return F.size(F.array_intersect("sa", "sb")) * (100 + threshold) >= F.lit(threshold) * (F.size("sa") + F.size("sb"))


def _confirm(pairs: DataFrame, docs: DataFrame, text: str, doc_id: str, size: int, threshold: int) -> DataFrame:
    """Those of (a, b) whose full sets pass."""
    n = pairs.count()
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = _sets_of(few(ids, n), docs, text, doc_id, size, threshold)
    # A row holds whole sets: fewer a task.
    both = few(sent(pairs).join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a"), SET_ROWS * n)
    both = few(both.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b"), SET_ROWS * n)
    links = stored(both.filter(_alike(threshold)).select("a", "b"), "neardup-links")
    discard(sets)
    return links


class Buckets:
    """Joins on the bucket key that deal no hot bucket to one task."""

    def __init__(self, sizes: DataFrame):
        hot = stored(sizes.filter(F.col("n") > HOT_ROWS).select("band"), "neardup-hot")
        n = hot.count()
        self.any = n > 0
        self._small = (lambda table: F.broadcast(table)) if n <= SENT_BUCKETS else (lambda table: table)
        self.hot = self._small(hot)

    def join(self, rows: DataFrame, table: DataFrame) -> DataFrame:
        """rows (band, ...) with the columns of table, which has one row a bucket."""
        if not self.any:
            return rows.join(table, "band")
        few = stored(table.join(self.hot, "band", "left_semi"), "neardup-hot-table")
        return rows.join(self.hot, "band", "left_anti").join(table, "band").unionByName(rows.join(self._small(few), "band"))


def _fits(threshold: int, limit: int) -> Column:
    """Do set sizes, sketches and full sets of two members (na, ka, sa; nb, kb, sb) pass?"""
    return (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * threshold) & (_differing_bits("ka", "kb") <= limit) & _alike(threshold)


def _side(rows: DataFrame, x: str, *keys: str | Column) -> DataFrame:
    return rows.select(*keys, F.col("doc_id").alias(x), F.col("component").alias(f"c{x}"), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"k{x}"), F.col("shingles").alias(f"s{x}"))


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by keys, in as many partitions as the session's shuffles have.  Spark doesn't split what is dealt like this: keys are bounded
    by HOT_ROWS and CELL_ROWS, and slices of both sides of a join would multiply to tasks by the ten thousand."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _across(inside: DataFrame, threshold: int, limit: int) -> DataFrame:
    """Links (a, b) between members of different components of a bucket (band, doc_id, component, n_shingles, sketch, shingles)."""
    x, y = _dealt(_side(inside, "a", "band"), "band"), _dealt(_side(inside, "b", "band"), "band")
    return x.join(y, (x["band"] == y["band"]) & (F.col("ca") < F.col("cb")) & _fits(threshold, limit)).select("a", "b")


def _cells(inside: DataFrame, threshold: int, limit: int) -> DataFrame:
    """The same of buckets that are dealt into `groups` groups by hash: each pair of groups meets under a key of its own."""
    dealt = inside.withColumn("g", F.pmod(F.xxhash64("doc_id", F.lit(11)), "groups").cast("int"))
    x = _side(dealt, "a", "band", F.col("g").alias("i"), F.explode(F.sequence("g", F.col("groups") - 1)).alias("j"))
    y = _side(dealt, "b", F.col("band").alias("band_"), F.explode(F.sequence(F.lit(0), F.col("g"))).alias("i_"), F.col("g").alias("j_"))
    x, y = _dealt(x, "band", "i", "j"), _dealt(y, "band_", "i_", "j_")
    apart = (F.col("ca") < F.col("cb")) | ((F.col("i") < F.col("j")) & (F.col("ca") > F.col("cb")))
    return x.join(y, (F.col("band") == F.col("band_")) & (F.col("i") == F.col("i_")) & (F.col("j") == F.col("j_")) & apart & _fits(threshold, limit)).select("a", "b")


def _mixed(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The keys' buckets of n rows that hold several components; written, so that the join with them is one whose large partitions Spark can split."""
    return stored(few(rows.groupBy(*keys).agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select(*keys), n), "neardup-mixed")


def link(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, copies) of every row of docs."""
    rows = stored(signatures(docs, text, doc_id, size, threshold), "neardup-signatures")
    total = rows.count()
    full = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["n_shingles", "digest_a", "digest_b"]
    # Equal sets: the smallest id stands for all.
    reps = full.groupBy(*same).agg(F.min(F.struct("doc_id", "bands", "sketch")).alias("x"), F.count(F.lit(1)).alias("copies")).select(*same, "copies", "x.doc_id", "x.bands", "x.sketch")
    reps = stored(few(reps, total), "neardup-representatives")
    posted = reps.select("doc_id", F.explode("bands").alias("band"))
    sizes = stored(few(posted.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), total), "neardup-sizes")
    buckets = Buckets(sizes)
    posted = stored(buckets.join(posted, sent(sizes, SENT_BUCKETS)), "neardup-buckets")
    n_posted = posted.count()
    # The most central member leads: its buckets are the fullest, so that most near copies of one text link with it.
    weight = sent(stored(few(posted.groupBy("doc_id").agg(F.sum("n").alias("weight")), n_posted), "neardup-weight"), SENT_IDS)
    leaders = posted.join(weight, "doc_id").groupBy("band").agg(F.max(F.struct(F.col("weight"), -F.col("doc_id"))).alias("top")).select("band", (-F.col("top.col2")).alias("leader"))
    leaders = stored(few(leaders, n_posted), "neardup-leaders")
    posted = posted.select("band", "doc_id")
    slim = reps.select("doc_id", "n_shingles", "sketch")
    limit = sketch_limit(threshold)

    def near(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose set sizes and sketches allow a link."""
        n = pairs.count()
        near = few(sent(pairs).join(slim.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("ka")), "a"), n)
        near = few(near.join(slim.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("kb")), "b"), n)
        return near.filter((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * threshold) & (_differing_bits("ka", "kb") <= limit)).select("a", "b")

    led = buckets.join(posted, sent(leaders, SENT_BUCKETS)).filter("doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    led = stored(few(led, n_posted), "neardup-led")
    stars = stored(near(led), "neardup-stars")
    discard(leaders, led)
    links = _confirm(stars, docs, text, doc_id, size, threshold)
    first = sent(components(links, "a", "b", links.count()), SENT_IDS)

    # Buckets of several components: members across components.
    placed = posted.join(first, posted["doc_id"] == first["node"], "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    placed = stored(few(placed, n_posted), "neardup-placed")
    mixed = sent(_mixed(placed, ["band"], n_posted), SENT_BUCKETS)
    inside = stored(few(few(buckets.join(placed, mixed), n_posted).join(slim, "doc_id"), n_posted), "neardup-across")
    if inside.head(1):
        n_inside = inside.count()
        sets = _sets_of(few(inside.select("doc_id").distinct(), n_inside), docs, text, doc_id, size, threshold)
        crossing = []
        if buckets.any:
            # A member of several hot buckets is posted once in its finer bands.
            hot = inside.join(buckets.hot, "band", "left_semi").select("doc_id", "component").distinct().join(slim, "doc_id").join(sets, "doc_id")
            fine = stored(hot.select("doc_id", "component", F.explode("fine").alias("band")), "neardup-fine")
            per = fine.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("groups"))
            fine = stored(fine.join(stored(per.filter("low <> high").select("band", "groups"), "neardup-mixed-fine"), "band").select("band", "doc_id", "groups"), "neardup-fine-mixed")
            members = lambda which: fine.filter(which).join(hot.drop("fine"), "doc_id")
            crossing += [_across(members("groups = 1"), threshold, limit), _cells(members("groups > 1"), threshold, limit)]
            inside = inside.join(buckets.hot, "band", "left_anti")
        crossing.append(_across(few(inside.join(sets.drop("fine"), "doc_id"), SET_ROWS * n_inside), threshold, limit))
        # Each is written by itself, before it is made distinct in few tasks.
        for part in crossing:
            links = links.unionByName(stored(part, "neardup-crossing"))
    # A doc_id on several rows with different sets is one node.
    again = stored(few(full.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), total), "neardup-repeated")
    if again.head(1):
        member = full.join(sent(again, SENT_IDS), "doc_id", "left_semi").join(reps.select(*same, F.col("doc_id").alias("rep")), same).select("doc_id", "rep")
        several = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a <> z").select("doc_id", "a")
        links = links.unionByName(stored(member.join(several, "doc_id").filter("rep <> a").select("a", F.col("rep").alias("b")), "neardup-joined"))
    final = sent(components(links, "a", "b", links.count()), SENT_IDS)
    of = reps.join(final, reps["doc_id"] == final["node"], "left").select(*same, F.coalesce("component", "doc_id").alias("found"), "copies")
    # A null doc_id or an empty set is a component of its own.
    out = few(rows.select("doc_id", *same).join(of, same, "left"), total)
    component = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("found"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), F.coalesce("copies", F.lit(1)).alias("copies"))


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One row of each group of near-duplicates, columns unchanged: the row whose id is the group's smallest."""
    found = stored(link(docs, text, doc_id, **options).select("doc_id", "kept"), "neardup-kept")
    n = found.count()
    away = stored(few(found.filter("NOT kept").select("doc_id").distinct(), n), "neardup-away")
    again = stored(few(found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), n), "neardup-again")
    small = lambda ids: F.broadcast(ids) if ids.count() <= SENT_IDS else ids
    on = lambda ids: docs[doc_id].cast("long") == ids["doc_id"]
    rest = docs.join(small(away), on(away), "left_anti")
    if not again.head(1):
        return rest
    # Rows that repeat an id: one of them stays, the first by text if their texts differ.
    twice = rest.join(small(again), rest[doc_id].cast("long") == again["doc_id"], "left_semi")
    hashed = twice.withColumn("h_", F.xxhash64(F.col(text)))
    least = hashed.groupBy(F.col(doc_id).alias("id_")).agg(F.min(F.coalesce("h_", F.lit(0))).alias("least_"))
    hashed = hashed.join(least, F.col(doc_id) == F.col("id_")).filter(F.coalesce("h_", F.lit(0)) == F.col("least_")).drop("h_", "id_", "least_")
    first = numbered(hashed, doc_id).filter("k_ = 1").drop("k_").select(docs.columns)
    return rest.join(small(again), rest[doc_id].cast("long") == again["doc_id"], "left_anti").unionByName(first)


#: The contract's threshold of op2, in percent.
ASKED = 85

ORACLE_SQL = f"""WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= {ASKED} * (p.n + q.n - c)),
near AS (SELECT doc_id, doc_id AS other FROM t UNION SELECT near.doc_id, l.b FROM near JOIN links l ON l.a = near.other),
own AS (SELECT doc_id, min(other) AS component_id FROM near GROUP BY ALL)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept FROM t JOIN own USING (doc_id) LEFT JOIN n USING (doc_id)"""


def query(spark, sf_dir: str) -> DataFrame:
    """op2: component of every document."""
    return link(load(spark, sf_dir, "documents").select("doc_id", "text"), threshold=ASKED).drop("copies")
