"""Filter interaction audit: how five document filters overlap, whatever their order.

A relational word pipeline.  Texts are dealt by document (doc_id and a hash of the text and its source), so that all that follows stays where it
is: words are exploded, counted by (document, word), and those counts summed by document into total and distinct words.  The other
flags join outside: capitals and symbols, the smallest id that has a text (E; by SHA-256) and the labels.  A document's five failures make a number from 0 to 31;
the documents of each are counted by part, and from a part's 32 conditional counts (of all, of good, of toxic documents) come all
120 orders of the filters without looking at documents again.

Failures: A under MIN_WORDS words; B 100 * distinct words < MIN_DISTINCT * words; C 100 * [A-Z] > MAX_CAPITALS * code points;
D any of SYMBOLS; E equal to the text of a smaller doc_id, wherever that is and whatever becomes of it.

shapley needs no sum over orders: a document that fails k filters is removed by each of them in 120 / k orders.

Contract of ``audit``: a null text is empty, a null source is the part "" (as is an empty one).  Empty texts fail A, not B, C or D.  Rows that
repeat a doc_id count each; equal texts of one doc_id are no copies of each other, and rows with a null doc_id are copies of
nothing.  A document is good or toxic if any of its labels says so; null labels say nothing.  An empty table gives no rows, and
other columns are left out.  Hot sources, copies and repeated rows are summed before they are dealt; no text is cut.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import load, stored

MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2
SYMBOLS = "[#$%&*|]"
FILTERS = "ABCDE"
#: Code points whose words one task counts in memory; more partitions than this aren't made (beyond, counting spills).
PART_CHARS, MOST_PARTS = 1 << 21, 50_000
#: Sums of a part's documents: column of the counts -> condition.
KINDS = {"n": "true", "good": "quality", "bad": "toxic"}


def failures(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, part, n, words, distinct_words, mask, quality, toxic): n equal rows each; bit k of mask is failure of filter k."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text", "part"))
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]", ""))
    document = ["doc_id", "h"]
    flags = rows.select(*document, "part", F.length("text").alias("chars"), F.unhex(F.sha2("text", 256)).alias("digest"), (capitals * 100 > F.length("text") * MAX_CAPITALS).alias("c"), F.col("text").rlike(SYMBOLS).alias("d"))
    flags = stored(flags.groupBy(*flags.columns).agg(F.count(F.lit(1)).alias("n")), "audit-flags")
    chars = flags.agg(F.sum(F.col("chars") * F.col("n"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, chars // PART_CHARS))
    split = rows.select(*document, "text").repartition(parts, *document).select(*document, F.split("text", "[\\x20\\x09-\\x0D]+").alias("words"))
    by_word = split.select(*document, F.explode_outer("words").alias("word")).filter("word <> ''").groupBy(*document, "word").agg(F.count(F.lit(1)).alias("times"))
    totals = by_word.groupBy(*document).agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("distinct_words"))
    first = flags.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "digest", F.lit(True).alias("first"))
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t")).filter("doc_id IS NOT NULL")
    marked = marked.groupBy("doc_id").agg(F.max("q").alias("quality"), F.max("t").alias("toxic"))
    totals = totals.select(F.col("doc_id").alias("d_"), F.col("h").alias("h_"), "times", "distinct_words")
    per = flags.join(totals, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("h") == F.col("h_")), "left").join(first, ["doc_id", "digest"], "left").join(marked, "doc_id", "left")
    per = per.withColumns({"words": F.expr("coalesce(times div n, 0L)"), "distinct_words": F.coalesce("distinct_words", F.lit(0).cast("long"))})
    fails = [F.col("words") < MIN_WORDS, F.col("distinct_words") * 100 < F.col("words") * MIN_DISTINCT, F.col("c"), F.col("d"), F.col("doc_id").isNotNull() & F.col("first").isNull()]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return per.select("doc_id", "part", "n", "words", "distinct_words", mask.alias("mask"), *(F.coalesce(x, F.lit(False)).alias(x) for x in ("quality", "toxic")))


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step."""
    found = failures(docs, labels, text, doc_id, source)
    by_mask = found.groupBy("part", "mask").agg(*(F.sum(F.when(F.expr(of), F.col("n")).otherwise(0)).alias(kind) for kind, of in KINDS.items()))
    masks = range(1 << len(FILTERS))
    counts = by_mask.groupBy("part").agg(*(F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(kind))), F.lit(0)) for m in masks)).alias(kind) for kind in KINDS))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    at = {x: F.instr("filter_order", x) for x in FILTERS}
    own = sum((F.when(at[x] == F.col("step"), 1 << k).otherwise(0) for k, x in enumerate(FILTERS)), F.lit(0))
    earlier = sum((F.when(at[x] < F.col("step"), 1 << k).otherwise(0) for k, x in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumns({"own": own, "earlier": earlier})

    def total(kind: str, condition: str, weight: str = "1") -> F.Column:
        return F.expr(f"aggregate(sequence(0, {len(masks) - 1}), 0L, (a, m) -> a + if({condition}, {kind}[m] * {weight}, 0L))")

    here = "(m & own) > 0 AND (m & earlier) = 0"
    return steps.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        total("n", "(m & (own | earlier)) = 0").alias("kept"),
        total("n", here).alias("removed"),
        total("n", "(m & own) > 0 AND (m & earlier) > 0").alias("redundant"),
        total("n", "m = own").alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("bad", here).alias("toxic_lost"),
        total("n", "(m & own) > 0", "(120 div bit_count(m))").alias("shapley"),
    )


ORACLE_SQL = """WITH t AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
f AS MATERIALIZED (SELECT part, len(w) < 200 AS "A", 100 * len(list_distinct(w)) < 50 * len(w) AS "B", 100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(text) AS "C",
  regexp_matches(text, '[#$%&*|]') AS "D", least < doc_id AS "E", coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad FROM w LEFT JOIN labels USING (doc_id)),
k AS MATERIALIZED (SELECT part, [x for x in ['A', 'B', 'C', 'D', 'E'] if (x = 'A' AND "A") OR (x = 'B' AND "B") OR (x = 'C' AND "C") OR (x = 'D' AND "D") OR (x = 'E' AND "E")] AS failed, good, bad, count(*) AS n FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS MATERIALIZED (SELECT part, filter_order, step, filter_order[step] AS x, string_split(filter_order[:step - 1], '') AS earlier FROM (SELECT DISTINCT part FROM t), o, (SELECT unnest(range(1, 6)) AS step)),
r AS MATERIALIZED (SELECT s.part, s.filter_order, s.step, s.x,
  coalesce(sum(n) FILTER (NOT list_contains(failed, x) AND NOT list_has_any(failed, earlier)), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (list_contains(failed, x) AND NOT list_has_any(failed, earlier)), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (list_contains(failed, x) AND list_has_any(failed, earlier)), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (failed = [x]), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (list_contains(failed, x) AND NOT list_has_any(failed, earlier) AND good), 0)::BIGINT AS good_lost,
  coalesce(sum(n) FILTER (list_contains(failed, x) AND NOT list_has_any(failed, earlier) AND bad), 0)::BIGINT AS toxic_lost
  FROM s JOIN k USING (part) GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley FROM r"""


def query(spark, sf_dir: str) -> DataFrame:
    """op11: every part, order and step."""
    return audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
