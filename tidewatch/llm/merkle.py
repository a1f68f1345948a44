"""Document fingerprints: a Merkle tree over paragraphs and sections, in built-in functions only.

A text is parted without loss.  Its lines are the *paragraphs*, each with its line break; a paragraph's *pieces* end with a
sentence or after PIECE code points.  A piece's digest is SHA-256 of its bytes, a paragraph's that of its pieces' digests.  A
*section* ends with a paragraph whose digest says so (one in four), so that an edit moves no section but its own; its digest is
that of its paragraphs' digests, and the root that of the sections'.

A fingerprint is written ``root;section:paragraph,piece,piece...;...``: 64 digits of the root, then for each section 16, for each
of its paragraphs 16 and for each piece 8 digits.  Equal roots say equal texts.  Otherwise ``changed_paragraphs`` goes down into those
sections only whose digests the other tree lacks.  ``likeness`` is 2 * common / (sum of both) of the distinct pieces of two fingerprints, 1 where the roots are equal.

``with_next`` gives every row the text of the next one in descending id without a window over the whole table: ids are cut into ranges
(cuts from a sample of SAMPLED ids a range; an id that fills several ranges is parted by the text's hash), each range is ordered by itself,
and the first row of the range below joins it as a guest.  The ends of the ranges (one row each, MOST_RANGES at most) are all that is sent.

Contract of ``compare``: null texts are empty, their tree has no sections.  Rows that repeat a doc_id are ordered by the text's hash;
rows without doc_id come last.  A single row is its own next.  An empty table gives no rows; other columns are left out.
Very long texts are whole: only their pieces are short.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import load

#: Code points of a piece, at most; one paragraph in SECTION ends a section.
PIECE, SECTION = 64, 4
#: Rows of a range of ids and number of ranges, at most; sampled ids a range.
RANGE_ROWS, MOST_RANGES, SAMPLED = 64, 16_384, 16

_END = r".!?\x{3002}\x{FF01}\x{FF1F}"
_PIECES = rf"[^\n{_END}]{{1,{PIECE}}}(?:[\n{_END}]+[ \t\r]*)?|[\n{_END}]+[ \t\r]*"
_PARAGRAPHS = r"[^\n]*\n|[^\n]+"
#: First digits of a paragraph that ends its section.
_LAST = [f"{x:x}" for x in range(0, 16, SECTION)]
_REST = 1 << 30


def _sha(x: Column) -> Column:
    return F.sha2(x, 256)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), value computed once."""
    return F.transform(F.array(value), f)[0]


def fingerprint(text: Column | str) -> Column:
    """The written tree of a text (null is empty)."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    digests = F.transform(F.regexp_extract_all(text, F.lit(_PARAGRAPHS), F.lit(0)), lambda line: F.transform(F.regexp_extract_all(line, F.lit(_PIECES), F.lit(0)), _sha))
    paragraphs = F.transform(digests, lambda p: F.array_join(F.concat(F.array(_sha(F.array_join(p, ""))), F.transform(p, lambda x: F.left(x, F.lit(8)))), ","))
    # A list of lists without a loop: a mark to split at follows the paragraph that ends a section.
    marked = F.array_join(F.transform(paragraphs, lambda p: F.concat(p, F.when(F.left(p, F.lit(1)).isin(_LAST), F.lit(";")).otherwise(F.lit(":")))), "")
    listed = F.transform(F.filter(F.split(marked, ";"), lambda s: s != ""), lambda s: F.filter(F.split(s, ":"), lambda p: p != ""))

    def section(own: Column) -> Column:
        short = F.transform(own, lambda p: F.concat(F.left(p, F.lit(16)), F.substring(p, 65, _REST)))
        return F.concat_ws(":", _sha(F.array_join(F.transform(own, lambda p: F.left(p, F.lit(64))), "")), F.array_join(short, ":"))

    def tree(found: Column) -> Column:
        root = _sha(F.array_join(F.transform(found, lambda s: F.left(s, F.lit(64))), ""))
        return F.array_join(F.concat(F.array(root), F.transform(found, lambda s: F.concat(F.left(s, F.lit(16)), F.substring(s, 65, _REST)))), ";")

    return _let(F.transform(listed, section), tree)


def root(tree: Column | str) -> Column:
    return F.left(F.col(tree) if isinstance(tree, str) else tree, F.lit(64))


def _below(written: Column | str, mark: str) -> Column:
    """What follows a node's own digest."""
    return F.slice(F.split(written, mark), 2, _REST)


def sections(tree: Column | str) -> Column:
    """The written sections of a tree, in order."""
    return _below(tree, ";")


def paragraphs(tree: Column | str) -> Column:
    """The written paragraphs of a tree, in order."""
    return F.flatten(F.transform(sections(tree), lambda s: _below(s, ":")))


def pieces(tree: Column | str) -> Column:
    """The distinct piece digests of a tree."""
    return F.array_distinct(F.flatten(F.transform(paragraphs(tree), lambda p: _below(p, ","))))


def likeness(a: str, b: str) -> Column:
    """Of two columns of fingerprints, 0 to 1."""

    def share(s: Column) -> Column:
        both = F.size(s["x"]) + F.size(s["y"])
        return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(s["x"], s["y"])) * F.lit(2.0) / both)

    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(_let(F.struct(pieces(a).alias("x"), pieces(b).alias("y")), share))


def changed_paragraphs(a: str, b: str) -> Column:
    """Of columns of fingerprints: numbers (from 0) of those paragraphs of b that a's differing sections lack; none where the roots are equal."""

    def found(s: Column) -> Column:
        of = lambda x: F.transform(_below(x, ":"), lambda p: ~F.array_contains(s["known"], x) & ~F.array_contains(s["left"], p))
        marks = F.flatten(F.transform(s["own"], of))
        return F.filter(F.transform(marks, lambda m, k: F.when(m, k)), lambda k: k.isNotNull())

    left = F.flatten(F.transform(F.array_except(sections(a), sections(b)), lambda x: _below(x, ":")))
    below = _let(F.struct(sections(a).alias("known"), sections(b).alias("own"), left.alias("left")), found)
    return F.when(root(a) == root(b), F.array().cast("array<int>")).otherwise(below)


def _ranged(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text) with their range, which falls with the id, and their order (last, turned, h) in it."""
    rows = rows.withColumns({"last": F.col("doc_id").isNull(), "turned": F.coalesce(F.bitwise_not("doc_id"), F.lit(0)), "h": F.xxhash64("text")})
    n = rows.count()
    ranges = min(MOST_RANGES, n // RANGE_ROWS)
    if ranges < 2:
        return rows.withColumn("range", F.lit(0).cast("long"))
    sample = [r[0] for r in rows.sample(min(1.0, SAMPLED * ranges / n), seed=7).select("doc_id").collect()]
    ids = sorted((x for x in sample if x is not None), reverse=True)
    times = Counter(ids[k] for k in range(0, len(ids), SAMPLED))
    cuts = F.split(F.lit(",".join(map(str, sorted(times, reverse=True)))), ",").cast("array<bigint>")
    parts = F.split(F.lit(",".join(str(times[x]) for x in sorted(times, reverse=True))), ",").cast("array<bigint>")
    if not times:
        cuts, parts = F.array().cast("array<bigint>"), F.array().cast("array<bigint>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(times).bit_length()))), F.lit(0))
    above = F.aggregate(steps, F.lit(0), lambda at, step: F.when((step > 0) & (at + step <= len(times)) & (F.get(cuts, at + step - 1) > F.col("doc_id")), at + step).otherwise(at))
    rows = rows.withColumn("above", F.when(F.col("last"), len(times)).otherwise(above))
    # An id of several cuts, like the rows without one, is parted by hash.
    several = F.when(F.col("last"), 1 + (len(sample) - len(ids)) // SAMPLED).when(F.get(cuts, F.col("above")) == F.col("doc_id"), F.get(parts, F.col("above"))).otherwise(1)
    part = F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * several)
    # Ids below the last cut come before rows without id.
    return rows.withColumn("range", (F.col("above") * 2 + F.col("last").cast("int")).cast("long") * (1 << 32) + F.least(part, several - 1)).drop("above")


def with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text, tree, next_text, next_tree) of every row: the next is that of descending id, the first after the last."""
    spark = docs.sparkSession
    rows = _ranged(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    key = ["last", "turned", "h"]
    begins = sorted((r["range"], *r["first"]) for r in rows.groupBy("range").agg(F.min(F.struct(*key)).alias("first")).collect())  # MOST_RANGES and as many parts
    guests = [(begins[k - 1][0], *begins[k][1:]) for k in range(len(begins))]
    sent = F.broadcast(spark.createDataFrame(guests, "range long, last boolean, turned long, h long"))
    first = rows.drop("range").join(sent, key).select("doc_id", "text", *key, "range", F.lit(True).alias("guest"))
    every = rows.select("doc_id", "text", *key, "range", F.lit(False).alias("guest")).unionByName(first).withColumn("tree", fingerprint("text"))
    order = Window.partitionBy("range").orderBy("guest", *key, "text")
    return every.withColumns({"next_text": F.lead("text").over(order), "next_tree": F.lead("tree").over(order)}).filter("NOT guest").select("doc_id", "text", "tree", "next_text", "next_tree")


def compare(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of every row, of its edited text, and what they have in common with it and with the next row's."""
    rows = with_next(docs, text, doc_id).withColumn("n_chars", F.length("text").cast("long"))
    third = F.expr("int(n_chars div 3)")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - third), F.left("next_text", third))
    rows = rows.select("doc_id", "n_chars", F.col("tree").alias("fingerprint"), "next_tree", edited.alias("edited")).withColumn("edited_fingerprint", fingerprint("edited"))
    return rows.select(
        "doc_id",
        "n_chars",
        _sha(F.col("edited")).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_tree").alias("near_next"),
        F.size(paragraphs("edited_fingerprint")).cast("long").alias("edited_paragraphs"),
        F.array_min(changed_paragraphs("fingerprint", "edited_fingerprint")).cast("long").alias("first_changed"),
    )


ORACLE_SQL = f"""WITH t AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next FROM t),
x AS MATERIALIZED (SELECT doc_id, text, left(text, n - n // 3) || left(next, n // 3) AS edited, next FROM n),
y AS (SELECT doc_id, 1 AS k, text FROM x UNION ALL SELECT doc_id, 2, edited FROM x UNION ALL SELECT doc_id, 3, next FROM x),
p AS (SELECT doc_id, k, [[sha256(c) for c in regexp_extract_all(line, '{_PIECES}')] for line in regexp_extract_all(text, '{_PARAGRAPHS}')] AS ps FROM y),
q AS (SELECT doc_id, k, [{{'d': sha256(array_to_string(c, '')), 'c': [left(h, 8) for h in c]}} for c in ps] AS ps FROM p),
r AS (SELECT doc_id, k, i, ps[i] AS p, coalesce(sum(CASE WHEN left(ps[i].d, 1) IN ('0', '4', '8', 'c') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM q)),
s AS (SELECT doc_id, k, s, sha256(string_agg(p.d, '' ORDER BY i)) AS d, string_agg(left(p.d, 16) || ',' || array_to_string(p.c, ','), ':' ORDER BY i) AS body, list_distinct(flatten(list(p.c))) AS c, count(*) AS n FROM r GROUP BY ALL),
f AS (SELECT doc_id, k, sha256(string_agg(d, '' ORDER BY s)) || ';' || string_agg(left(d, 16) || ':' || body, ';' ORDER BY s) AS tree, list_distinct(flatten(list(c))) AS c, sum(n) AS n, list(left(d, 16) || ':' || body) AS secs FROM s GROUP BY ALL),
g AS (SELECT doc_id, k, coalesce(tree, sha256('')) AS tree, coalesce(c, []) AS c, coalesce(n, 0) AS n, coalesce(secs, []) AS secs FROM y LEFT JOIN f USING (doc_id, k)),
w AS (SELECT doc_id, r.k, min(r.i) - 1 AS at FROM (SELECT doc_id, k, i, s, left(p.d, 16) || ',' || array_to_string(p.c, ',') AS p FROM r WHERE k = 2) r JOIN (SELECT doc_id, s, left(d, 16) || ':' || body AS sec FROM s WHERE k = 2) USING (doc_id, s) JOIN g USING (doc_id)
  LEFT JOIN g h ON h.doc_id = r.doc_id AND h.k = 2 WHERE g.k = 1 AND NOT list_contains(g.secs, sec) AND NOT list_contains(flatten([string_split(x, ':')[2:] for x in g.secs if NOT list_contains(h.secs, x)]), p) GROUP BY ALL)
SELECT x.doc_id, length(x.text) AS n_chars, sha256(x.edited) AS edited_sha256, a.tree AS fingerprint, b.tree AS edited_fingerprint,
  CASE WHEN a.tree = b.tree THEN 1.0 WHEN len(a.c) + len(b.c) = 0 THEN 0.0 ELSE len(list_intersect(a.c, b.c)) * 2.0::DOUBLE / (len(a.c) + len(b.c)) END AS near_edited,
  CASE WHEN a.tree = c.tree THEN 1.0 WHEN len(a.c) + len(c.c) = 0 THEN 0.0 ELSE len(list_intersect(a.c, c.c)) * 2.0::DOUBLE / (len(a.c) + len(c.c)) END AS near_next,
  b.n::BIGINT AS edited_paragraphs, w.at::BIGINT AS first_changed
FROM x JOIN g a ON a.doc_id = x.doc_id AND a.k = 1 JOIN g b ON b.doc_id = x.doc_id AND b.k = 2 JOIN g c ON c.doc_id = x.doc_id AND c.k = 3 LEFT JOIN w ON w.doc_id = x.doc_id"""


def query(spark, sf_dir: str) -> DataFrame:
    """op13: fingerprints of every document."""
    return compare(load(spark, sf_dir, "documents"))
