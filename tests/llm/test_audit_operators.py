"""Filter audit, hard negatives and fingerprints against brute force, on odd rows."""

import hashlib
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import filteraudit, hardnegatives, merkle

WORDS = re.compile("[^\x20\x09-\x0d]+")


def odd_documents(spark):
    long = "alpha beta " * 150
    rows = [
        (1, None, None, "x"), (2, "", "", "x"), (3, " \t\n", "b", "x"), (4, long, "b", "x"), (5, long, None, "x"), (6, "A # Bc", "b", "y"), (7, " ".join(f"w{k}" for k in range(250)), "b", "z"),
        (8, " ".join(f"w{k}" for k in range(250)) + " $", "c", "z"), (9, "Ünïcode　空 " * 300, "c", "z"), (6, "A # Bc", "b", "y"), (6, "other " * 210, "b", "y"), (None, long, "b", "x"), (None, None, "c", "x"), (10, "X" * 5000 + "\v y", "b", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, part string")


def plain_audit(rows, labels):
    least = {}
    for r in rows:
        if r["doc_id"] is not None:
            t = r["text"] or ""
            least[t] = min(least.get(t, r["doc_id"]), r["doc_id"])
    docs = []
    for r in rows:
        t, i = r["text"] or "", r["doc_id"]
        w = WORDS.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        own = [x for x in labels if x[0] == i and i is not None]
        docs.append((r["source"] or "", {k for k, v in fails.items() if v}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, shapley = {}, {}
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                before, mine = set(order[:k]), [d for d in docs if d[0] == part]
                here = [d for d in mine if x in d[1] and not d[1] & before]
                shapley[part, x] = shapley.get((part, x), 0) + len(here)
                out[part, "".join(order), k + 1] = [sum(not d[1] & (before | {x}) for d in mine), len(here), sum(x in d[1] and bool(d[1] & before) for d in mine), sum(d[1] == {x} for d in mine), sum(d[2] for d in here), sum(d[3] for d in here)]
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def test_audit_equals_brute_force_on_odd_rows(spark):
    docs = odd_documents(spark)
    labels = [(4, 1, 0), (6, 0, 1), (6, 1, None), (5, None, 1), (None, 1, 1), (99, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = plain_audit([r.asDict() for r in docs.collect()], labels)
    for rows in (docs, docs.repartition(5)):
        got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filteraudit.audit(rows, table).collect()}
        assert got == want
    assert filteraudit.audit(docs.limit(0), table).count() == 0


def test_audit_of_copies_in_one_source(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same words here").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"), F.lit("hot").alias("source"))
    got = filteraudit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).filter("filter_order = 'EABCD' AND step = 1").first()
    assert (got["removed"], got["kept"], got["unique_fails"]) == (999, 2001, 0)


def negatives(rows, anchors):
    """Brute force in Python's integers."""
    q = {i: [int(np.floor(256 * float(c))) for c in v] for i, v, _ in rows}
    label = {i: y for i, _, y in rows}
    score = lambda a, b: sum(x * y for x, y in zip(q[a], q[b], strict=True))
    out = set()
    for a in anchors:
        others = sorted(((-score(a, b), b) for b in q if b != a))
        for s, p in [x for x in others if label[x[1]] == label[a]][:5]:
            fit = [(-t, n) for t, n in others if label[n] != label[a] and 80 * -s <= 100 * -t <= 100 * -s]
            out |= {(a, p, k + 1, n, -s, t) for k, (t, n) in enumerate(fit[:5])}
    return out


@pytest.mark.parametrize("scale", [1.0, 5e5])
def test_hard_negatives_equal_brute_force(spark, scale):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(4, 12))
    rows = [(k, [float(np.float32(c * scale)) for c in centre[k % 4] * (k % 3) + rng.normal(size=12) * 0.4], int(rng.integers(3)) if k % 2 else 0) for k in range(160)]
    rows += [(1000 + k, rows[10][1], k % 2) for k in range(30)] + [(2000, [0.0] * 12, 1)]
    odd = [(None, rows[0][1], 1), (3000, None, 1), (3001, rows[1][1], None), (3002, [None, *rows[1][1][1:]], 1), (3003, [float("nan"), *rows[1][1][1:]], 1), (3004, [float("inf"), *rows[1][1][1:]], 2), (3005, rows[1][1][:5], 1), (3006, [], 0)]
    table = spark.createDataFrame(rows + odd + [rows[5], (7, rows[7][1], rows[7][2] + 1)], "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit("a clashing name"))
    want = negatives(rows, [i for i, _, _ in rows if i % 10 == 0])
    assert len(want) > 100
    for size in (None, 25):
        got = hardnegatives.mine(table, F.col("vec_id") % 10 == 0, block_rows=size)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert {tuple(r) for r in got.collect()} == want
    assert hardnegatives.mine(table.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_bounds_drop_pairs_and_lose_none():
    rng = np.random.default_rng(0)
    x = np.floor(256 * rng.normal(size=(400, 32)) * np.linspace(2, 0.01, 32))
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    a, b = hardnegatives.Rotated(x[:40], axes), hardnegatives.Rotated(x, axes)
    full = x[:40] @ x.T
    low, high = np.quantile(full, 0.99, axis=1), np.quantile(full, 0.995, axis=1)
    i, j, score = hardnegatives.survivors(a, b, np.arange(40), low, high, None, 0)
    assert (score == full[i, j]).all() and len(i) < 0.1 * full.size
    inside = {(p, q) for p, q in zip(*np.nonzero((full >= low[:, None]) & (full <= high[:, None])), strict=True)}
    assert inside <= set(zip(i.tolist(), j.tolist(), strict=True))


def plain_tree(text):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    end = "\n.!?。！？"
    piece = re.compile(f"[^{end}]{{1,64}}(?:[{end}]+[ \t\r]*)?|[{end}]+[ \t\r]*")
    sections, now = [], []
    for line in re.findall("[^\n]*\n|[^\n]+", text):
        own = piece.findall(line)
        assert "".join(own) == line
        codes = [sha(p) for p in own]
        now.append((sha("".join(codes)), [c[:8] for c in codes]))
        if now[-1][0][0] in "048c":
            sections.append(now)
            now = []
    sections += [now] if now else []
    digests = [sha("".join(p[0] for p in s)) for s in sections]
    return ";".join([sha("".join(digests)), *(":".join([d[:16], *(",".join([p[0][:16], *p[1]]) for p in s)]) for d, s in zip(digests, sections, strict=True))])


def test_fingerprints_equal_a_plain_tree(spark):
    texts = [None, "", "\n", "one", "First. Second!\n\nThird\n" * 20, "長い文。" * 60, "no end " * 900, "a\r\nb c 😀.. \n", "x" * 300_000]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").orderBy("k").select(merkle.fingerprint("text")).collect()]
    assert got == [plain_tree(t or "") for t in texts]


def test_next_rows_and_edits(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(int(i), " ".join(f"w{x}" for x in rng.integers(50, size=int(rng.integers(1, 40)))) + ".") for i in rng.permutation(600) * 7]
    rows += [(2100, f"tie {k}") for k in range(90)] + [(None, f"none {k}") for k in range(40)] + [(-5, None), (-(1 << 63), "least")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tree", F.lit(1)).repartition(7)
    for most in (16, 1 << 14):
        monkeypatch.setattr(merkle, "RANGE_ROWS", most)
        got = merkle.with_next(table).collect()
        assert len(got) == len(rows) and sorted(r["text"] for r in got) == sorted(t or "" for _, t in rows)
        assert sorted(r["next_text"] for r in got) == sorted(t or "" for _, t in rows)  # each is the next of one
        alone = sorted({i for i, _ in rows if i is not None and i != 2100}, reverse=True)
        text = {i: t or "" for i, t in rows}
        by = {r["doc_id"]: r["next_text"] for r in got}
        for a, b in zip(alone, alone[1:], strict=False):
            if not a > 2100 > b:
                assert by[a] == text[b]
        assert by[-(1 << 63)].startswith("none ")
        assert sum(r["next_text"] == text[alone[0]] for r in got if r["doc_id"] is None) == 1
        assert [r["next_tree"] for r in got] == [plain_tree(r["next_text"]) for r in got]
    one = merkle.compare(spark.createDataFrame([(4, "abcdef")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1.0 and one["fingerprint"] != one["edited_fingerprint"]
    assert merkle.compare(table.limit(0)).count() == 0


def test_differing_branches_locate_edits(spark):
    lines = [f"Paragraph {k} says a thing. And another one.\n" for k in range(60)]
    for k in (0, 17, 59):
        edited = [*lines[:k], "Something else.\n", *lines[k + 1 :]]
        row = spark.createDataFrame([("".join(lines), "".join(edited))], "a string, b string").select(merkle.fingerprint("a").alias("a"), merkle.fingerprint("b").alias("b"))
        r = row.select(merkle.changed_paragraphs("a", "b").alias("at"), merkle.likeness("a", "b").alias("near"), merkle.changed_paragraphs("a", "a").alias("none")).first()
        assert r["at"] == [k] and 0.9 < r["near"] < 1 and r["none"] == []
