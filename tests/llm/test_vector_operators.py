"""Embedding operators and components against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import permindex, tiledsim
from tidewatch.llm.components import components


def vectors(spark, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, dim))
    x = [list(map(float, centre[k % 6] + rng.normal(size=dim) * (0.05 + 0.1 * (k % 5)))) for k in range(300)]
    rows = [(k, v, k % 3) for k, v in enumerate(x)]
    rows += [(1000 + k, x[0], 0) for k in range(40)]  # copies
    rows += [(2000, None, 0), (2001, [0.0] * dim, 0), (2002, [None, *x[1][1:]], 0), (2003, [float("nan"), *x[1][1:]], 0), (2004, [float("inf"), *x[1][1:]], 0), (2005, x[1][:3], 0), (2006, [], 0), (None, x[2], 0), (7, x[7], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")


def plain(df):
    out = {}
    for r in df.collect():
        v = r["embedding"]
        if r["vec_id"] is None or v is None or len(v) != 16 or any(c is None or not np.isfinite(c) for c in v) or not any(v):
            continue
        out[r["vec_id"]] = np.array(v, np.float32).astype(float)
    return out


def test_tiles_are_bounded_by_bytes(spark, monkeypatch):
    df = vectors(spark)
    want = sorted(map(str, tiledsim.near_duplicates(df).collect()))
    monkeypatch.setattr(tiledsim, "TILE_BYTES", 16 * 16 * 30)
    assert sorted(map(str, tiledsim.near_duplicates(df).collect())) == want


def test_near_duplicates_equal_brute_force(spark):
    df = vectors(spark)
    x = plain(df)
    ids = sorted(x)
    u = np.stack([x[i] / np.linalg.norm(x[i]) for i in ids])
    for tile in (None, 40):
        got = tiledsim.near_duplicates(df, tile_rows=tile).collect()
        assert len(got) == df.count()
        near = u @ u.T >= 0.95
        parent = {i: i for i in ids}

        def find(a, parent=parent):
            while parent[a] != a:
                a = parent[a]
            return a

        for a, b in zip(*np.nonzero(near), strict=True):
            p, q = find(ids[a]), find(ids[b])
            parent[max(p, q)] = min(p, q)
        n = {i: int(near[k].sum()) - 1 for k, i in enumerate(ids)}
        for r in got:
            i = r["vec_id"]
            if i == 7:
                continue  # two equal rows of one id: each is the other's copy
            if i is None:
                assert r["component_id"] is None and r["n_links"] == 0 and r["kept"]
            elif i not in x:
                assert (r["n_links"], r["component_id"], r["kept"]) == (0, i, True)
            else:
                twin = int(near[ids.index(i), ids.index(7)])
                assert r["n_links"] == n[i] + twin and r["component_id"] == find(i) and r["kept"] == (i == find(i))


def test_near_duplicates_empty_table(spark):
    assert tiledsim.near_duplicates(vectors(spark).limit(0)).count() == 0


def test_search_small_table_is_exact(spark):
    df = vectors(spark)
    x = plain(df)
    ids = np.array(sorted(x))
    u = np.stack([x[i] / np.linalg.norm(x[i]) for i in ids])
    got = permindex.search(df, F.col("vec_id") % 50 == 0, share=1.0, routed=permindex.PIVOTS).orderBy("query_id", "rank").collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert sorted(by) == [i for i in ids.tolist() if i % 50 == 0]
    for q, rows in by.items():
        s = u @ u[ids.tolist().index(q)]
        order = [int(i) for i in ids[np.lexsort((ids, -np.round(s, 12)))] if i != q][:5]
        assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
        np.testing.assert_allclose([r["score"] for r in rows], [s[ids.tolist().index(i)] for i in order], atol=1e-12)
        if q in (0, 1000):
            assert [r["vec_id"] for r in rows] == order  # copies: ties go to the smaller id


def test_search_recall(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in e.collect()}
    ids = np.array(sorted(x))
    u = np.stack([x[i] / np.linalg.norm(x[i]) for i in ids])
    got = {}
    for r in permindex.query(spark, sf).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for q in ids[ids % 50 == 0]:
        s = u @ u[np.searchsorted(ids, q)]
        hits.append(len(got[q] & {int(i) for i in ids[np.lexsort((ids, -s))] if i != q and i in set(ids[np.argsort(-s)[:6]])}) / 5)
    assert np.mean(hits) >= 0.9


def test_search_over_many_blocks(spark, monkeypatch):
    """20,000 rows in several blocks and groups a file: recall at 5 of 0.9 or more, a part of the rows visited."""
    monkeypatch.setattr(permindex, "BLOCK_ROWS", 60)
    monkeypatch.setattr(permindex, "QUERY_ROWS", 40)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20_000, 64)).astype(np.float32)
    df = spark.createDataFrame([(k, v, 1, 0.5, 3) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, rank int, score double, cell int")
    got = permindex.search(df.repartition(8), F.col("vec_id") % 200 == 0).toPandas()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hits = []
    for q, mine in got.groupby("query_id"):
        s = u @ u[q]
        s[q] = -2
        hits.append(len(set(mine["vec_id"]) & set(np.argsort(-s)[:5].tolist())) / 5)
        np.testing.assert_allclose(mine.sort_values("rank")["score"], s[mine.sort_values("rank")["vec_id"]], atol=1e-9)
        assert sorted(mine["rank"]) == [1, 2, 3, 4, 5]
    assert len(hits) == 100 and np.mean(hits) >= 0.9


def test_search_finds_all_asked_for_where_files_are_thin(spark, monkeypatch):
    """Queries whose files hold too few visit all."""
    monkeypatch.setattr(permindex, "ROUTED", 1)
    monkeypatch.setattr(permindex, "POSTED", 1)
    rows = [(k, [float(np.cos(k)), float(np.sin(k))]) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = permindex.search(df, F.col("vec_id") % 10 == 0, routed=1).toPandas()
    x = np.array([v for _, v in rows])
    for q, mine in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -2
        np.testing.assert_allclose(s[mine.sort_values("rank")["vec_id"]], np.sort(s)[::-1][:5], atol=1e-12)


def test_search_repeated_ids_crowd_out_none(spark):
    """Ids that repeat with different vectors take one place each."""
    rows = [(0, [1.0, 0.0])] + [(1, [1.0, 0.001 * j]) for j in range(1, 9)] + [(i, [1.0, 0.1 * i]) for i in range(2, 9)]
    out = permindex.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0)
    got = [(r["rank"], r["vec_id"], r["score"]) for r in out.orderBy("rank").collect()]
    assert [g[:2] for g in got] == [(k, k) for k in range(1, 6)]
    assert got[0][2] == pytest.approx(1 / np.hypot(1, 0.001))


def test_search_few_and_no_rows(spark):
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in permindex.search(two, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1)]
    assert permindex.search(two.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(200 + k, 201 + k) for k in range(40)] + [(500, 501 + k) for k in range(30)] + [(3, 3), (None, 4)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {a: find(a) for a in parent}


@pytest.mark.parametrize("sent", [400_000, 0])
def test_components_of_stars_take_no_round(spark, monkeypatch, sent):
    from tidewatch.llm import common
    from tidewatch.llm import components as module

    monkeypatch.setattr(common, "SENT_ROWS", sent)
    written, stored = [], module.stored
    monkeypatch.setattr(module, "stored", lambda df, name: written.append(name) or stored(df, name))
    stars = [(0, k) for k in range(1, 9)] + [(20, 21)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(stars, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(9)}, 20: 20, 21: 20} and len(written) == 1
    chain = [(k, k + 1) for k in range(30)]
    assert {r["component"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()} == {0}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_true_neighbours_are_found_by_blocks(spark, monkeypatch, tmp_path):
    """neighbours_recall compares all rows by blocks, visits no file for it, and equals brute force: repeated ids, copies and ties too."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(3_000, 8)), 2)
    x[100:140] = x[7]  # copies
    ids = np.arange(len(x))
    ids[2_000:2_200] = 50  # an id on many rows
    folder = str(tmp_path)
    spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").write.parquet(f"{folder}/embeddings.parquet")
    monkeypatch.setattr(permindex, "query", lambda spark, d: spark.createDataFrame([(0, 1)], "query_id long, vec_id long"))
    monkeypatch.setattr(permindex, "_visit", lambda *args: pytest.fail("files were visited"))
    monkeypatch.setattr(permindex, "LEAST_BLOCK", 300)
    monkeypatch.setattr(permindex, "QUERY_ROWS", 40)
    got = {r["query_id"]: r for r in permindex.recall(spark, folder).collect()}
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    near = np.round(unit @ unit.T, 12)
    assert set(got) == set(ids[ids % 50 == 0].tolist())
    for q, row in got.items():
        best = {}
        for own in np.flatnonzero(ids == q):
            for i, s in zip(ids.tolist(), near[own].tolist(), strict=True):
                if i != q:
                    best[i] = max(best.get(i, -2.0), s)
        want = sorted(best.items(), key=lambda t: (-t[1], t[0]))[:5]
        assert row["nearest"] == ",".join(str(i) for i, _ in want) and row["least_score"] == pytest.approx(want[-1][1], abs=2e-9) and not row["recalled"]
