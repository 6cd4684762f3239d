import duckdb
import numpy as np
import pytest

from callglass.llm import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def plain(rows, least):
    def unit(e):
        if not e or any(x is None or not np.isfinite(x) for x in e) or not any(e):
            return None
        e = np.array(e, np.float32).astype(float)
        return e / np.sqrt((e * e).sum())

    us = [unit(e) if k is not None and i is not None else None for i, e, k, _ in rows]
    top, links = {i: i for i, *_ in rows}, [0] * len(rows)

    def root(x):
        return x if top[x] == x else root(top[x])

    for p, (i, _, k, _) in enumerate(rows):
        for q, (j, _, m, _) in enumerate(rows):
            if p != q and k == m and us[p] is not None and us[q] is not None and len(us[p]) == len(us[q]) and us[p] @ us[q] >= least:
                links[p] += 1
                x, y = sorted((root(i), root(j)))
                top[y] = x
    return sorted((i, n, root(i), root(i) == i) for (i, *_), n in zip(rows, links))


def made(seed, n=150, size=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size))
    rows = []
    for i in range(n):
        c = centres[rng.integers(12)] + rng.choice([0, 0.02, 0.08, 0.3]) * rng.normal(size=size)
        rows.append((i, (c * rng.choice([1.0, 7.0])).astype(np.float32).tolist(), int(rng.integers(3)), "x"))
    return rows


@pytest.mark.parametrize(("tile", "least", "size"), [(2_048, 0.98, 8), (4, 0.98, 8), (2_048, 0.9, 30), (8, 0.999, 3)])
def test_against_all_pairs(spark, monkeypatch, tile, least, size):
    monkeypatch.setattr(near_vectors, "TILE", tile)
    monkeypatch.setattr(near_vectors, "LEADING", 3)
    rows = made(tile, size=size)
    got = sorted(tuple(r) for r in near_vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), least).collect())
    assert got == plain(rows, least) and any(r[1] for r in got)


def test_edges(spark):
    one = [1.0, 2.0]
    rows = [
        (1, one, 1, "c"), (2, one, 1, "c"), (3, [2.0, 4.0], 1, "c"), (4, one, 2, "c"), (5, one, None, "c"), (6, None, 1, "c"), (7, [], 1, "c"), (8, [0.0, 0.0], 1, "c"),
        (9, [float("nan"), 1.0], 1, "c"), (10, [float("inf"), 1.0], 1, "c"), (11, [None, 1.0], 1, "c"), (12, [1.0, 2.0, 0.0], 1, "c"), (13, [1e-30, 2e-30], 1, "c"), (14, [5.0], 3, "c"),
        (15, [-7.0], 3, "c"), (16, [3.0], 3, "c"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in near_vectors.near_duplicates(df).collect()) == plain(rows, 0.98)
    assert near_vectors.near_duplicates(df.limit(0)).count() == 0
    again = spark.createDataFrame([(1, one, 1, "c"), (1, one, 1, "c"), (1, [-1.0, 0.0], 1, "c"), (None, one, 1, "c")], SCHEMA)
    assert sorted((r["vec_id"] or -1, r["n_links"]) for r in near_vectors.near_duplicates(again).collect()) == [(-1, 0), (1, 0), (1, 1), (1, 1)]


def test_sql_says_the_same(spark):
    got = near_vectors.near_duplicates(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")).collect()
    con = duckdb.connect()
    con.sql("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    assert sorted(tuple(r) for r in got) == sorted(con.sql(near_vectors.SQL).fetchall())


def test_vectors_that_share_an_id_are_counted_apart(spark):
    rows = [(1, [1.0, 2.0], 1, "c"), (1, [1.0, 2.01], 1, "c"), (2, [1.0, 2.02], 1, "c"), (0, [1.0, 2.0], 2, "c")]
    for given in (rows, rows[::-1]):
        got = near_vectors.near_duplicates(spark.createDataFrame(given, SCHEMA)).collect()
        assert sorted(tuple(r) for r in got) == [(0, 0, 0, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
