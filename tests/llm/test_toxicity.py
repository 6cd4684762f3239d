import zlib

import numpy as np
from tables import documents

from callglass.llm import toxicity


def test_held_out_quality(spark):
    given = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity.scored(given, labels).collect()
    assert len(rows) == given.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    caught = sum(t and p for t, p in held)
    assert caught / sum(t for t, _ in held) > 0.82 and caught / sum(p for _, p in held) > 0.95


LABELS = "doc_id long, quality int, toxic int, text string"


def test_interactions_are_learned():
    rng = np.random.default_rng(1)
    rows = [sorted(set(rng.integers(0, 6, 3).tolist())) for _ in range(2_000)]
    label = np.array([float({0, 1} <= set(r)) for r in rows])  # neither term alone tells
    m = toxicity.Machine(6)
    m.fit(rows, label, np.ones(len(rows)))
    flat, owner = np.array([0, 2, 1, 2, 0, 1]), np.array([0, 0, 1, 1, 2, 2])
    a, b, both = m.score(flat, owner, 3)
    assert both > 0.5 > max(a, b)


def test_sums_equal_all_pairs():
    m = toxicity.Machine(5, 0.25)
    m.weight[:] = [1, 2, 3, 4, 5]
    m.factor[:] = np.random.default_rng(0).normal(size=m.factor.shape)
    own = [0, 2, 4]
    pairs = sum(m.factor[i] @ m.factor[j] for i in own for j in own if i < j)
    assert np.isclose(m.raw(np.array(own), np.zeros(3, int), 1)[0][0], 0.25 + 1 + 3 + 5 + pairs)


def learning(spark, extra=()):
    rows = [f"you are {'an idiot' if i % 3 == 0 else 'a friend'} number {i}" for i in range(90)] + list(extra)
    labels = [(i, 1, int(i % 3 == 0), "clash") for i in range(90)]
    return documents(spark, rows), spark.createDataFrame(labels, LABELS)


def test_edges(spark):
    df, labels = learning(spark, [None, "", "idiot " * 30_000, "friend"])
    got = {r["doc_id"]: r for r in toxicity.scored(df, labels).collect()}
    assert got[90]["score"] == got[91]["score"] and got[92]["predicted"] == 1 and got[93]["predicted"] == 0
    assert toxicity.scored(df.limit(0), labels).count() == 0
    assert {r["predicted"] for r in toxicity.scored(df, labels.limit(0)).collect()} == {0}
    nulls = df.selectExpr("cast(null as long) doc_id", "text")
    assert all(r["held_out"] for r in toxicity.scored(nulls, labels).collect())


def test_held_out_labels_are_not_used(spark):
    df, labels = learning(spark)
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = (sorted(map(str, toxicity.scored(df, x).collect())) for x in (labels, turned))
    assert a == b


def test_no_telling_term_gives_the_base_rate(spark):
    rows = [(i, f"word{i} other{i}", "en", "s", 5) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    got = toxicity.scored(df, labels).collect()
    assert len(got) == 12 and all(0 <= r["score"] <= 1 for r in got)
