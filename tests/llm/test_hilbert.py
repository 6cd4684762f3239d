import itertools
import zlib

import pytest
from tables import documents
from pyspark.sql import functions as F

from callglass.llm import hilbert


@pytest.mark.parametrize(("axes", "bits"), [(2, 3), (3, 3), (3, 4)])
def test_curve_visits_every_cell_by_unit_steps(spark, axes, bits):
    side = 1 << bits
    df = spark.createDataFrame(list(itertools.product(range(side), repeat=axes)), ", ".join(f"c{a} int" for a in range(axes)))
    rows = df.withColumn("at", hilbert.curve_index([F.col(f"c{a}") for a in range(axes)], bits)).orderBy("at").collect()
    assert [r["at"] for r in rows] == list(range(side**axes))
    for a, b in zip(rows, rows[1:]):
        assert sum(abs(a[i] - b[i]) for i in range(axes)) == 1


def check_law(rows, shards):
    by = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(shards)}
    assert sum(map(len, by.values())) == len(rows)
    assert all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


@pytest.mark.parametrize("n", [0, 1, 39, 40, 41, 200])
def test_counts_and_slots(spark, n):
    df = documents(spark, [f"text {i % 7}" for i in range(n)])
    rows = hilbert.documents_in_shards(df).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(n))
    check_law(rows, 40)


def test_whole_table_and_columns(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = hilbert.documents_in_shards(given).collect()
    texts = {r["doc_id"]: r["text"].encode() for r in given.collect()}
    assert {r["doc_id"] for r in rows} == set(texts)
    check_law(rows, 40)
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]]) + 16
        assert r["text_crc32"] == zlib.crc32(texts[r["doc_id"]])
    # Runs follow the curve.
    order = [r["cell"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, None, None, None, None, 1)] * 3 + [(5, "", "en", "x", 0, 2), (5, "", "en", "x", 0, 2), (6, "é" * 50_000, None, "y", 9, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, slot int")
    got = hilbert.documents_in_shards(df, 4).collect()
    check_law(got, 4)
    assert sorted(r["size"] for r in got) == [16] * 5 + [100_016]
    again = hilbert.assign(df, ["lang", "n_chars"], 4, ["doc_id"], bits=3)
    assert sorted(again.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars", "cell", "shard", "slot"])
    check_law(again.collect(), 4)


def test_one_cell_holds_all_rows(spark):
    df = documents(spark, ["same"] * 500)
    check_law(hilbert.documents_in_shards(df).collect(), 40)


def test_written_shards_keep_order(spark, tmp_path):
    df = documents(spark, [f"t{i}" for i in range(90)])
    hilbert.write(hilbert.assign(df, ["n_chars"], 5, ["doc_id"]), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.groupBy("shard").count().count() == 5 and back.count() == 90


def test_no_python_in_the_plan(spark):
    plan = hilbert.documents_in_shards(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
