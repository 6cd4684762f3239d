from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from callglass.operators import browse, correlate
from callglass.operators.blocks import even_positions, evenly

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize(("n", "rows"), [(5_000, 500), (5_000, 10_000), (7, 2), (0, 5)])
def test_blocks_hold_about_as_many_rows(spark, n, rows):
    one_moment = spark.range(n).select(F.lit(T0).alias("at"), F.col("id").cast("string").alias("id"))
    cut = evenly(one_moment, [F.desc("at"), F.desc("id")], rows)
    sizes = [r["count"] for r in cut.groupBy("_block").count().collect()]
    assert sum(sizes) == n and all(s <= 2 * rows for s in sizes) and len(sizes) <= -(-n // rows)
    got = even_positions(one_moment, [F.desc("at"), F.desc("id")], "no", rows).orderBy("no").collect()
    assert [r.no for r in got] == list(range(1, n + 1)) and [r.id for r in got] == sorted((str(i) for i in range(n)), reverse=True)


def test_an_export_of_one_moment_is_spread(spark):
    calls = spark.range(4_000).select(F.lit(T0).alias("started_at"), F.lpad(F.col("id").cast("string"), 6, "0").alias("id"))
    rows = browse.export_pages(calls, 50, rows=400).collect()
    assert [r.page_no for r in rows] == [i // 50 + 1 for i in range(4_000)]
    assert [r.id for r in rows] == [f"{i:06d}" for i in reversed(range(4_000))]


@pytest.mark.parametrize("rows", [1, 3, 50, 10_000])
def test_one_busy_conversation_in_one_hour(spark, rows):
    at = lambda s: T0 + timedelta(seconds=s)
    calls = spark.createDataFrame([("c", f"{i:03d}", at(10 * i), at(10 * i + 4)) for i in range(150)] + [(None, "x", at(0), at(1))],
                                  "conversation_id string, id string, started_at timestamp, completed_at timestamp")
    said = [("c", f"r{i}", at(10 * i + (6 if i % 3 else 2))) for i in range(150) if i % 5]
    replies = spark.createDataFrame([*said, ("c", "last", at(99_999))], "conversation_id string, reply_id string, created_at timestamp")
    want = {"x": (None, 0)} | {f"{i:03d}": (f"r{i}", 1) if i % 5 and i % 3 else (None, 0) for i in range(150)}
    want["149"] = (None, 2)
    assert {r.id: (r.reply_id, r.candidate_replies) for r in correlate.replies_to_calls(calls, replies, rows=rows).collect()} == want
