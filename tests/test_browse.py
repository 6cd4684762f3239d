from datetime import datetime

import pytest
from pyspark.sql import functions as F

from callglass.operators import browse
from callglass.plans.browser import stored, tied


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_equal_one_sort_and_lose_no_tie(given):
    calls = tied(given).select("id", "started_at").where("started_at < '2024-01-02'")
    seen, cursor = [], None
    while True:
        rows, cursor = browse.fetch_page(calls, 7, cursor)
        seen += [(r.started_at, r.id) for r in rows]
        if cursor is None:
            break
    expected = sorted(((r.started_at, r.id) for r in calls.collect()), reverse=True)
    assert seen == expected and len({s for s, _ in seen}) < len(seen)


def test_four_on_one_instant(spark):
    at = datetime(2024, 1, 1)
    calls = spark.createDataFrame([(at, str(i)) for i in range(4)], "started_at timestamp, id string")
    first, cursor = browse.fetch_page(calls, 2)
    second, last = browse.fetch_page(calls, 2, cursor)
    third, end = browse.fetch_page(calls, 2, last)
    assert [r.id for r in first + second] == ["3", "2", "1", "0"] and third == [] and end is None


def test_no_cursor_after_a_short_page(given):
    rows, cursor = browse.fetch_page(stored(given).where("k < 3"), 25)
    assert len(rows) == 3 and cursor is None


def test_time_bound_alone_is_strict(given):
    calls = tied(given)
    bound = calls.agg(F.max("started_at")).first()[0]
    assert calls.where(browse.before(bound)).where(F.col("started_at") >= bound).count() == 0


def test_filters(given):
    df = browse.matching(given.logs, provider="groq", model="model-0", status="error", started_since="2024-01-05 00:00:00")
    for r in df.collect():
        assert (r.provider, r.model, r.status) == ("groq", "model-0", "error") and r.started_at >= datetime(2024, 1, 5)
    with pytest.raises(ValueError):
        browse.matching(given.logs, status="ERROR")
    for limit in (0, 201):
        with pytest.raises(ValueError):
            browse.newest(given.logs, limit)


def test_absent_metadata_is_an_empty_object(given):
    rows = browse.full_rows(stored(given).where("status = 'error'")).select(F.to_json("raw_metadata")).distinct().collect()
    assert [r[0] for r in rows] == ["{}"]


def test_export_numbers_pages_in_order(given):
    rows = browse.export_pages(tied(given).select("id", "started_at"), 50).collect()
    assert [r.page_no for r in rows] == [i // 50 + 1 for i in range(1000)]
    assert [(r.started_at, r.id) for r in rows] == sorted(((r.started_at, r.id) for r in rows), reverse=True)


def test_require(given):
    some = given.logs.first().id
    assert browse.require(given.logs, some).id == some
    with pytest.raises(LookupError):
        browse.require(given.logs, "absent")


def test_page_plan(spark, given, tmp_path):
    given.logs.write.parquet(str(tmp_path / "logs"))
    calls = spark.read.parquet(str(tmp_path / "logs"))
    text = plan(browse.newest(calls.where(browse.before("2024-01-10 00:00:00", "x")), 25))
    assert "TakeOrderedAndProject" in text and "LessThanOrEqual(started_at" in text
    assert "Exchange" not in text.replace("BroadcastExchange", "")
