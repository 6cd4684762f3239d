from datetime import datetime

import pytest
from conftest import ID, deliveries, event
from pyspark.sql import functions as F

from callglass.operators import browse, ingest
from callglass.sources import envelopes, pages
from callglass.sources.tables import REPLAYS, Store
from callglass.streaming import ingest as streaming


def arrive(spark, source, events, first=0):
    rows = deliveries(spark, events).withColumn("delivery_id", F.col("delivery_id") + first)
    rows.coalesce(1).write.mode("append").parquet(source)


def take(spark, store, source, checkpoint, check_with=ingest.check):
    streaming.start(envelopes.file_stream(spark, source, files_per_batch=1), store, checkpoint, None, check_with).awaitTermination()


def counts(store):
    return [tuple(r)[:4] for r in store.read("outcomes").orderBy("batch_id").collect()]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def places(tmp_path):
    return [str(tmp_path / n) for n in ("in", "store", "checkpoint")]


class NoHistory(Store):
    """A store whose batches may not look at what is stored."""

    def write(self, name, rows, batch_id):
        self.writing = True
        super().write(name, rows, batch_id)

    def read(self, name, before_batch=None):
        assert name == "outcomes" or not getattr(self, "busy", False), "a batch read the stored rows"
        return super().read(name, before_batch)

    def clear(self, batch_id):
        self.busy = True
        super().clear(batch_id)


def test_six_batches_read_no_history(spark, places):
    source, root, checkpoint = places
    for n in range(6):  # each file repeats the call of the one before
        arrive(spark, source, [event(id=ID % n), event(id=ID % (n + 1))], 10 * n)
    take(spark, NoHistory(spark, root), source, checkpoint)
    store = Store(spark, root)
    assert counts(store) == [(2, 2, 0, 0), *[(2, 1, 1, 0)] * 5]
    assert store.read("logs").count() == store.read("raw").count() == 7
    assert store.read("attempts").count() == 12


def test_a_call_that_was_invalid_first(spark, places):
    source, root, checkpoint = places
    for n, e in enumerate([event(status="ERROR"), event(), event(), event(latency_ms=-1)]):
        arrive(spark, source, [e], n)
        take(spark, Store(spark, root), source, checkpoint)  # a restart before every batch
    store = Store(spark, root)
    assert counts(store) == [(1, 0, 0, 1), (1, 1, 0, 0), (1, 0, 1, 0), (1, 0, 0, 1)]
    assert [(r.delivery_id, r.processing_status) for r in store.raw_state().collect()] == [(0, "failed")]
    assert store.read("logs").count() == 1


@pytest.mark.parametrize("fails_at", ["logs", "outcomes"])
def test_a_crash_starts_from_the_state_before(spark, places, fails_at):
    source, root, checkpoint = places
    arrive(spark, source, [event(), event(id=ID % 2)])
    take(spark, Store(spark, root), source, checkpoint)

    class Breaking(Store):
        def write(self, name, rows, batch_id):
            if name == fails_at:
                raise RuntimeError("lost")
            super().write(name, rows, batch_id)

    arrive(spark, source, [event(id=ID % 2), event(id=ID % 3)], 10)
    with pytest.raises(Exception, match="lost"):
        take(spark, Breaking(spark, root), source, checkpoint)
    take(spark, Store(spark, root), source, checkpoint)
    store = Store(spark, root)
    assert counts(store) == [(2, 2, 0, 0), (2, 1, 1, 0)] and store.read("logs").count() == store.read("raw").count() == 3


def test_what_a_replay_stores_is_known_to_the_stream(spark, places):
    source, root, checkpoint = places
    arrive(spark, source, [event(status="ERROR", error_message="failed")])
    take(spark, Store(spark, root), source, checkpoint)
    store = Store(spark, root)
    streaming.replay_failed(store, repair=lambda data: F.regexp_replace(data, '"ERROR"', '"error"'))
    assert store.read("logs").count() == 1 and store.read("outcomes").agg(F.max("batch_id")).first()[0] == REPLAYS
    arrive(spark, source, [event(), event(id=ID % 2)], 10)
    take(spark, store, source, checkpoint)
    assert store.read("logs").count() == 2 and counts(store)[1] == (2, 1, 1, 0)
    other = f"{checkpoint}-2"  # another stream on the same store, which sees all files anew
    take(spark, store, source, other)
    assert store.read("logs").count() == store.read("raw").count() == 2
    assert store.batches_unknown_to(other) and store.first_batch_of(other) > store.first_batch_of(checkpoint) == 0


def test_supervised_restart(spark, places):
    source, root, checkpoint = places
    arrive(spark, source, [event()])
    arrive(spark, source, [event(), event(id=ID % 2)], 10)
    tries = []

    class Shaky(Store):
        def clear(self, batch_id):
            tries.append(batch_id)
            if len(tries) in (2, 3):
                raise RuntimeError("not now")
            super().clear(batch_id)

    begin = lambda: streaming.start(envelopes.file_stream(spark, source, files_per_batch=1), Shaky(spark, root), checkpoint, None)
    assert streaming.supervise(begin, tries=3, pause=0.1) == 2
    assert tries == [0, 1, 1, 1] and counts(Store(spark, root)) == [(1, 1, 0, 0), (2, 1, 1, 0)]
    tries.clear()
    arrive(spark, source, [event(id=ID % 3)], 20)

    class Broken(Store):
        def clear(self, batch_id):
            raise RuntimeError("never")

    with pytest.raises(Exception, match="never"):
        streaming.supervise(lambda: streaming.start(envelopes.file_stream(spark, source), Broken(spark, root), checkpoint, None), tries=1, pause=0.1)


def filled(spark, root, days=6, per_batch=40):
    """A batch per day, calls a few minutes apart; every fourth one failed, in two conversations."""
    store = Store(spark, root).create()
    for d in range(days):
        events = []
        for k in range(per_batch):
            at = f"2024-01-{d + 1:02d}T{k % 24:02d}:{k:02d}:00"
            n = d * per_batch + k
            events.append(event(id=ID % n, started_at=f"{at}Z", completed_at=f"{at}.500Z", status="error" if k % 4 == 0 else "success", error_message="failed" if k % 4 == 0 else None,
                                conversation_id="00000000-0000-4000-9000-%012d" % (d % 2), provider="rare" if n == 3 else "mock"))
        streaming.write_batch(store, deliveries(spark, [*events, "{broken", "[]"]).withColumn("delivery_id", F.col("delivery_id") + 1000 * d), d)
    return store


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    return filled(spark, str(tmp_path_factory.mktemp("filled")))


def rows_of(df):
    return [(r.started_at, r.id) for r in df.collect()]


def test_pages_read_their_days_only(spark, store):
    everything = sorted(rows_of(store.read("logs")), reverse=True)
    cursor, seen = None, []
    while True:
        got = rows_of(pages.page(store, 30, cursor))
        seen += got
        if len(got) < 30:
            break
        cursor = browse.Cursor(*got[-1])
    assert seen == everything
    first, later = pages.page(store, 30), pages.page(store, 30, browse.Cursor(datetime(2024, 1, 3, 12), "f"))
    for df, days in ((first, ["2024-01-06"]), (later, ["2024-01-02", "2024-01-03"])):
        text = plan(df)
        filters = text.split("PartitionFilters: [")[1].split("]")[0]
        assert "completed_date" in filters and ">=" in filters and "<=" in filters
        assert sorted({str(r[0]) for r in df.select(F.to_date("completed_at")).collect()}) == days


def test_filtered_pages(spark, store):
    logs = store.read("logs")
    assert rows_of(pages.recent_errors(store, 15)) == sorted(rows_of(logs.where("status = 'error'")), reverse=True)[:15]
    assert rows_of(pages.page(store, 5, provider="rare")) == rows_of(logs.where("provider = 'rare'"))
    assert rows_of(pages.page(store, 5, provider="none")) == []
    assert rows_of(pages.page(store, 50, status="success")) == sorted(rows_of(logs.where("status = 'success'")), reverse=True)[:50]


def test_an_empty_store_has_no_page(spark, tmp_path):
    empty = Store(spark, str(tmp_path / "none")).create()
    assert rows_of(pages.page(empty, 5)) == [] and pages.by_id(empty, ID % 1).count() == 0
    assert pages.keep_newest_dead_letters(empty, 5) is None and pages.compact_places(empty) == 0


def test_lookups_prune_by_the_index(spark, store):
    for df in (pages.by_id(store, ID % 77), pages.of_conversation(store, "00000000-0000-4000-9000-%012d" % 1)):
        assert "dynamicpruning" in plan(df).lower()
    assert [r.id for r in pages.by_id(store, ID % 77).collect()] == [ID % 77]
    assert pages.by_id(store, ID % 99_999).count() == 0
    wanted = "00000000-0000-4000-9000-%012d" % 1
    assert rows_of(pages.of_conversation(store, wanted)) == sorted(rows_of(store.read("logs").where(F.col("conversation_id") == wanted)))
    assert [r.completed_date.day for r in pages.places(store, "id", ID % 77).collect()] == [2]


def test_the_index_is_compacted(spark, tmp_path):
    own = filled(spark, str(tmp_path / "s"), days=3, per_batch=5)
    before = sorted(map(tuple, spark.read.parquet(own.path("places")).select("kind", "key", "completed_date", "batch").collect()))
    assert pages.compact_places(own) == 3
    again = spark.read.parquet(own.path("places"))
    assert sorted(map(tuple, again.select("kind", "key", "completed_date", "batch").collect())) == before
    assert again.select("batch_id").distinct().count() == 1 and [r.id for r in pages.by_id(own, ID % 7).collect()] == [ID % 7]
    assert pages.compact_places(own) == 1


def test_newest_dead_letters(spark, tmp_path):
    own = filled(spark, str(tmp_path / "s"), days=4, per_batch=2)
    everything = sorted(r.delivery_id for r in own.read("dead_letters").collect())
    assert len(everything) == 8
    for keep in (50, 8, 7, 7, 5, 1):
        pages.keep_newest_dead_letters(own, keep)
        assert sorted(r.delivery_id for r in own.read("dead_letters").collect()) == everything[-keep:]
        on_disk = spark.read.parquet(own.path("dead_letters")).count()
        assert min(keep, 8) <= on_disk <= min(8, keep + 1)  # whole batches are gone, the one at the edge is hidden in part


def test_a_crash_between_the_steps_of_retention(spark, tmp_path, monkeypatch):
    own = filled(spark, str(tmp_path / "s"), days=3, per_batch=2)
    everything = sorted(r.delivery_id for r in own.read("dead_letters").collect())

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Store, "raise_floor", lost)
        with pytest.raises(RuntimeError):
            pages.keep_newest_dead_letters(own, 3)
    assert sorted(r.delivery_id for r in own.read("dead_letters").collect()) == everything
    with monkeypatch.context() as m:
        m.setattr(pages, "delete_exactly", lost)
        with pytest.raises(RuntimeError):
            pages.keep_newest_dead_letters(own, 3)
    assert sorted(r.delivery_id for r in own.read("dead_letters").collect()) == everything[-3:]
    pages.keep_newest_dead_letters(own, 3)
    assert spark.read.parquet(own.path("dead_letters")).count() == 4


def test_old_days_are_dropped(spark, tmp_path):
    own = filled(spark, str(tmp_path / "s"), days=4, per_batch=3)
    gone = pages.drop_days_before(own, "2024-01-05 00:00:00", 2)
    assert [d.day for d in gone] == [1, 2]
    assert {r[0].day for r in own.read("logs").select("completed_date").collect()} == {3, 4}
    assert len(rows_of(pages.page(own, 100))) == 6 and pages.by_id(own, ID % 0).count() == 0
    assert not [f for f in spark.read.parquet(own.path("logs")).inputFiles() if "2024-01-01" in f]
