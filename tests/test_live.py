from pyspark.sql import functions as F

from callglass.operators import metrics
from callglass.streaming import live


def parts(df):
    return sorted((tuple(r[c] for c in ["part", "bucket", "provider", "model", *metrics.PARTS]) for r in df.collect()), key=str)


def test_late_calls_reach_their_minute_at_once(spark, given, tmp_path):
    path, logs = str(tmp_path / "counts"), given.logs
    end = "2024-01-31 00:00:00"
    early, late = logs.where("k % 5 > 0"), logs.where("k % 5 = 0")
    live.write_counts(early, path, 0)
    assert parts(live.summary(spark, path, "2024-01-24 00:00:00", "hour")) == parts(metrics.summary_parts(early, end, 10_080, "hour"))
    live.write_counts(late, path, 1)  # each of these is earlier than some call before
    live.write_counts(late, path, 1)  # a batch that runs again
    assert parts(live.summary(spark, path, "2024-01-24 00:00:00", "hour")) == parts(metrics.summary_parts(logs, end, 10_080, "hour"))
    assert live.counts(spark, path).agg(F.sum(F.when(F.col("_by_latency"), F.col("_n")))).first()[0] == 1000
