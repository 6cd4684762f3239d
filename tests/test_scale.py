import pytest
from pyspark.sql import functions as F

from callglass import session
from callglass.operators import catalog, contract, metrics


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Fake:
    def __init__(self, **conf):
        self.conf = Conf(conf)


def test_a_cluster_without_shared_folder_is_an_error():
    with pytest.raises(ValueError, match="share"):
        session.shared_folder(Fake(**{"spark.master": "spark://host:7077"}))
    assert session.shared_folder(Fake(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:/x"})) == "hdfs:/x"


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("BroadcastExchange")


def test_the_catalogue_is_joined_without_shuffling_requests(spark):
    asked = spark.range(1000).select(F.lit("groq").alias("provider"), F.lit("").alias("model"), F.col("id").cast("int").alias("requested_tokens"))
    known = catalog.default_catalog(spark, ("mock", "groq"))
    for df in (catalog.resolve_models(asked, known), catalog.clamp_budgets(asked, known)):
        assert exchanges(df) == (0, 1)


def test_id_spellings(spark):
    plain = "00000000-0000-4000-8000-0000000000ab"
    forms = {
        plain: plain, plain.upper(): plain, plain.replace("-", ""): plain, "{" + plain + "}": plain, "urn:uuid:" + plain: plain,
        "URN:UUID:" + plain: None, "uuid:" + plain: plain, "x": None,
    }
    rows = spark.createDataFrame([(k, v) for k, v in forms.items()], "given string, want string")
    assert rows.where(~contract.canonical_uuid(F.col("given")).eqNullSafe(F.col("want"))).count() == 0
    odd = spark.createDataFrame([(plain, True), ("{" + plain + "}", True), (plain.replace("-", ""), True), ("0000-0000" + plain.replace("-", "")[8:], False), ("uuid:" + plain, False)], "given string, ok boolean")
    assert odd.where(F.col("given").rlike(contract._STRICT_UUID) != F.col("ok")).count() == 0


def test_epoch_times_reach_the_last_year(spark):
    row = spark.sql("select parse_json('253402300799') v").select(contract._as_time(F.col("v"), F.schema_of_variant("v")).alias("t")).first()
    del row  # seconds above the limit count as milliseconds
    later = spark.sql("select parse_json('253402300799000') v").select(contract._as_time(F.col("v"), F.schema_of_variant("v"))["at"].cast("string")).first()
    assert later[0].startswith("9999-12-31 23:59:59")


def test_presets_are_literal(spark):
    calls = spark.createDataFrame([], "provider string, model string, status string, completed_at timestamp, started_at timestamp, latency_ms int, ttft_ms int, input_tokens int, output_tokens int")
    assert metrics.window_presets(calls, "2024-01-01 00:00:00").count() == 4
