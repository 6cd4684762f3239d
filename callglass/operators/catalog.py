"""Provider catalogue: output caps and model resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callglass import schema as S

# Default models, the one output cap, and the one closed set of models.
DEFAULT_CATALOG = (
    ("mock", "mock", None, ["mock", "mock-slow", "mock-error", "mock-instant", "mock-cancel"], True),
    ("anthropic", "claude-opus-5", None, None, False),
    ("openai", "gpt-4o", None, None, False),
    ("groq", "openai/gpt-oss-20b", 4096, None, False),
    ("gemini", "gemini-flash-latest", None, None, False),
    ("ollama", "llama3.2", None, None, False),
)
FALLBACK_PROVIDER = "mock"


def default_catalog(spark: SparkSession, configured: tuple[str, ...] = ("mock",)) -> DataFrame:
    """The catalogue as literal rows: their size is known, so joins with it shuffle nothing."""
    text = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'"
    rows = [
        f"({text(p)}, {text(m)}, cast({'null' if cap is None else cap} as int), "
        f"{'cast(null as array<string>)' if closed is None else 'array(' + ', '.join(map(text, closed)) + ')'}, {str(p in configured).lower()})"
        for p, m, cap, closed, _ in DEFAULT_CATALOG
    ]
    return spark.sql(f"select * from values {', '.join(rows)} as t(provider, default_model, max_output_tokens, closed_models, configured)")


def default_provider(catalog: DataFrame, wanted: str = FALLBACK_PROVIDER) -> str:
    """The wanted default where it is configured, else the fallback."""
    known = catalog.where(F.col("configured") & (F.col("provider") == wanted)).head()
    return wanted if known else FALLBACK_PROVIDER


def _blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def resolve_models(
    requests: DataFrame,
    catalog: DataFrame,
    default: str = FALLBACK_PROVIDER,
    provider: str = "provider",
    model: str = "model",
) -> DataFrame:
    """Adds ``resolved_provider``, ``resolved_model`` and ``problem`` (null when served)."""
    known = catalog.where("configured").select(
        F.col("provider").alias("resolved_provider"), "default_model", "closed_models"
    )
    asked = requests.withColumn("resolved_provider", F.coalesce(_blank_to_null(F.col(provider)), F.lit(default)))
    joined = asked.join(known, "resolved_provider", "left")
    chosen = F.coalesce(_blank_to_null(F.col(model)), F.col("default_model"))
    missing = F.col("default_model").isNull()
    closed = F.coalesce(~F.array_contains("closed_models", chosen), F.lit(False))
    return joined.select(
        *[requests[c] for c in requests.columns],
        "resolved_provider",
        F.when(~missing, chosen).alias("resolved_model"),
        F.when(missing, "provider_not_configured").when(closed, "model_not_supported").alias("problem"),
    )


def clamp_budgets(
    requests: DataFrame, catalog: DataFrame, requested: str = "requested_tokens", provider: str = "provider"
) -> DataFrame:
    """Adds ``granted_tokens``: what was asked for, at most the provider's cap where it has one."""
    caps = catalog.select(F.col("provider").alias(provider), "max_output_tokens")
    asked = F.coalesce(F.col(requested), F.lit(S.DEFAULT_OUTPUT_TOKENS))
    return (
        requests.join(caps, provider, "left")
        .withColumn("granted_tokens", F.least(asked, F.col("max_output_tokens")))
        .drop("max_output_tokens")
    )
