"""Tables, enumerations and limits of the event contract."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the event contract.
SCHEMA_VERSION = 1
EVENT_TYPE = "inference.completed"
CALL_STATUSES = ("success", "error", "cancelled")
CONVERSATION_STATUSES = ("active", "cancelled", "archived")
ROLES = ("user", "assistant", "system")
PROCESSING_STATUSES = ("pending", "processed", "failed")
REASON_MALFORMED = "malformed_json"
REASON_NO_ID = "missing_or_invalid_id"
REASON_INVALID = "schema_validation_failed"
RETRYABLE_ERRORS = ("RateLimitError", "InternalServerError", "APIConnectionError")
CANCELLED_MESSAGE = "Cancelled by client"
MAX_PROVIDER_CHARS = 64
MAX_MODEL_CHARS = 128
MAX_ERROR_TYPE_CHARS = 128
MAX_FINISH_REASON_CHARS = 64
MAX_EVENT_TYPE_CHARS = 64
MAX_MESSAGE_CHARS = 32_000
MAX_PROCESSING_ERROR_CHARS = 4_000
STREAM_KEEP = 100_000
DEAD_LETTER_KEEP = 10_000
STALLED_AFTER_SECONDS = 120.0
CRITICAL_ERROR_RATE = 0.05
INTERVALS = ("second", "minute", "hour", "day")
DASHBOARD_INTERVALS = ("minute", "hour", "day")
WINDOW_PRESETS = (("15m", 15, "minute"), ("1h", 60, "minute"), ("24h", 1440, "hour"), ("7d", 10080, "hour"))
MAX_WINDOW_MINUTES = 10_080
DEFAULT_WINDOW_MINUTES = 60
MAX_PAGE = 200
DEFAULT_PAGE = 25
HISTORY_MESSAGES = 20
HISTORY_CHARS = 12_000
PREVIEW_CHARS = 500
TITLE_CHARS = 60
DEFAULT_TITLE = "New conversation"
DEFAULT_OUTPUT_TOKENS = 16_000

MEASURES = ("latency_ms", "ttft_ms", "input_tokens", "output_tokens")

#: A call as stored. ``raw_metadata`` is JSON text here; see ``sources.tables`` for the variant form.
LOG = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("schema_version", T.IntegerType(), False),
        T.StructField("conversation_id", T.StringType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("provider", T.StringType(), False),
        T.StructField("model", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("streamed", T.BooleanType(), False),
        T.StructField("started_at", T.TimestampType(), False),
        T.StructField("completed_at", T.TimestampType(), False),
        T.StructField("latency_ms", T.IntegerType()),
        T.StructField("ttft_ms", T.IntegerType()),
        T.StructField("input_tokens", T.IntegerType()),
        T.StructField("output_tokens", T.IntegerType()),
        T.StructField("input_preview", T.StringType()),
        T.StructField("output_preview", T.StringType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("finish_reason", T.StringType()),
        T.StructField("raw_metadata", T.VariantType()),
        T.StructField("ingested_at", T.TimestampType()),
    ]
)

#: Columns an event fills; ``ingested_at`` is set on landing.
EVENT_COLUMNS = tuple(f.name for f in LOG.fields if f.name != "ingested_at")

#: Keys an event may have. Any other key makes it invalid.
KNOWN_KEYS = ("event_type", *EVENT_COLUMNS)

ENVELOPE = T.StructType(
    [T.StructField("delivery_id", T.LongType(), False), T.StructField("data", T.StringType())]
)

MESSAGE = T.StructType(
    [
        T.StructField("conversation_id", T.StringType(), False),
        T.StructField("seq", T.IntegerType(), False),
        T.StructField("role", T.StringType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)

CHUNK = T.StructType(
    [
        T.StructField("call_id", T.StringType(), False),
        T.StructField("chunk_no", T.LongType(), False),
        T.StructField("emitted_at", T.TimestampType(), False),
        T.StructField("delta_text", T.StringType(), False),
        T.StructField("input_tokens", T.IntegerType()),
        T.StructField("output_tokens", T.IntegerType()),
        T.StructField("finish_reason", T.StringType()),
        T.StructField("metadata_json", T.StringType()),
    ]
)
