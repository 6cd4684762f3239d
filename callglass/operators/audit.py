"""Checks a database would enforce, run over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callglass import schema as S

#: Rule name to the SQL condition that breaks it.
Rules = dict[str, str]


def one_of(column: str, values: tuple[str, ...]) -> str:
    return f"{column} not in ({', '.join(repr(v) for v in values)})"


CALL_RULES: Rules = {
    **{f"{m}_non_negative": f"{m} < 0" for m in S.MEASURES},
    "completed_after_started": "completed_at < started_at",
    "status_domain": one_of("status", S.CALL_STATUSES),
    **{
        f"{c}_not_null": f"{c} is null"
        for c in ("id", "schema_version", "provider", "model", "status", "streamed", "started_at", "completed_at",
                  "ingested_at")
    },
    "provider_length": f"length(provider) > {S.MAX_PROVIDER_CHARS}",
    "model_length": f"length(model) > {S.MAX_MODEL_CHARS}",
    "error_type_length": f"length(error_type) > {S.MAX_ERROR_TYPE_CHARS}",
    "finish_reason_length": f"length(finish_reason) > {S.MAX_FINISH_REASON_CHARS}",
}

MESSAGE_RULES: Rules = {
    "role_domain": one_of("role", S.ROLES),
    "content_length": f"length(content) not between 1 and {S.MAX_MESSAGE_CHARS}",
    "conversation_id_not_null": "conversation_id is null",
    "seq_not_null": "seq is null",
    "content_not_null": "content is null",
    "role_not_null": "role is null",
    "created_at_not_null": "created_at is null",
}

CONVERSATION_RULES: Rules = {
    "status_domain": one_of("status", S.CONVERSATION_STATUSES),
    **{f"{c}_not_null": f"{c} is null" for c in ("conversation_id", "status", "created_at", "updated_at")},
    "updated_after_created": "updated_at < created_at",
}

RAW_RULES: Rules = {
    "processing_status_domain": one_of("processing_status", S.PROCESSING_STATUSES),
    "event_type_length": f"length(event_type) > {S.MAX_EVENT_TYPE_CHARS}",
    **{f"{c}_not_null": f"{c} is null" for c in ("id", "event_type", "payload", "processing_status")},
    "failed_has_error": "processing_status = 'failed' and processing_error is null",
    "processed_has_no_error": "processing_status = 'processed' and processing_error is not null",
}

DEAD_LETTER_RULES: Rules = {
    "reason_domain": one_of("reason", (S.REASON_MALFORMED, S.REASON_NO_ID, S.REASON_INVALID)),
    "reason_not_null": "reason is null",
    "delivery_id_not_null": "delivery_id is null",
}


def violations(rows: DataFrame, rules: Rules) -> DataFrame:
    """How many rows break each rule, in one scan."""
    counted = rows.agg(*[F.count_if(F.expr(condition)).alias(name) for name, condition in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return counted.select(F.inline(pairs))


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")


def dangling(rows: DataFrame, reference: str, target: DataFrame, key: str) -> DataFrame:
    """Referenced values that the target lacks, with the number of rows that refer to them.

    Rows are counted per value first, so a value in very many rows is one row in the join.
    """
    used = rows.where(F.col(reference).isNotNull()).groupBy(reference).agg(F.count(F.lit(1)).alias("rows"))
    known = target.select(F.col(key).alias(reference))
    return used.join(known, reference, "left_anti")
