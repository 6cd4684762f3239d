"""The event of a finished call: fold, outcome, latest user text and previews, put together as one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callglass import schema as S
from callglass.functions import text as X
from callglass.functions.measures import classify_end
from callglass.operators.blocks import last_before

#: Message numbers in a block when looking for the latest user text.
BLOCK = 1_024


def asked_before(calls: DataFrame, messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """``call_id`` and ``said``: the newest user message before each call's turn; null when there is none.

    Only message numbers are carried along a conversation; the text is joined at the end.
    """
    none = F.lit(None).cast("int")
    users = messages.where(F.col("role") == "user")
    line = users.select("conversation_id", "seq", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("call_id"), F.col("seq").alias("asked"))
    line = line.unionByName(calls.select("conversation_id", F.col("turn").cast("int").alias("seq"), F.lit(0).alias("kind"), "call_id", none.alias("asked")))
    found = last_before(line, ["conversation_id"], ["seq", "kind"], "asked", F.floor(F.col("seq") / F.lit(block)), "latest")
    found = found.where("kind = 0").select("call_id", "conversation_id", F.col("latest").alias("seq"))
    return found.join(users.select("conversation_id", "seq", F.col("content").alias("said")), ["conversation_id", "seq"], "left").select("call_id", "said")


def finished_events(finished: DataFrame, messages: DataFrame, rules: tuple = X.RULES, redacted: bool = True) -> DataFrame:
    """One event per finished call, in the columns of the contract.

    ``finished`` are folded calls (``chunks.finish``) with ``id``, ``provider``, ``model``,
    and of failures ``vendor_error``, ``error_class`` and ``message``. Previews are cut and
    redacted here, so that no plain text leaves with an event. ``message_id`` stays null:
    the reply is written after its event. Metadata without an entry is null.
    """
    rows = finished.join(asked_before(finished, messages), "call_id", "left")
    rows = rows.select("*", F.inline(F.array(classify_end("end_kind", "vendor_error", "error_class", "message"))))
    metadata = F.when(F.col("metadata_json") != "{}", F.try_parse_json("metadata_json"))
    values = {
        "schema_version": F.lit(S.SCHEMA_VERSION), "message_id": F.lit(None).cast("string"), "completed_at": F.col("ended_at"),
        "input_preview": X.preview(F.col("said"), rules=rules, enabled=redacted),
        "output_preview": X.preview(F.col("text"), rules=rules, enabled=redacted), "raw_metadata": metadata,
    }
    return rows.select(*[values.get(c, F.col(c)).alias(c) for c in S.EVENT_COLUMNS])
