"""One batch of deliveries, split into what each table receives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callglass import schema as S
from callglass.operators import contract


def first_per_id(rows: DataFrame, order: str = "delivery_id", key: str = "id") -> DataFrame:
    """The earliest row per id.

    The rank filter is applied before the shuffle as well, so an id delivered very
    often sends one row per task.
    """
    rank = F.row_number().over(W.partitionBy(key).orderBy(order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def already_stored(stored: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Which of ``ids`` the target holds; reads only its key column."""
    return stored.select(key).join(ids.select(key), key, "left_semi").distinct()


def stored_ids(raw: DataFrame, logs: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Which of ``ids`` the two targets hold: ``in_raw`` and ``in_logs``, reading each key column once."""
    both = raw.select(key, F.lit(True).alias("in_raw")).union(logs.select(key, F.lit(False)))
    found = both.join(ids.select(key), key, "left_semi")
    return found.groupBy(key).agg(F.bool_or("in_raw").alias("in_raw"), F.bool_or(~F.col("in_raw")).alias("in_logs"))


def not_stored(rows: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(found.select(key), key, "left_anti")


def check(envelopes: DataFrame) -> DataFrame:
    """Decoded and validated deliveries with their reason for rejection."""
    checked = contract.validate(contract.decode(envelopes))
    return checked.withColumn("reason", contract.reject_reason())


def judged(checked: DataFrame) -> DataFrame:
    """A checked delivery without its parsed document, and with its event only if that is valid: what a batch keeps."""
    return checked.select(
        "delivery_id", "data", "id", F.when(F.col("id").isNotNull(), contract.event_type()).alias("event_type"),
        F.when(F.col("reason").isNull(), F.col("event")).alias("event"), "problems", "reason",
    )


def raw_rows(checked: DataFrame) -> DataFrame:
    """Raw landing: first payload per usable id, before any judgement on it."""
    kind = F.col("event_type") if "event_type" in checked.columns else contract.event_type()
    usable = checked.where(F.col("id").isNotNull()).select(
        "id", "delivery_id", kind.alias("event_type"), F.col("data").alias("payload")
    )
    return first_per_id(usable)


def log_rows(checked: DataFrame) -> DataFrame:
    """First valid event per id."""
    return first_per_id(contract.to_rows(checked, "delivery_id"))


def attempts(checked: DataFrame) -> DataFrame:
    """One row per delivery with a usable id: what became of it."""
    ok = F.col("reason").isNull()
    error = F.substring(F.array_join("problems", "; "), 1, S.MAX_PROCESSING_ERROR_CHARS)
    return checked.where(F.col("id").isNotNull()).select(
        "id", "delivery_id",
        F.when(ok, "processed").otherwise("failed").alias("processing_status"),
        F.when(~ok, error).alias("processing_error"),
    )


def dead_letters(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reason").isNotNull()).select("delivery_id", "data", "reason")


def outcome_counts(checked: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Counters of a batch. Malformed deliveries never count as received.

    Counted per id first (combining map-side), then summed: of the valid deliveries
    of an id, one is inserted unless the id is ``known``, the others are duplicates.
    """
    reason = F.col("reason")
    received = F.coalesce(reason != S.REASON_MALFORMED, F.lit(True))
    per_id = checked.groupBy("id").agg(
        F.count_if(received).alias("received"),
        F.count_if(reason.isNull()).alias("valid"),
        F.count_if(received & reason.isNotNull()).alias("rejected"),
    )
    new = F.col("valid") > 0
    if known is not None:
        per_id = per_id.join(known.select("id", F.lit(True).alias("_known")), "id", "left")
        new = new & F.col("_known").isNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per_id.agg(
        total("received").alias("received"), F.count_if(new).alias("inserted"),
        (total("valid") - F.count_if(new)).alias("duplicates"), total("rejected").alias("rejected"),
    )


def state_of(checked: DataFrame) -> DataFrame:
    """Raw rows of one batch with their state, in one pass and one shuffle."""
    tried = checked.where(F.col("id").isNotNull()).withColumn("_ok", F.col("reason").isNull())
    error = F.substring(F.array_join("problems", "; "), 1, S.MAX_PROCESSING_ERROR_CHARS)
    first = F.struct("delivery_id", contract.event_type().alias("event_type"), F.col("data").alias("payload"))
    last = F.struct("delivery_id", "_ok", F.when(~F.col("_ok"), error).alias("error"))
    grouped = tried.select("id", first.alias("_first"), last.alias("_last")).groupBy("id").agg(
        F.min("_first").alias("_first"), F.max("_last").alias("_last")
    )
    return grouped.select(
        "id", "_first.*",
        F.when(F.col("_last._ok"), "processed").otherwise("failed").alias("processing_status"),
        F.col("_last.error").alias("processing_error"),
    )


def latest_attempt(attempt_rows: DataFrame, order: list[str]) -> DataFrame:
    """Status and time of the last attempt per id; a success clears the error. Combines map-side."""
    told = [c for c in ("processing_status", "processing_error", "processed_at") if c in attempt_rows.columns]
    last = F.max(F.struct(*order, *[c for c in told if c not in order])).alias("_last")
    return attempt_rows.groupBy("id").agg(last).select("id", *[F.col(f"_last.{c}") for c in told])


def raw_state(raw: DataFrame, attempt_rows: DataFrame, order: list[str]) -> DataFrame:
    """Raw events with their current processing state; no attempt yet is ``pending``."""
    joined = raw.join(latest_attempt(attempt_rows, order), "id", "left")
    return joined.withColumn("processing_status", F.coalesce("processing_status", F.lit("pending")))


@dataclass(frozen=True)
class Landing:
    """What one batch adds to an empty target."""

    raw: DataFrame
    logs: DataFrame
    attempts: DataFrame
    dead_letters: DataFrame
    outcomes: DataFrame


def land(checked: DataFrame, known_raw: DataFrame | None = None, known_logs: DataFrame | None = None) -> Landing:
    """Split a checked batch. ``known_*`` are ids of this batch already stored (see ``already_stored``)."""
    raw, logs = raw_rows(checked), log_rows(checked)
    if known_raw is not None:
        raw = not_stored(raw, known_raw)
    if known_logs is not None:
        logs = not_stored(logs, known_logs)
    return Landing(raw, logs, attempts(checked), dead_letters(checked), outcome_counts(checked, known_logs))


def replay(failed: DataFrame, repair=None, check_with=check) -> DataFrame:
    """Failed raw events as deliveries again, repaired and judged anew.

    ``repair`` maps the payload column to its corrected form; ``check_with`` is the
    (fixed) contract. The result lands like any batch, so nothing is written twice.
    """
    payload = F.col("payload") if repair is None else repair(F.col("payload"))
    return check_with(failed.select("delivery_id", payload.alias("data")))
