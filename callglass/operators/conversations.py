"""Conversations and their messages: order, titles, prompts, deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callglass import schema as S
from callglass.functions import text as X
from callglass.operators.blocks import positions

#: Messages (or arrivals) of one conversation handled by one task at most.
BLOCK = 4096


def transcript(messages: DataFrame, conversation_id: str) -> DataFrame:
    return messages.where(F.col("conversation_id") == conversation_id).orderBy("seq")


def transcripts(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Every conversation with its messages in order, one row per message.

    Rows, not one array per conversation: a conversation may be of any length. The
    sort is range-partitioned on both columns, so a long one spans many tasks.
    """
    kept = conversations.select("conversation_id", "title", "status")
    return messages.join(kept, "conversation_id").orderBy("conversation_id", "seq")


def next_seq(messages: DataFrame) -> DataFrame:
    """The number the next message of each conversation gets."""
    return messages.groupBy("conversation_id").agg((F.max("seq") + 1).alias("next_seq"))


def append(messages: DataFrame, arrivals: DataFrame, order: str = "arrival_no") -> DataFrame:
    """Arrivals as new messages, numbered on from each conversation's last, in arrival order.

    ``order`` is a whole number, unique per conversation.
    """
    numbered = positions(
        arrivals, ["conversation_id"], [F.col(order)], F.floor(F.col(order) / F.lit(BLOCK)), "_position",
        start=next_seq(messages).withColumnRenamed("next_seq", "start"),
    )
    return numbered.withColumn("seq", (F.col("_position") - 1).cast("int")).drop("_position", order)


def summaries(messages: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per conversation: title, status, creation and last activity.

    The title comes from the first user message unless there is one already. It is
    cut before the shuffle, so no message text is moved.
    """
    named = messages.select(
        "conversation_id", "created_at", "seq",
        F.when(F.col("role") == "user", F.struct("seq", X.title(F.col("content")).alias("title"))).alias("_first"),
    )
    seen = named.groupBy("conversation_id").agg(
        F.min("_first")["title"].alias("_title"),
        F.min("created_at").alias("_from"),
        F.max("created_at").alias("_to"),
        F.count(F.lit(1)).alias("messages"),
    )
    if conversations is None:
        return seen.select(
            "conversation_id", F.col("_title").alias("title"), F.lit("active").alias("status"),
            F.col("_from").alias("created_at"), F.col("_to").alias("updated_at"), "messages",
        )
    joined = conversations.join(seen, "conversation_id", "left")
    return joined.select(
        "conversation_id", F.coalesce("title", "_title").alias("title"), "status", "created_at",
        F.greatest("created_at", "updated_at", "_to").alias("updated_at"),
        F.coalesce("messages", F.lit(0)).alias("messages"),
    )


def with_status_changes(conversations: DataFrame, changes: DataFrame) -> DataFrame:
    """Applies ``changes(conversation_id, status, changed_at)``: the latest one stands and counts as activity."""
    last = changes.groupBy("conversation_id").agg(F.max(F.struct("changed_at", "status")).alias("_c"))
    return (
        conversations.join(last, "conversation_id", "left")
        .withColumn("status", F.coalesce("_c.status", "status"))
        .withColumn("updated_at", F.greatest("updated_at", "_c.changed_at"))
        .drop("_c")
    )


def listing(conversation_rows: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Most recently active first, without messages."""
    rows = conversation_rows.select("conversation_id", "title", "status", "created_at", "updated_at")
    return rows.orderBy(F.desc("updated_at"), F.desc("conversation_id")).offset(offset).limit(limit)


def count(conversation_rows: DataFrame) -> DataFrame:
    return conversation_rows.agg(F.count(F.lit(1)).alias("total"))


def delete_messages(messages: DataFrame, deleted: DataFrame) -> DataFrame:
    """Messages that remain once the conversations in ``deleted`` are gone."""
    return messages.join(deleted.select("conversation_id"), "conversation_id", "left_anti")


def detach_logs(calls: DataFrame, deleted: DataFrame) -> DataFrame:
    """Calls survive their conversation; only the references to it become null."""
    gone = deleted.select("conversation_id").distinct().withColumn("_gone", F.lit(True))
    kept = F.col("_gone").isNull()
    return (
        calls.join(gone, "conversation_id", "left")
        .withColumn("message_id", F.when(kept, F.col("message_id")))
        .withColumn("conversation_id", F.when(kept, F.col("conversation_id")))
        .select(*calls.columns)
    )


def logs_of(calls: DataFrame, conversation_id: str) -> DataFrame:
    """Calls of one conversation, oldest first."""
    return calls.where(F.col("conversation_id") == conversation_id).orderBy("started_at", "id")


def logs_by_conversation(calls: DataFrame, conversations: DataFrame) -> DataFrame:
    """Calls of every known conversation, oldest first within each."""
    known = conversations.select("conversation_id")
    return calls.join(known, "conversation_id", "left_semi").orderBy("conversation_id", "started_at", "id")


def prompt_window(
    messages: DataFrame, max_messages: int = S.HISTORY_MESSAGES, max_chars: int = S.HISTORY_CHARS
) -> DataFrame:
    """What the next call of each conversation would be sent.

    The last ``max_messages``, then, newest first, as long as their characters fit
    ``max_chars``; the newest always stays. The rank limit acts before the shuffle,
    so a task sends at most ``max_messages`` rows per conversation.
    """
    newest = W.partitionBy("conversation_id").orderBy(F.desc("seq"))
    tail = messages.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= max_messages)
    used = F.sum(F.length("content")).over(newest.rowsBetween(W.unboundedPreceding, 0))
    return tail.withColumn("_used", used).where((F.col("_rank") == 1) | (F.col("_used") <= max_chars)).drop(
        "_rank", "_used"
    )


def prompt_window_per_turn(
    messages: DataFrame,
    max_messages: int = S.HISTORY_MESSAGES,
    max_chars: int = S.HISTORY_CHARS,
    block: int = BLOCK,
) -> DataFrame:
    """What was sent with every user turn: window size, and the turn and context counts.

    Only lengths are moved, no texts. Each conversation is cut into runs of ``block``
    messages; a run also gets the ``max_messages - 1`` messages before it, so its
    windows are whole and one conversation spreads over many tasks.
    """
    block = max(block, max_messages)
    slim = messages.select("conversation_id", "seq", "role", F.length("content").alias("chars"))
    placed = positions(slim, ["conversation_id"], [F.col("seq")], F.floor(F.col("seq") / F.lit(block)), "_pos")
    own = F.floor((F.col("_pos") - 1) / F.lit(block))
    carried = (F.col("_pos") - 1) % block >= block - (max_messages - 1)
    runs = placed.withColumn("_own", own).withColumn(
        "_run", F.explode(F.when(carried, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own")))
    )
    frame = (
        W.partitionBy("conversation_id", "_run").orderBy("_pos").rowsBetween(-(max_messages - 1), 0)
    )
    sent = F.collect_list(F.struct("seq", "role", "chars")).over(frame)
    start = F.struct(
        F.lit(0).alias("n"), F.lit(0).cast("long").alias("chars"), F.lit(0).alias("users"),
        F.lit(0).alias("first_seq"), F.lit(True).alias("open"),
    )

    def take(acc: Column, m: Column) -> Column:
        fits = acc["open"] & ((acc["n"] == 0) | (acc["chars"] + m["chars"] <= max_chars))
        return F.struct(
            (acc["n"] + fits.cast("int")).alias("n"),
            F.when(fits, acc["chars"] + m["chars"]).otherwise(acc["chars"]).alias("chars"),
            (acc["users"] + (fits & (m["role"] == "user")).cast("int")).alias("users"),
            F.when(fits, m["seq"]).otherwise(acc["first_seq"]).alias("first_seq"),
            fits.alias("open"),
        )

    turns = runs.withColumn("_sent", sent).where((F.col("role") == "user") & (F.col("_run") == F.col("_own")))
    kept = F.aggregate(F.reverse("_sent"), start, take)
    return turns.withColumn("_kept", kept).select(
        "conversation_id", "seq",
        F.col("_kept.n").alias("sent_messages"),
        F.col("_kept.chars").alias("sent_chars"),
        F.col("_kept.first_seq").alias("first_seq"),
        F.col("_kept.users").alias("user_turns"),
        F.greatest(F.col("_kept.n") - 1, F.lit(0)).alias("prior_messages"),
    )


def latest_user_text(window: DataFrame) -> DataFrame:
    """Newest user message of each prompt window; null when it holds none."""
    last = F.max(F.when(F.col("role") == "user", F.struct("seq", "content")))
    return window.groupBy("conversation_id").agg(last["content"].alias("latest_user_text"))


def assemble_prompts(window: DataFrame, system: Column | None = None, hoist_system: bool = True) -> DataFrame:
    """Prompt windows as requests: a system text and the turns in order.

    With ``hoist_system`` system messages leave the turns and join the system text,
    one blank line between; otherwise they stay in place and a given system text
    comes first. A window has at most the window's number of messages, so the lists are short.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "role", "content")))
    grouped = window.groupBy("conversation_id").agg(ordered.alias("_m"))
    turn = lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))
    given = F.lit(None).cast("string") if system is None else F.when(system != "", system)
    if hoist_system:
        parts = F.transform(F.filter("_m", lambda m: m["role"] == "system"), lambda m: m["content"])
        joined = F.array_join(F.concat(F.array_compact(F.array(given)), parts), "\n\n")
        return grouped.select(
            "conversation_id",
            F.when(joined != "", joined).alias("system"),
            F.transform(F.filter("_m", lambda m: m["role"] != "system"), turn).alias("turns"),
        )
    first = F.when(given.isNotNull(), F.array(F.struct(F.lit("system").alias("role"), given.alias("content"))))
    turns = F.transform("_m", turn)
    return grouped.select(
        "conversation_id", F.lit(None).cast("string").alias("system"),
        F.when(first.isNull(), turns).otherwise(F.concat(first, turns)).alias("turns"),
    )


def input_estimates(window: DataFrame) -> DataFrame:
    """Estimated input tokens of each prompt window."""
    return window.groupBy("conversation_id").agg(F.sum(X.token_estimate(F.col("content"))).alias("input_tokens"))
