from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from callglass.operators import catalog, conversations as C, correlate
from callglass.operators.blocks import last_before, positions

T0 = datetime(2024, 1, 1)
MESSAGE = "conversation_id string, seq int, role string, content string, created_at timestamp"


def messages(spark, *rows):
    return spark.createDataFrame([(c, s, r, t, T0 + timedelta(seconds=s)) for c, s, r, t in rows], MESSAGE)


def window_model(history, max_messages, max_chars):
    """Longest tail within both bounds; the last message always."""
    best = history[-1:]
    for n in range(2, min(max_messages, len(history)) + 1):
        tail = history[-n:]
        if sum(len(m.content) for m in tail) > max_chars:
            break
        best = tail
    return best


def by_conversation(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.conversation_id, r.seq)):
        out.setdefault(r.conversation_id, []).append(r)
    return out


@pytest.mark.parametrize("m, c", [(4, 1000), (1, 10), (20, 12_000), (3, 0)])
def test_prompt_window_matches_the_model(given, m, c):
    history = by_conversation(given.messages.collect())
    got = by_conversation(C.prompt_window(given.messages, m, c).collect())
    assert got == {k: window_model(v, m, c) for k, v in history.items()}


@pytest.mark.parametrize("m, c, block", [(4, 1000, 4), (4, 1000, 4096), (2, 50, 3), (6, 100_000, 7)])
def test_window_of_every_turn_matches_the_model(given, m, c, block):
    history = by_conversation(given.messages.collect())
    expected = {}
    for key, rows in history.items():
        for i, r in enumerate(rows):
            if r.role == "user":
                w = window_model(rows[: i + 1], m, c)
                expected[key, r.seq] = (len(w), sum(len(x.content) for x in w), w[0].seq,
                                        sum(x.role == "user" for x in w), len(w) - 1)
    got = C.prompt_window_per_turn(given.messages, m, c, block).collect()
    assert {(r.conversation_id, r.seq): tuple(r)[2:] for r in got} == expected


def test_turn_windows_of_one_long_conversation_with_gaps(spark):
    rows = spark.range(2000).select(
        F.lit("hot").alias("conversation_id"), (F.col("id") * 3 + F.col("id") % 2).cast("int").alias("seq"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.repeat(F.lit("x"), (F.col("id") * 37 % 60).cast("int")).alias("content"),
        F.lit(T0).alias("created_at"),
    )
    plain = C.prompt_window_per_turn(rows, 5, 100, 100_000)
    assert C.prompt_window_per_turn(rows, 5, 100, 16).exceptAll(plain).count() == 0 and plain.count() == 1000


def test_budget_keeps_two_and_the_newest_always(spark):
    df = messages(spark, *[("a", i, "user", "x" * 400) for i in range(5)], ("b", 0, "user", "y" * 5000))
    assert sorted((r.conversation_id, r.seq) for r in C.prompt_window(df, 20, 1000).collect()) == [("a", 3), ("a", 4), ("b", 0)]


def test_append_numbers_without_gaps(spark):
    df = messages(spark, ("a", 0, "user", "x"), ("a", 1, "assistant", "y"))
    arrivals = spark.createDataFrame([("a", 10_000, "p"), ("a", 5, "q"), ("b", 7, "r"), ("b", 9_999, "s")],
                                     "conversation_id string, arrival_no long, content string")
    got = {r.content: (r.conversation_id, r.seq) for r in C.append(df, arrivals).collect()}
    assert got == {"q": ("a", 2), "p": ("a", 3), "r": ("b", 0), "s": ("b", 1)}
    assert {r.conversation_id: r.next_seq for r in C.next_seq(df).collect()} == {"a": 2}


def test_first_title_wins_and_activity_counts(spark):
    df = messages(spark, ("a", 0, "system", "s"), ("a", 1, "user", " one\ntwo "), ("a", 2, "user", "later"), ("b", 0, "user", "  "))
    rows = spark.createDataFrame([("a", None, "active", T0, T0), ("b", "kept", "archived", T0, T0), ("c", None, "active", T0, T0)],
                                 "conversation_id string, title string, status string, created_at timestamp, updated_at timestamp")
    got = {r.conversation_id: (r.title, r.status, r.updated_at, r.messages) for r in C.summaries(df, rows).collect()}
    assert got == {"a": ("one two", "active", T0 + timedelta(seconds=2), 3), "b": ("kept", "archived", T0, 1),
                   "c": (None, "active", T0, 0)}
    listed = C.listing(C.summaries(df, rows), 2, 1).collect()
    assert [r.conversation_id for r in listed] == ["c", "b"]


def test_delete_drops_messages_and_keeps_calls(spark, given):
    gone = given.logs.where("conversation_id is not null").select("conversation_id").limit(1)
    name = gone.first()[0]
    gone = given.logs.sparkSession.createDataFrame([(name,), (name,)], "conversation_id string")
    kept = C.detach_logs(given.logs, gone)
    assert kept.count() == given.logs.count()
    assert kept.where(F.col("conversation_id") == name).count() == 0
    assert C.delete_messages(given.messages, gone).where(F.col("conversation_id") == name).count() == 0


def test_prompts(spark):
    df = messages(spark, ("a", 0, "system", "s1"), ("a", 1, "user", "u1"), ("a", 2, "system", "s2"), ("a", 3, "assistant", "r"))
    turns = [("user", "u1"), ("assistant", "r")]
    one = C.assemble_prompts(df, F.lit("top")).first()
    assert one.system == "top\n\ns1\n\ns2" and [tuple(t) for t in one.turns] == turns
    assert C.assemble_prompts(df.where("role <> 'system'"), F.lit("")).first().system is None
    inline = C.assemble_prompts(df, F.lit("top"), hoist_system=False).first()
    assert inline.system is None
    assert [tuple(t) for t in inline.turns] == [("system", "top"), ("system", "s1"), ("user", "u1"), ("system", "s2"), ("assistant", "r")]
    assert C.latest_user_text(df).first().latest_user_text == "u1"
    assert C.latest_user_text(df.where("role <> 'user'")).first().latest_user_text is None


def test_positions_equal_a_plain_row_number(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 11).cast("string")).alias("key"),
        (F.col("id") * 7919 % 100_003).alias("n"))
    got = positions(rows, ["key"], [F.col("n")], F.floor(F.col("n") / 512))
    back = positions(rows, ["key"], [F.col("n").desc()], F.floor(F.col("n") / 512), "back", True)
    from pyspark.sql import Window as W
    plain = rows.withColumn("position", F.row_number().over(W.partitionBy("key").orderBy("n")).cast("long"))
    reverse = rows.withColumn("back", F.row_number().over(W.partitionBy("key").orderBy(F.desc("n"))).cast("long"))
    assert got.select("key", "n", "position").exceptAll(plain).count() == 0 and got.count() == 3000
    assert back.select("key", "n", "back").exceptAll(reverse).count() == 0


def test_last_before_crosses_empty_blocks(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, None), ("k", 900, None), ("k", 901, "b"), ("k", 5000, None), ("j", 3, None)],
                                 "key string, n int, v string")
    got = last_before(rows, ["key"], ["n"], "v", F.floor(F.col("n") / 10), "found")
    assert {(r.key, r.n): r.found for r in got.collect()} == {
        ("k", 1): "a", ("k", 2): "a", ("k", 900): "a", ("k", 901): "b", ("k", 5000): "b", ("j", 3): None}


def test_replies_find_their_call(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    calls = spark.createDataFrame(
        [("c", "1", at(0), at(10)), ("c", "2", at(100), at(110)), ("c", "3", at(105), at(120)), ("c", "4", at(9000), at(9001)),
         (None, "5", at(0), at(1)), ("d", "6", at(0), at(1))],
        "conversation_id string, id string, started_at timestamp, completed_at timestamp")
    replies = spark.createDataFrame(
        [("c", "early", at(5)), ("c", "r1", at(10)), ("c", "during", at(115)), ("c", "x", at(121)), ("c", "y", at(7000)), ("d", "late", at(8000))],
        "conversation_id string, reply_id string, created_at timestamp")
    for block in ("minute", "hour", "day"):
        got = {r.id: (r.reply_id, r.candidate_replies) for r in correlate.replies_to_calls(calls, replies, block).collect()}
        assert got == {"1": ("r1", 1), "2": (None, 0), "3": (None, 2), "4": (None, 0), "5": (None, 0), "6": ("late", 1)}


def test_caps_and_models(spark):
    known = catalog.default_catalog(spark, ("mock", "groq"))
    asked = spark.createDataFrame([("1", None, None), ("2", "groq", ""), ("3", "mock", "llama3.2"), ("4", "openai", "gpt-4o"), ("5", "groq", "any")],
                                  "id string, provider string, model string")
    got = {r.id: (r.resolved_provider, r.resolved_model, r.problem) for r in catalog.resolve_models(asked, known).collect()}
    assert got == {"1": ("mock", "mock", None), "2": ("groq", "openai/gpt-oss-20b", None),
                   "3": ("mock", "llama3.2", "model_not_supported"), "4": ("openai", None, "provider_not_configured"),
                   "5": ("groq", "any", None)}
    budget = spark.createDataFrame([("groq", 9000), ("groq", 100), ("mock", 9000), ("groq", None)], "provider string, requested_tokens int")
    assert [r.granted_tokens for r in catalog.clamp_budgets(budget, known).orderBy("provider", F.desc("requested_tokens")).collect()] == [4096, 100, 4096, 9000]
    assert catalog.default_provider(known, "openai") == "mock" and catalog.default_provider(known, "groq") == "groq"
