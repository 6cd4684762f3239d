import re

import pytest
from pyspark.sql import functions as F

from callglass.functions import text as X

PATTERNS = [(re.compile(r.pattern, re.IGNORECASE), r.placeholder) for r in X.RULES]


def model(text):
    for pattern, placeholder in PATTERNS:
        text = pattern.sub(placeholder, text)
    return text


CASES = [
    ("my key is sk-abcdefghijklmnop1234", "sk-abcdef", "[REDACTED_API_KEY]"),
    ("Authorization: Bearer abcdefghijklmnop.qrst", "abcdefghijklmnop", "[REDACTED_TOKEN]"),
    ("write to jane.doe@example.co.uk now", "jane.doe", "[REDACTED_EMAIL]"),
    ("iban DE89370400440532013000 ok", "DE8937", "[REDACTED_IBAN]"),
    ("card 4111 1111 1111 1111 end", "4111", "[REDACTED_CARD]"),
    ("ssn 123-45-6789.", "123-45", "[REDACTED_SSN]"),
    ("call +1 (555) 123-4567", "555", "[REDACTED_PHONE]"),
    ("host 192.168.10.20 up", "192.168", "[REDACTED_IP]"),
]
ODD = ["élan@münchen.de x", "٣٤٥-٦٧-٨٩٠١", "bearer abcdefghijklmnopq", "ſk-abcdefghijklmnopqr", "sK-ABCDEFGHIJKLMNOPqrst", ""]


def run(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    return [r[1] for r in df.select("n", column(F.col("t"))).orderBy("n").collect()]


@pytest.mark.parametrize("text, gone, placeholder", CASES)
def test_each_rule(spark, text, gone, placeholder):
    out = run(spark, [text], X.redact)[0]
    assert gone not in out and placeholder in out


def test_names_stay(spark):
    text = "Jane Doe of 12 High Street said 2024 was fine"
    assert run(spark, [text], X.redact) == [text]


def test_hand_made_unicode_matches_the_model(spark):
    assert run(spark, ODD, X.redact) == [model(t) for t in ODD]


def test_whole_documents_match_the_model(given):
    rows = given.table("documents").select("text", X.redact(F.col("text")).alias("r")).collect()
    assert len(rows) == 200 and all(r.r == model(r.text) for r in rows)


def test_preview_cuts_then_redacts(spark):
    edge = "x" * 494 + " a@b.com"
    out = run(spark, ["x" * 900, "x" * 500, None, edge, "é" * 501], X.preview)
    assert out[0] == "x" * 500 + "…" and out[1] == "x" * 500 and out[2] is None
    assert out[3] == model(edge[:500] + "…") and out[4] == "é" * 500 + "…"


def test_off_switch_and_own_rules(spark):
    text = "a@b.com id-77"
    assert run(spark, [text], lambda c: X.redact(c, enabled=False)) == [text]
    own = (X.Rule("ticket", r"id-\d+", "[T]"),)
    assert run(spark, [text], lambda c: X.redact(c, own)) == ["a@b.com [T]"]


def test_rule_hits_follow_the_order(spark, given):
    found = {r.rule: (r.hits, r.texts) for r in X.rule_hits(given.table("documents"), "text").collect()}
    expected = {r.name: [0, 0] for r in X.RULES}
    for (text,) in given.table("documents").select("text").collect():
        for rule, (pattern, placeholder) in zip(X.RULES, PATTERNS):
            text, n = pattern.subn(placeholder, text)
            expected[rule.name][0] += n
            expected[rule.name][1] += n > 0
    assert found == {k: tuple(v) for k, v in expected.items()}


def test_titles(spark):
    texts = ["  hello\nworld  ", "", " \t\n", "y" * 70, "  a\x1c", "a\r\nb"]
    expected = [t.strip().replace("\n", " ")[:60] or "New conversation" for t in texts]
    assert run(spark, texts, X.title) == expected


def test_token_estimates(spark, given):
    texts = ["", "  ", "a b\n c", "a b\x1dc d", *[r.text for r in given.table("documents").select("text").collect()]]
    assert run(spark, texts, X.token_estimate) == [len(t.split()) for t in texts]
