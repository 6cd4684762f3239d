"""Text columns: redaction, previews, titles, token estimates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callglass import schema as S


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    placeholder: str


# The redaction patterns, in the order they apply.
RULES = (
    Rule("api_key", r"\b(?:sk|pk|rk)-[A-Za-z0-9_\-]{16,}\b", "[REDACTED_API_KEY]"),
    Rule("bearer_token", r"\bBearer\s+[A-Za-z0-9._\-]{16,}\b", "[REDACTED_TOKEN]"),
    Rule("email", r"\b[\w.%+\-]+@[\w.\-]+\.[A-Za-z]{2,}\b", "[REDACTED_EMAIL]"),
    Rule("iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b", "[REDACTED_IBAN]"),
    Rule("credit_card", r"\b(?:\d[ \-]?){13,19}\b", "[REDACTED_CARD]"),
    Rule("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]"),
    Rule(
        "phone",
        r"(?:\+\d{1,3}[ \-.]?)?(?:\(\d{2,4}\)[ \-.]?|\d{2,4}[ \-.])\d{3,4}[ \-.]?\d{3,4}\b",
        "[REDACTED_PHONE]",
    ),
    Rule("ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[REDACTED_IP]"),
)

#: Case-insensitive with Unicode classes.
_FLAGS = "(?iU)"

#: White space at both ends, by the Unicode notion plus the four separator controls.
_ENDS = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def redact(text: Column, rules: tuple[Rule, ...] = RULES, enabled: bool = True) -> Column:
    """Replace every match of each rule, one rule after the other."""
    if enabled:
        for rule in rules:
            text = F.regexp_replace(text, F.lit(_FLAGS + rule.pattern), F.lit(rule.placeholder))
    return text


def preview(
    text: Column,
    max_chars: int = S.PREVIEW_CHARS,
    rules: tuple[Rule, ...] = RULES,
    enabled: bool = True,
) -> Column:
    """The stored form of a text: cut first, marked when cut, then redacted. Null stays null."""
    cut = F.when(
        F.length(text) > max_chars, F.concat(F.substring(text, 1, max_chars), F.lit("…"))
    ).otherwise(text)
    return redact(cut, rules, enabled)


def rule_hits(
    df: DataFrame, text: str, rules: tuple[Rule, ...] = RULES, keys: tuple[str, ...] = ()
) -> DataFrame:
    """How often each rule fires, with every rule seeing what the earlier ones left.

    One projection per rule keeps each intermediate text computed once; the counts
    are summed map-side, so only one row per key and task is shuffled.
    """
    df = df.select(*keys, F.col(text).alias("_text"))
    for i, rule in enumerate(rules):
        pattern = F.lit(_FLAGS + rule.pattern)
        df = df.withColumn(f"_n{i}", F.regexp_count("_text", pattern)).withColumn(
            "_text", F.regexp_replace("_text", pattern, F.lit(rule.placeholder))
        )
    sums = df.groupBy(*keys).agg(
        *[F.coalesce(F.sum(f"_n{i}"), F.lit(0)).alias(f"_s{i}") for i in range(len(rules))],
        *[F.count_if(F.col(f"_n{i}") > 0).alias(f"_t{i}") for i in range(len(rules))],
    )
    pairs = F.array(
        *[
            F.struct(F.lit(r.name).alias("rule"), F.col(f"_s{i}").alias("hits"), F.col(f"_t{i}").alias("texts"))
            for i, r in enumerate(rules)
        ]
    )
    return sums.select(*keys, F.inline(pairs))


def strip(text: Column) -> Column:
    """Without white space at both ends (``trim`` drops blanks only)."""
    return F.regexp_replace(text, F.lit(_ENDS), F.lit(""))


def title(text: Column, max_chars: int = S.TITLE_CHARS) -> Column:
    """Stripped, on one line, cut; a fixed title when nothing is left."""
    line = F.substring(F.translate(strip(text), "\n", " "), 1, max_chars)
    return F.when(F.length(line) > 0, line).otherwise(F.lit(S.DEFAULT_TITLE))


def token_estimate(text: Column) -> Column:
    """Number of words between white space."""
    parts = F.split(text, r"(?U)[\s\x1c-\x1f]+")
    return F.size(F.filter(parts, lambda w: w != ""))
