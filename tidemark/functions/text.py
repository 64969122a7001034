"""Text columns: tokens, size estimates, cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a word and as a run of Chinese characters.
WORD_PATTERN = "[a-z0-9_]+|[\\u4e00-\\u9fff]+"
CHINESE_RUN = "^[\\u4e00-\\u9fff]+$"


def tokens(text: Column) -> Column:
    """Lower-case words and Chinese runs; a Chinese run also yields its character pairs."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({WORD_PATTERN})"), F.lit(1))
    plain = F.coalesce(words, F.array().cast("array<string>"))

    def with_pairs(word: Column) -> Column:
        pairs = F.transform(
            F.sequence(F.lit(1), F.length(word) - 1), lambda at: F.substring(word, at, F.lit(2))
        )
        chinese_run = word.rlike(CHINESE_RUN) & (F.length(word) > 1)
        return F.when(chinese_run, F.concat(F.array(word), pairs)).otherwise(F.array(word))

    has_chinese = text.rlike("[\\u4e00-\\u9fff]")
    return F.when(has_chinese, F.flatten(F.transform(plain, with_pairs))).otherwise(plain)


def token_estimate(text: Column) -> Column:
    """One token per non-ASCII character plus one per started group of four ASCII characters."""
    body = F.coalesce(text, F.lit(""))
    ascii_only = F.length(F.regexp_replace(body, "[^\\x00-\\x7F]", ""))
    return F.length(body) - ascii_only + F.floor((ascii_only + 3) / 4).cast("int")


def excerpt(text: Column, size: int) -> Column:
    return F.left(F.coalesce(text, F.lit("")), F.lit(size))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def content_hash(*parts: Column) -> Column:
    """First 16 hex digits of a SHA-256 over the parts as JSON."""
    record = F.struct(*[part.alias(f"p{at}") for at, part in enumerate(parts)])
    return F.left(F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256), F.lit(16))
