"""Text expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell import rules as R


def symbol_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, R.SYMBOL_CHARS, ""))


def token_estimate(text: Column) -> Column:
    """Characters over 3.2 for symbol-heavy text, over 4 for prose; empty text has none."""
    t = F.coalesce(text, F.lit(""))
    head = F.substring(t, 1, R.SYMBOL_SAMPLE_CHARS)
    dense = symbol_count(head) / F.length(head) > R.SYMBOL_SHARE
    ratio = F.when(dense, R.CHARS_PER_TOKEN_CODE).otherwise(R.CHARS_PER_TOKEN_PROSE)
    return F.when(F.length(t) == 0, 0).otherwise(F.ceil(F.length(t) / ratio)).cast("bigint")


def removed_tokens(chars: Column) -> Column:
    return F.round(chars / R.CHARS_PER_REMOVED_TOKEN).cast("bigint")


def image_tokens(width: Column, height: Column) -> Column:
    """Tokens of an image after the client's downscale."""
    w, h = width.cast("double"), height.cast("double")
    shrink = F.least(F.lit(1.0), R.IMAGE_MAX_EDGE / F.greatest(w, h), F.sqrt(R.IMAGE_MAX_PIXELS / (w * h)))
    tokens = F.floor((w * shrink) * (h * shrink) / R.IMAGE_PIXELS_PER_TOKEN + 0.5)
    known = (w > 0) & (h > 0)
    return F.when(known, F.greatest(F.lit(R.IMAGE_MIN_TOKENS), tokens)).otherwise(R.IMAGE_UNKNOWN_TOKENS).cast("bigint")


def words(text: Column) -> Column:
    """Distinct lower-case words of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))


def contains_any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def squash(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")
