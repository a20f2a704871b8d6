"""Review text expressions (C1–C5, C14): native regex and array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reference thresholds and token budget.
MIN_REVIEW_CHARS = 10
MAX_REVIEW_CHARS = 50_000
MAX_TOKENS = 512
HEAD_TOKENS = 128
TAIL_TOKENS = 382
CLS_ID, SEP_ID, PAD_ID = 101, 102, 0
VOCAB_SPAN, VOCAB_OFFSET = 30000, 1000
PREVIEW_CHARS = 200
# Length bands over estimated tokens (char_length // 4): [lo, hi)
LENGTH_BANDS = [("short", 0, 50), ("medium", 50, 300), ("long", 300, 99999)]


def clean_review_text(text: Column) -> Column:
    """Whitespace collapse, tag strip, ``!!!!`` → ``!!``, non-ASCII → space,
    collapse again; null → "". JVM regex passes, no Python.

    The first collapse changes neither tags nor runs of marks, so it is left to the last pass, which makes
    every run without a character from ``!`` to ``~`` one space and passes over single spaces.
    """
    t = F.coalesce(text.cast("string"), F.lit(""))
    tagless = F.transform(F.array(t), lambda x: F.when(F.contains(x, F.lit("<")), F.regexp_replace(x, r"<[^>]+>", " ")).otherwise(x))
    t = F.regexp_replace(F.element_at(tagless, 1), r"[!?.]{2,}([!?.])", "$1$1")
    return F.trim(F.regexp_replace(t, r"\x20[^\x21-\x7E]++|[^\x20-\x7E][^\x21-\x7E]*+", " "))


def review_invalid_reason(text: Column, rating: Column) -> Column:
    """C2: 'ok' or the first failing rule (length first, then rating)."""
    n = F.length(text)
    return (F.when(text.isNull() | (n < MIN_REVIEW_CHARS),
                   F.concat(F.lit("too short: "), F.coalesce(n, F.lit(0)).cast("string"), F.lit(" chars")))
             .when(n > MAX_REVIEW_CHARS, F.concat(F.lit("too long: "), n.cast("string"), F.lit(" chars")))
             .when(rating.isNull() | ~rating.between(1, 5),
                   F.concat(F.lit("invalid rating: "), F.coalesce(rating.cast("string"), F.lit("null"))))
             .otherwise(F.lit("ok")))


def rating_label(rating: Column) -> Column:
    """1–2 negative, 3 neutral, 4–5 positive (anything else neutral)."""
    return (F.when(rating.isin(1, 2), "negative").when(rating.isin(4, 5), "positive")
             .otherwise("neutral"))


def _word_id(w: Column) -> Column:
    return F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % VOCAB_SPAN + VOCAB_OFFSET


def word_token_ids(text: Column) -> Column:
    """Whitespace words → pseudo token ids in [1000, 31000) from md5 (stable)."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: F.length(w) > 0)
    return F.transform(words, _word_id)


def kept_token_ids(text: Column) -> Column:
    """struct(n, ids): the word count and the ids of only the words head+tail
    truncation keeps (≤ 510) — a 20,000-word text hashes 510 words, not 20,000."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: F.length(w) > 0)
    n = F.size(words)
    kept = F.when(n > MAX_TOKENS - 2, F.concat(F.slice(words, 1, HEAD_TOKENS), F.slice(words, -TAIL_TOKENS, TAIL_TOKENS))) \
            .otherwise(words)
    return F.struct(n.alias("n"), F.transform(kept, _word_id).alias("ids"))


def head_tail_tokens(ids: Column, n: Column | None = None) -> Column:
    """C4: struct(n_tokens, input_ids, attention_mask, truncation_applied).

    ≤ 510 tokens: [CLS] + all + [SEP], padded with 0 to 512 (mask 1s then 0s).
    Longer: [CLS] + first 128 + last 382 + [SEP] (exactly 512, all mask 1).
    ``ids`` may already be reduced to the kept words (``kept_token_ids``); then
    pass the full word count as ``n``.
    """
    n = F.size(ids) if n is None else n
    cls = F.array(F.lit(CLS_ID).cast("bigint"))
    sep = F.array(F.lit(SEP_ID).cast("bigint"))
    trunc = n > (MAX_TOKENS - 2)
    kept = F.when(trunc & (F.size(ids) > MAX_TOKENS - 2),
                  F.concat(F.slice(ids, 1, HEAD_TOKENS), F.slice(ids, -TAIL_TOKENS, TAIL_TOKENS))).otherwise(ids)
    pad = F.greatest(F.lit(MAX_TOKENS) - F.size(kept) - 2, F.lit(0))
    full = F.concat(cls, kept, sep, F.array_repeat(F.lit(PAD_ID).cast("bigint"), pad))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(kept) + 2), F.array_repeat(F.lit(0), pad))
    return F.struct(n.alias("n_tokens"), full.alias("input_ids"), mask.alias("attention_mask"),
                    trunc.alias("truncation_applied"))


def review_preview(text: Column, n: int = PREVIEW_CHARS) -> Column:
    """First 200 characters plus '...' when longer."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def length_band(char_length: Column) -> Column:
    """C14: band of estimated tokens = char_length // 4."""
    est = F.floor(char_length / 4)
    expr = None
    for name, lo, hi in LENGTH_BANDS:
        cond = (est >= lo) & (est < hi)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr


def once(expr: Column) -> Column:
    """Evaluate an expensive expression once per row and expose it as a column.

    Filters on a projected alias are pushed below the projection with the
    expression substituted, so a five-regex cleaning used by a filter and two
    projections would run three times. Exploding a one-element array is a
    ``Generate`` barrier: the value is produced once and later operators read it.
    """
    return F.explode(F.array(expr))
