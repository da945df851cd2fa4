"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressloom.functions.urls import strip

# Words that a headline's tokens leave out.
# fmt: off
STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "for", "with", "from", "into", "that", "this", "its", "it", "of", "to", "in", "on", "at", "by", "as", "is",
    "are", "was", "were", "be", "been", "has", "have", "had", "will", "would", "can", "could", "new", "says", "said", "after", "over", "how", "why",
    "what", "more", "than", "not", "you", "your",
]
# fmt: on


def tidy(c: Column) -> Column:
    """Stripped; null is ''."""
    return strip(F.coalesce(c, F.lit("")))


def body(text: Column, summary: Column) -> Column:
    return F.coalesce(F.when(text != "", text), summary, F.lit(""))


def excerpt(c: Column, limit: int) -> Column:
    """Cut to ``limit`` characters at the last space, with a mark of the full length; whole if short or limit <= 0."""
    if limit <= 0:
        return c
    cut = F.regexp_replace(F.left(c, F.lit(limit)), r"(?s) [^ ]*$", "")
    return F.when(F.length(c) <= limit, c).otherwise(
        F.concat(cut, F.lit(" […truncated from "), F.length(c).cast("string"), F.lit(" chars]"))
    )


def age_days(published: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(published)) / F.lit(86_400_000_000.0)


def spaces_to_one(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s\p{Z}]+", " "))


def first_sentence(c: Column, limit: int = 220) -> Column:
    """Up to the first sentence end within ``limit``; else the whole if short; else cut at a space, with an ellipsis."""
    t = spaces_to_one(c)
    head = F.regexp_extract(F.left(t, F.lit(limit + 80)), r"^(.*?[.!?]) ", 1)
    cut = F.concat(F.regexp_replace(F.left(t, F.lit(limit)), r" [^ ]*$", ""), F.lit("…"))
    return F.when((head != "") & (F.length(head) <= limit), head).when(F.length(t) <= limit, t).otherwise(cut)


def collapse(c: Column) -> Column:
    """Blanks of a line to one, every line stripped, at most one blank line between others."""
    lines = F.transform(F.split(c, "\n", -1), spaces_to_one)
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def title_tokens(title: Column) -> Column:
    """Distinct words of three and more letters or digits, without stopwords."""
    words = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(r"([a-z0-9]+)"), 1)
    long = F.filter(words, lambda w: F.length(w) > 2)
    return F.array_except(F.array_distinct(long), F.array(*map(F.lit, STOPWORDS)))


def similar(a: Column, b: Column) -> Column:
    """Token sets: half of the union shared, or at least 3 and 4/5 of the smaller set. Empty sets are like nothing."""
    both = F.size(F.array_intersect(a, b))
    small, union = F.least(F.size(a), F.size(b)), F.size(F.array_union(a, b))
    close = (2 * both >= union) | ((10 * both >= 8 * small) & (both >= 3))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(False)).otherwise(close)


def week_label(ts: Column) -> Column:
    """ISO week, YYYY-Www."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.extract(F.lit("WEEK"), ts))


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many or one + "s"))


def date_span(start: Column, end: Column) -> Column:
    return F.concat(F.date_format(start, "MMM dd"), F.lit(" – "), F.date_format(end, "MMM dd, yyyy"))


def no_space(c: Column) -> Column:
    """A pasted credential without any white space."""
    return F.regexp_replace(c, r"(?U)[\s\p{Z}]+", "")


def clean_folder(c: Column) -> Column:
    """A mailbox name: stripped, every white-space character a plain space."""
    return F.regexp_replace(strip(c), r"(?U)[\s\p{Z}]", " ")
