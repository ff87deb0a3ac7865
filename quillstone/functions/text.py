"""Text normalisation, tokens and assembly of a book's texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that normalisation keeps (Chinese, Latin letters, digits), and with all letters.
KEPT = "[^一-龥a-zA-Z0-9\\s]"
KEPT_ALL = r"[^\p{L}\p{N}\s]"


def normalise(text: Column, every_script: bool = False) -> Column:
    """Other characters as spaces, white space collapsed and trimmed, case kept; null gives ''."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), KEPT_ALL if every_script else KEPT, " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def normalise_lower(text: Column, every_script: bool = False) -> Column:
    return F.lower(normalise(text, every_script))


def tokens(text: Column) -> Column:
    """Words of Latin letters and digits, and two-character pieces of Chinese runs (a run of one stays);
    lower case, in order of appearance within their kind."""
    plain = normalise_lower(text)
    words = F.regexp_extract_all(plain, F.lit("([a-z0-9]+)"), F.lit(1))
    runs = F.regexp_extract_all(plain, F.lit("([一-龥]+)"), F.lit(1))
    pieces = F.flatten(
        F.transform(
            runs,
            lambda r: F.when(F.length(r) < 3, F.array(r)).otherwise(
                F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))
            ),
        )
    )
    return F.concat(words, pieces)


_KEPT, _WORDS, _RUNS = re.compile(KEPT, re.ASCII), re.compile("[a-z0-9]+"), re.compile("[一-龥]+")


def split_tokens(text: str | None) -> list[str]:
    """The same tokens for code that already runs in Python."""
    plain = _KEPT.sub(" ", text or "").lower()
    pieces = (r if len(r) < 3 else [r[i : i + 2] for i in range(len(r) - 1)] for r in _RUNS.findall(plain))
    return _WORDS.findall(plain) + [p for r in pieces for p in ([r] if isinstance(r, str) else r)]


def is_term(word: Column) -> Column:
    """At least two characters and not all digits."""
    return (F.length(word) > 1) & ~word.rlike("^[0-9]+$")


def clean_terms(words: Column, stop_words: Column | None = None) -> Column:
    """Stripped terms without short, numeric and stop words, the first of equal ones kept."""
    kept = F.filter(F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.trim(w)), lambda w: w.isNotNull() & is_term(w))
    kept = F.array_distinct(kept)
    return kept if stop_words is None else F.filter(kept, lambda w: ~F.array_contains(stop_words, F.lower(w)) & ~F.array_contains(stop_words, w))


def _texts(column: str, first: int | None) -> Column:
    """Texts of a list column, stripped and without blanks; the cut comes before blanks go."""
    items = F.coalesce(F.col(column), F.array().cast("array<string>"))
    items = items if first is None else F.slice(items, 1, first)
    return F.array_join(F.filter(F.transform(items, lambda t: F.trim(t)), lambda t: F.length(t) > 0), " ")


def keyword_text(intro: str = "book_intro") -> Column:
    """Title twice, intros, the first five short reviews and three reviews and notes; blanks dropped."""
    plain = [F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "title", intro, "author_intro")]
    parts = [*plain, _texts("short_reviews", 5), _texts("reviews", 3), _texts("reading_notes", 3)]
    return F.array_join(F.filter(F.array(*parts), lambda p: F.length(p) > 0), " ")


def embedding_text(intro: str = "book_intro") -> Column:
    """Title once, intros, and all reviews and notes, as they are; null and empty parts dropped."""
    lists = [F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda t: F.length(t) > 0) for c in ("short_reviews", "reviews", "reading_notes")]
    plain = F.filter(F.array(*[F.col(c) for c in ("title", intro, "author_intro")]), lambda p: F.length(p) > 0)
    return F.array_join(F.concat(plain, *lists), " ")


def occurrences(text: Column, word: Column) -> Column:
    """How often the word occurs in the text, without overlap."""
    return F.when(F.length(word) > 0, ((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)).cast("int")).otherwise(0)
