"""Tokens, Arabic folding, questions, hashtags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arabic short vowels and signs, and the lengthening stroke.
ARABIC_MARKS = "[\\u064B-\\u0652\\u0640]"


def arabic_fold(text: Column) -> Column:
    """Text without diacritics, so that marked and unmarked spellings meet."""
    return F.regexp_replace(text, ARABIC_MARKS, "")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, diacritics folded first."""
    return F.regexp_extract_all(F.lower(arabic_fold(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


#: A token as a text spells it, at the end of what is before and in it: diacritics may stand in it but not alone.
SPELT = r"(?!\x{0640})[\p{L}\p{N}][\p{L}\p{N}\x{064B}-\x{0652}\x{0640}]*"
LAST_TOKEN = f"({SPELT})$"


def pieces(text: Column) -> Column:
    """The text cut after each token: as many pieces as tokens() gives, each with what stands before its token; what follows the last is left out.

    A capital I with a dot is two letters in lower case, of which one ends a token; it is taken apart first.
    """
    return F.regexp_extract_all(F.replace(text, F.lit("\u0130"), F.lit("i\u0307")), F.lit(rf"(?:[^\p{{L}}\p{{N}}]|\x{{0640}})*{SPELT}"), F.lit(0))


def is_question(text: Column) -> Column:
    """A Latin or Arabic question mark."""
    return F.coalesce(text.rlike("[?؟]"), F.lit(False))


#: Words that announce a surprise, in English and Arabic.
SURPRISE_WORDS = ("suddenly", "unbelievable", "incredible", "shocking", "surprisingly", "unexpected", "secret", "فجأة", "صدمة", "مفاجأة", "لن تصدق")


def surprise_pattern() -> str:
    return r"(?i)!|(^|[^\p{L}])(" + "|".join(SURPRISE_WORDS) + r")($|[^\p{L}])"


def is_surprising(text: Column) -> Column:
    """An exclamation mark, or a word that announces a surprise. A simple rule; a model may add to it (plans.stages)."""
    return F.coalesce(text.rlike(surprise_pattern()), F.lit(False))


def is_url(text: Column) -> Column:
    return F.coalesce(text.rlike("^https?://[^/\\s]+"), F.lit(False))


def hashtags(words: Column) -> Column:
    """Distinct words as hashtags, in order of appearance."""
    return F.transform(F.array_distinct(words), lambda w: F.concat(F.lit("#"), w))
