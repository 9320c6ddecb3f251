"""Cleaning of generated text.  All expressions are built-in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode whitespace set (with the four separator controls),
# once as characters and once as a regex class.
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE = r"(?U:[\s\x1c-\x1f])"
NON_WHITESPACE = r"(?U:[^\s\x1c-\x1f])"

# What ends an answer, and which characters a number may use.
QUESTION_WORD, QUESTION_MARKER = "Question", "Question:"
EXPLANATION_WORD = "Explanation"
TRAILER = r"(?iu)(Question|Explanation):[^\n]*"
NOT_NUMERIC = r"[^\p{Nd}.,\-eE/]+"

# Vocabulary spellings of a leading space and of a newline, and the key
# under which all vocabularies share them.
SPACE_MARKER, UNDERSCORE_MARKER = "Ġ", "▁"
NEWLINES, NEWLINE_KEY = ("<0x0A>", "Ċ"), "/n"


def strip(text: Column) -> Column:
    """Remove whitespace at both ends (``trim`` alone removes only spaces)."""
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WHITESPACE + "+", " "))


def before_markers(text: Column, explanation: bool = True) -> Column:
    """The text up to a new question or an explanation, stripped."""
    text = F.substring_index(text, QUESTION_MARKER, 1)
    if explanation:
        text = F.substring_index(text, EXPLANATION_WORD, 1)
    return strip(text)


def cut_at_markers(text: Column, explanation: bool = True) -> Column:
    """As :func:`before_markers`, but a text with neither word stays as it is.
    The bare word ``Question`` only strips the text."""
    marked = F.contains(text, F.lit(QUESTION_WORD))
    if explanation:
        marked = marked | F.contains(text, F.lit(EXPLANATION_WORD))
    return F.when(marked, before_markers(text, explanation)).otherwise(text)


def cut_trailers(text: Column) -> Column:
    """Delete from a marker to the end of its line, in any letter case."""
    return F.regexp_replace(text, TRAILER, "")


def keep_numeric_chars(text: Column) -> Column:
    return strip(F.regexp_replace(text, NOT_NUMERIC, ""))


def clean_number(text: Column) -> Column:
    return strip(F.replace(F.replace(text, F.lit(",")), F.lit(" ")))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NON_WHITESPACE + "+"))


def normalize_token(token: Column) -> Column:
    """One spelling per token across vocabularies."""
    token = F.replace(token, F.lit(UNDERSCORE_MARKER), F.lit(SPACE_MARKER))
    for newline in NEWLINES:
        token = F.replace(token, F.lit(newline), F.lit(NEWLINE_KEY))
    return token


def token_text(token: Column) -> Column:
    """Readable text of a vocabulary token, in its vocabulary's own spelling.  The shared
    newline key is no spelling: a token like ``/news`` is text as it stands."""
    for marker in (SPACE_MARKER, UNDERSCORE_MARKER):
        token = F.replace(token, F.lit(marker), F.lit(" "))
    for newline in NEWLINES:
        token = F.replace(token, F.lit(newline), F.lit("\n"))
    return token


def drop_last_char(text: Column) -> Column:
    return strip(F.substring(text, F.lit(1), F.length(text) - 1))
