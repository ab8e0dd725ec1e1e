"""Character and token counts of a text column."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from .semantics import as_col

# The patterns that define each count.  (?U) makes the blank class cover
# Unicode, (?d) makes only the newline end a line.
BLANK = r"[\s\x1c-\x1f]"
WORD = rf"(?Ud)({BLANK}|^)[a-z]+({BLANK}|$)"
NUMBER = rf"(?Ud)({BLANK}|^)[-+]?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?({BLANK}|$)"
UPPERCASE = string.ascii_uppercase
LOWERCASE = string.ascii_lowercase
DIGITS = string.digits
PUNCTUATION = string.punctuation
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def chars_in(c: Column, members: str) -> Column:
    """How many characters belong to a set: what is missing once they are deleted."""
    return F.length(c) - F.length(F.translate(c, members, ""))


def text_counts(c: Column | str) -> dict[str, Column]:
    """Suffix -> count expression for one text column."""
    c = as_col(c)
    return {
        "nb_chars": F.length(c),
        "nb_tokens": F.when(c.isNotNull(), chars_in(c, " ") + 1),
        "nb_words": F.regexp_count(c, F.lit(WORD)),
        "nb_numbers": F.regexp_count(c, F.lit(NUMBER)),
        "nb_letters": chars_in(c, UPPERCASE) + chars_in(c, LOWERCASE),
        "nb_uppercase_letters": chars_in(c, UPPERCASE),
        "nb_lowercase_letters": chars_in(c, LOWERCASE),
        "nb_digits": chars_in(c, DIGITS),
        "nb_punctuation_signs": chars_in(c, PUNCTUATION),
        "nb_whitespaces": chars_in(c, WHITESPACE),
    }


def special_chars(prefix: str) -> Column:
    """Characters of no other class, from the counts already computed under the prefix."""

    def col(suffix: str) -> Column:
        return as_col(f"{prefix}_{suffix}")

    return col("nb_chars") - col("nb_whitespaces") - col("nb_punctuation_signs") - col("nb_digits") - col("nb_letters")


def joined_text(columns) -> Column:
    """Columns joined by one blank; NULL when any of them is NULL."""
    parts: list[Column] = []
    for c in columns:
        parts += [F.lit(" "), as_col(c)] if parts else [as_col(c)]
    return F.concat(*parts)
