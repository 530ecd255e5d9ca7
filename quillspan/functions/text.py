"""Text functions, each as a column expression and, where a driver needs it, as a Python function."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every separator a line ends with, and every white-space character (Java syntax).
LINE_SEP = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
BLANK = r"^[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*$"
LEADING_SPACE = r"^[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: Leading white space and characters that don't print (such as a byte order mark).
LEADING_UNPRINTABLE = r"^[\x00-\x20\x7f-\xa0\xad\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff\ufff9-\ufffb]+"
#: White space at either end.
OUTER_SPACE = LEADING_SPACE + "|" + LEADING_SPACE[1:-1] + "+$"
GRAM = 3


def normalize(c: Column) -> Column:
    """Lower case, only ``a-z0-9`` and spaces kept, spaces collapsed and trimmed. Other white space is deleted, not kept."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""), " +", " "))


def normalize_text(text: str) -> str:
    """``normalize`` for a query on the driver."""
    return " ".join(re.sub("[^a-z0-9 ]", "", text.lower()).split())


def trigrams(c: Column) -> Column:
    """All overlapping runs of three characters, in order (with repeats)."""
    return F.regexp_extract_all(c, F.lit(f"(?=(.{{{GRAM}}}))"), F.lit(1))


def trigrams_of(text: str) -> list[str]:
    """The distinct trigrams of a query, in order."""
    return list(dict.fromkeys(text[i : i + GRAM] for i in range(len(text) - GRAM + 1)))


def words(c: Column) -> Column:
    """Space-separated parts, empty ones dropped."""
    return F.array_remove(F.split(c, " "), "")


def is_blank(c: Column) -> Column:
    return c.rlike(BLANK)


def displayed(c: Column) -> Column:
    """Without leading white space, as results are shown."""
    return F.regexp_replace(c, LEADING_SPACE, "")


def displayed_clean(c: Column) -> Column:
    """Also without leading characters that don't print."""
    return F.regexp_replace(c, LEADING_UNPRINTABLE, "")


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, OUTER_SPACE, "")


def logged_column(c: Column) -> Column:
    """``logged`` over a column."""
    return F.replace(F.replace(F.substring(c, 1, 200), F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))


def logged(query: str) -> str:
    """A query as it goes to the log: 200 characters, line ends escaped."""
    return query[:200].replace("\r", "\\r").replace("\n", "\\n")


def legacy_clean(c: Column) -> Column:
    """The older form: white space collapsed first, then lower case, then ASCII punctuation deleted; other characters stay."""
    collapsed = F.trim(F.regexp_replace(c, r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " "))
    return F.regexp_replace(F.lower(collapsed), r"[!-/:-@\[-`{-~]", "")


def folded(c: Column) -> Column:
    """Case folded as far as built-in functions go; the concat keeps the optimiser from dropping the inner upper()."""
    return F.lower(F.concat(F.upper(c), F.lit("")))
