"""Text as Column expressions.  White space is Unicode's, as far as Java and Python agree on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = "(?U)[\\s\\x1c-\\x1f]"


def strip(c: Column | str) -> Column:
    """Without white space at its ends; a text that has none there isn't searched."""
    c = F.col(c) if isinstance(c, str) else c
    ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
    return F.when(F.rlike(ends, F.lit(WS)), F.regexp_replace(c, f"^{WS}+|{WS}+$", "")).otherwise(c)


def canon(c: Column) -> Column:
    """Name of an entity: stripped, lower case, without one pair of outer quotes; null and empty give ''."""
    s = F.lower(strip(F.coalesce(c, F.lit(""))))
    quoted = (F.startswith(s, F.lit('"')) & F.endswith(s, F.lit('"'))) | (F.startswith(s, F.lit("'")) & F.endswith(s, F.lit("'")))
    inner = F.when(F.length(s) < 2, F.lit("")).otherwise(F.substring(s, F.lit(2), F.length(s) - 2))
    return strip(F.when(quoted, inner).otherwise(s))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def sentences(c: Column) -> Column:
    """Pieces between white space that follows a full stop, exclamation or question mark; a trailing empty one stays."""
    return F.split(c, f"(?<=[.!?]){WS}+", -1)


def normalized_answer(c: Column) -> Column:
    """Lower case, only letters, digits, underscores and spaces, single spaces."""
    return F.array_join(tokens(F.regexp_replace(F.lower(c), "(?U)[^\\p{L}\\p{N}_\\s\\x1c-\\x1f]", "")), " ")


def without_assistant(c: Column) -> Column:
    return F.regexp_replace(c, f"\\Aassistant:{WS}*", "")


#: The marks at which an answer ends, for the final and for the local answer.
FINAL_MARKS = "(?i)(\"\"\"|'''|```|#|Explanation:|Reasoning:|Because)"
LOCAL_MARKS = "(\"\"\"|'''|```|#|markdown)"
NO_ANSWER = "Insufficient information to answer based on the available summaries."
NO_LOCAL_ANSWER = "Insufficient information to answer based on the available summary."


def before_mark(c: Column, marks: str = FINAL_MARKS) -> Column:
    return strip(F.element_at(F.split(c, marks, 2), 1))


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(tokens(c), 1, n), " ")


def count_tokens(c: Column) -> Column:
    """The default token counter: words between white space."""
    return F.size(tokens(c))
