"""Scalar text functions as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Typographic marks and the ASCII marks that stand for them.
CURLY = "\ufffd’‘“”–—−\u00a0"
PLAIN = " ''\"\"--- "


def normalise_for_tokens(c: Column) -> Column:
    """The replacement character and runs of line ends become a space."""
    return F.regexp_replace(F.regexp_replace(c, "�", " "), r"[\r\n]+", " ")


def ascii_marks(c: Column) -> Column:
    """Curly quotes, dashes and hard spaces as ASCII; every sign that does not print as a space."""
    return F.regexp_replace(F.translate(c, CURLY, PLAIN), r"[\p{C}\p{Z}]", " ")


def paragraphs(c: Column) -> Column:
    """The runs of a text between white space."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def normalised_key(c: Column) -> Column:
    """Compatibility form, folded case, single blanks: what two spellings of a name have in common."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))

    return run(c)


def clean_text(c: Column) -> Column:
    """Line ends unified, NULs and private-use characters out, blanks collapsed, one blank line at most."""
    c = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"\x00", "")
    c = F.regexp_replace(c, "[-]", " ")
    c = F.regexp_replace(c, r"[ \t ]+", " ")
    c = F.regexp_replace(c, r" *\n", "\n")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^[ \n]+|[ \n]+$", "")


def collapse_blanks(c: Column) -> Column:
    return F.regexp_replace(c, r"[ \t   ]+", " ")


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def count_words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"[ \t\r\n]+"), lambda w: w != "")).cast("long")


def join_wrapped(c: Column) -> Column:
    """A word broken by a hyphen at a line's end is joined; other line ends become a space."""
    return F.regexp_replace(F.regexp_replace(c, r"-\n([a-z])", "$1"), r"\n", " ")


def is_rotation_private(c: Column) -> Column:
    """At least six letters, over 90 % of them lower case."""
    letters, lower = F.regexp_count(c, F.lit("[A-Za-z]")), F.regexp_count(c, F.lit("[a-z]"))
    return (letters >= 6) & (lower > letters * 0.9)


def citation(document: Column, page: Column, section: Column, unit: Column) -> Column:
    """Parts joined by bars; an empty section is left out."""
    known = F.when((section != "") & (section != "UNKNOWN"), section)
    return F.concat_ws(" | ", document, F.concat(F.lit("p"), page), known, unit)


def truncate(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut back to a blank past the middle, with dots."""
    head = F.substring(c, 1, limit - 3)
    back = F.instr(F.reverse(head), " ")  # blanks from the end
    at = F.length(head) - back
    cut = F.when((back > 0) & (at > limit / 2), F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.rtrim(cut), F.lit("...")))


def as_int(c: Column) -> Column:
    return F.trim(c).try_cast("bigint")


def as_float(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def as_bool(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("true", "1", "yes")


def split_list(c: Column, mark: str = ";") -> Column:
    return F.filter(F.transform(F.split(c, mark), lambda x: F.trim(x)), lambda x: x != "")


def percent_reduction(before: Column, after: Column) -> Column:
    return F.when(before == 0, F.lit(0.0)).otherwise(F.round((before - after) * 100.0 / before, 2))


def matching(rows: DataFrame, equal: dict[str, str | None], holds: str = "", columns: tuple[str, ...] = ()) -> DataFrame:
    """Rows that have all the given values and, in any case, the text in one of the columns; empty conditions do not filter."""
    for c, value in equal.items():
        if value:
            rows = rows.where(F.col(c) == value)
    if not holds:
        return rows
    return rows.where(reduce(Column.__or__, (F.contains(F.lower(c), F.lit(holds.lower())) for c in columns)))


def is_safe_id(c: Column) -> Column:
    """Letters, digits and underscores, 120 at most: an id that may be used in a path."""
    return F.coalesce(c.rlike("^[A-Za-z0-9_]{1,120}$"), F.lit(False))
