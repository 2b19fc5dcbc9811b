"""Tokenizers and token flags as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The multilingual default: runs of letters and ASCII digits.
WORDS = r"[\p{L}0-9]+"
#: Words, or any other single sign.
SIMPLE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
#: Fixed value: the baseline pattern that keeps numbers, percentages, currency and period codes.
BASELINE = (
    r"(?:US\$|Rs\.)|[₹$€£¥]\s?\d+(?:[.,]\d+)*|%|\b(?:USD|EUR|GBP|JPY|INR|bps)\b|(?:FY|H|Q|CY)[0-9]{1,4}\b"
    r"|\b[A-Za-z]{1,4}[0-9]{1,4}[A-Za-z]*\b|[A-Za-z][A-Za-z'’\-]*"
    r"|\d+(?:[.,]\d+)*(?:\s?(?:per\s?cent|percent|pct|bps|basis\s+points|%|bn|mn|cr|tr))?|\d+(?:\.\d+)?(?:st|nd|rd|th)"
)
#: Ordinary function words of the four languages of the corpus.
STOPWORDS = tuple(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was were "
    "which with you au aux ce de des du elle en est et il la le les leur mais ne ou pas pour qui que se sur un une aber auf das dem den "
    "der die ein eine er es für im ist mit nicht sich sie und von zu como con del el ella los las más no para por su una y".split()
)
#: Token classes, RE2-safe so that an independent engine can check them.
FLAGS = {
    "numeric": r"^[-+]?[0-9][0-9,]*(?:\.[0-9]+)?$",
    "has_digit": r"[0-9]",
    "currency": r"^(?:₹|US\$|US\s*\$|Rs\.?|rs\.?|INR|inr|USD|usd|\$|€|EUR|eur|GBP|gbp|£)",
    "percentage": r"(?i)^(?:[+-]?[0-9][0-9,]*(?:\.[0-9]+)?\s*(?:%|per\s+cent|percent|pct\.?))$",
    "abbreviation": r"^(?:[A-Z]{2,6}|(?:[A-Za-z]\.){2,}[A-Za-z]{1,6}|[A-Za-z]{1,6}\.(?:[A-Za-z]\.)+)$",
    "hyphenated": r"[-/]",
    "date": (
        r"(?i)^(?:[0-9]{1,2}\s+(?:of\s+)?(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?,?\s*[0-9]{0,4}"
        r"|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?,?\s*[0-9]{0,4}"
        r"|fy\s*[0-9]{2,4}(?:\s*[-/]\s*[0-9]{2,4})?|[0-9]{4}\s*[-/]\s*[0-9]{2,4}|q[1-4]\s*(?:fy\s*[0-9]{2,4}|[0-9]{2,4})?"
        r"|(?:19|20)[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})$"
    ),
    "fiscal_year": r"(?i)^(?:fy\s*[0-9]{2,4}(?:\s*[-/]\s*[0-9]{2,4})?|[0-9]{4}\s*[-/]\s*[0-9]{2,4})$",
}
#: Fixed value: the lexicon of special tokens.
SPECIAL = tuple(
    "gdp gva cpi wpi fdi fpi rbi sebi imf wto npa repo repo-rate reverse-repo msf crr slr g-sec gsec lakh crore billion trillion million "
    "per cent fiscal monetary inflation deflation disinflation budget niti gst esop emi npa-ratio twrs dpi plfs nre capex g-secs".split()
)
#: The classes of a token, as counted for every tokenizer.
CLASSES = ("numeric", "date", "fiscal_year", "percentage", "currency", "abbreviation", "hyphenated", "special")


def tokenize(c: Column, pattern: str = WORDS, lower: bool = True) -> Column:
    return F.regexp_extract_all(F.lower(c) if lower else c, F.lit(pattern), F.lit(0))


def is_indexable(c: Column) -> Column:
    """Has a letter (or another word sign that is no digit), starts with a digit, or is a percent sign with digits."""
    return c.rlike(r"[\p{L}\p{Nl}\p{No}]") | c.rlike(r"^\p{Nd}") | (c.rlike("^%") & c.rlike(r"\p{Nd}"))


def drop_stopwords(tokens: Column, words: tuple[str, ...] = STOPWORDS) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*words))


def ngrams(tokens: Column, n: int, joiner: str = " ") -> Column:
    """All runs of n tokens, in order."""
    none = F.array().cast("array<string>")
    runs = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), joiner))
    return F.when(F.size(tokens) >= n, runs).otherwise(none)


def classes(c: Column) -> dict[str, Column]:
    """The class flags of one token."""
    own = {n: c.rlike(p) for n, p in FLAGS.items()}
    return {
        "numeric": own["numeric"] | (own["has_digit"] & ~own["date"]),
        "date": own["date"],
        "fiscal_year": own["fiscal_year"],
        "percentage": own["percentage"] | (F.trim(c) == "%"),
        "currency": own["currency"],
        "abbreviation": own["abbreviation"],
        "hyphenated": own["hyphenated"] & c.rlike(r"\p{L}"),
        "special": F.lower(c).isin(*SPECIAL),
    }
