"""Typed expressions and the domain tokenizer: pure functions over one text, the tokenizer also as a Column."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import ascii_marks

#: Building blocks of the patterns.
MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
SCALE = r"(?:lakh\s+crore|trillion|billion|million|crore|lakh|thousand|bn|mn)"
CURRENCY = r"(?:₹|US\s?\$|Rs\.?|INR|USD|\$|€|EUR|GBP|£)"
NUMBER = r"\d[\d,]*(?:\.\d+)?"
DASH = r"[-/–—]"

#: Categories in order of precedence.
CATEGORIES = (
    ("fiscal_year_range", rf"\bFY\s*\d{{2,4}}\s*{DASH}\s*\d{{2,4}}\b"),
    ("fiscal_year", r"\bFY\s*\d{2,4}\b"),
    ("year_range", rf"\b(?:19|20)\d{{2}}\s*{DASH}\s*\d{{2,4}}\b"),
    ("quarter", r"\bQ[1-4]\s*(?:FY\s*\d{2,4}|'?\d{2,4})?|\b[1-4](?:st|nd|rd|th)\s+quarter\b"),
    ("day_month_year", rf"\b\d{{1,2}}\s*(?:of\s+)?{MONTH}\.?\s*\d{{4}}\b"),
    ("month_year", rf"\b{MONTH}\.?\s*\d{{4}}\b"),
    ("day_month", rf"\b\d{{1,2}}\s+{MONTH}\b"),
    ("slash_date", r"\b\d{1,2}\s*/\s*\d{1,2}\s*/\s*\d{2,4}\b|\b(?:19|20)\d{2}\s*/\s*\d{2,4}\b"),
    ("year", r"\b(?:19|20)\d{2}\b"),
    ("percentage", rf"[+-]?{NUMBER}\s*(?:per\s+cent|percent|pct\.?|%)"),
    ("currency_amount", rf"{CURRENCY}\s*{NUMBER}\s*(?:{SCALE})?"),
    ("scaled_magnitude", rf"\b{NUMBER}\s+{SCALE}\b"),
    ("grouped_number", r"\b\d{1,3}(?:,\d{2,3})+(?:\.\d+)?\b"),
    ("decimal_number", r"[+-]?\d+\.\d+"),
    ("integer", r"[+-]?\d+"),
)
_COMPILED = [(name, re.compile(p, re.I)) for name, p in CATEGORIES]


def expressions(text: str) -> list[tuple[str, str, int, int]]:
    """(category, text, start, end) by start; an earlier category wins an overlap."""
    taken: list[tuple[int, int]] = []
    out = []
    for name, pattern in _COMPILED:
        for m in pattern.finditer(text):
            s, e = m.span()
            e = s + len(m[0].rstrip())
            if e > s and all(e <= a or s >= b for a, b in taken):
                taken.append((s, e))
                out.append((name, text[s:e], s, e))
    return sorted(out, key=lambda x: x[2])


#: Rules of the domain tokenizer, (rule, priority, pattern); the higher priority is tried first.
RULES = (
    ("R01", 100.0, r"\b\d{1,3}(?:,\d{2,3})++(?:\.\d++)?\s*+(?:lakh\s+crore|trillion|billion|million|crore|lakh|thousand|bn|mn)\b"),
    ("R02", 99.0, r"(?:₹|US\s?\$|US\$|Rs\.?|rs\.?|INR|inr|USD|usd|\$|€|EUR|eur|GBP|gbp|£)\s*+\d++[\d,]*+(?:\.\d++)?\s*+(?:lakh\s+crore|trillion|billion|million|crore|lakh|bn|mn)?"),
    ("R03", 98.0, r"\b\d++[\d,]*+(?:\.\d++)?\s*+(?:lakh\s+crore|trillion|billion|million|crore|lakh|thousand|bn|mn)\b"),
    ("R04", 97.0, r"\b\d++[\d,]*+(?:\.\d++)?\s*+(?:per\s+cent|percent|pct\.?|basis\s+points?|bps)\b"),
    ("R05", 96.0, r"[+-]?\d++[\d,]*+(?:\.\d++)?\s*+%"),
    ("R06", 95.0, r"\bFY\s*+\d{2,4}\s*+[-/–—]\s*+\d{2,4}+\b|\bFY\s*+\d{2,4}+\b|\b\d{4}\s*+[-/–—]\s*+\d{2,4}+\b"),
    ("R07", 94.0, r"\bQ[1-4]\s*+(?:FY\s*+\d{2,4}(?:\s*+[-/–—]\s*+\d{2,4}+)?|'?\d{2,4}(?:\s*+[-/–]\s*+\d{2,4}+)?)?\b|\b[1-4](?:st|nd|rd|th)\s+quarter\b"),
    ("R08", 93.0, r"\b\d{1,2}\s*+(?:of\s+)?(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec)[a-z]*\.?\s*+\d{4}+\b"),
    ("R09", 92.0, r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{4}+\b|\b\d{1,2}\s*/\s*\d{1,2}\s*/\s*\d{2,4}+\b|\b\d{4}\s*/\s*\d{2,4}+\b"),
    ("R10", 91.0, r"\b(?:[A-Za-z]\.){2,}+[A-Za-z]{1,6}+\b|\b[A-Za-z]{1,6}+\.(?:[A-Za-z]\.){1,}+[A-Za-z]{0,6}\b|\b[A-Za-z]{1,4}+\.(?:[A-Za-z]{1,4}+\.){1,3}+(?![\w])|\b[A-Za-z]\.[A-Za-z]{1,6}+\b"),
    ("R11", 90.0, r"\b[A-Z]{2,6}+\b"),
    ("R12", 90.5, r"\b[A-Za-z]{2,}+\s*+[-/–]\s*+\d++[A-Za-z0-9\-]*+\b|\b[A-Z]{2,}+\d++[A-Za-z0-9\-]*+\b|\b[A-Za-z]+\d++[A-Za-z0-9]*+\b"),
    ("R13", 88.0, r"\b[A-Za-z]{2,}+(?:[-/][A-Za-z]{2,}+)+\b"),
    ("R14", 87.0, r"[+-]?\d++[\d,]*+(?:\.\d++)?"),
    ("R15", 86.0, r"\b[A-Za-z]+['’](?:s|t|re|ve|ll|d|m)\b"),
    ("R16", 85.0, r"[A-Za-z]+(?:['’][A-Za-z]+)*+"),
    ("R17", 84.0, r"[^\sA-Za-z0-9]"),
)
_BY_PRIORITY = sorted(RULES, key=lambda r: -r[1])
_MASTER = re.compile("|".join(f"(?P<{n}>{p})" for n, _, p in _BY_PRIORITY))
_UNPRINTED = str.maketrans("\ufffd’‘“”–—−\u00a0", " ''\"\"--- ")


def surface(text: str) -> str:
    """Quotes and dashes as ASCII, what does not print as a space: the text that the rules read."""
    return "".join(c if c.isprintable() else " " for c in text.translate(_UNPRINTED))


def explain(text: str) -> list[tuple[str, str]]:
    """(token, rule) in order."""
    return [(t, m.lastgroup) for m in _MASTER.finditer(surface(text)) if (t := m[0].strip())]


def domain_tokens(text: str) -> list[str]:
    return [t for t, _ in explain(text)]


#: A word that no rule before R16 can take: no capitals after the first letter, and what follows is neither a
#: digit, a dash, an apostrophe, nor a dot inside a word.  Most words are of this kind and need no other try.
_PLAIN_WORD = r"[A-Za-z][a-z]*+(?= +[A-Za-z]|[,;:!?)]|\. +[^ 0-9]|\.? *\z)"
_TRIED = [("R16", _PLAIN_WORD), *((n, p) for n, _, p in _BY_PRIORITY)]


def _marked(c: Column) -> Column:
    """Parts between marks: one replacement writes every rule's group of a match, exactly one of which is not empty."""
    master = "(?U)" + "|".join(f"({p})" for _, p in _TRIED)
    return F.split(F.regexp_replace(ascii_marks(c), master, "\u0003" + "\u0002".join(f"${k}" for k in range(1, len(_TRIED) + 1))), "\u0003")


def _token(part: Column) -> Column:
    return F.trim(F.translate(part, "\u0002", ""))


def _rule(part: Column) -> Column:
    """The rule of a part, by the number of marks before its token."""
    return F.element_at(F.array(*(F.lit(n) for n, _ in _TRIED)), F.length(part) - F.length(F.ltrim(part, F.lit("\u0002"))) + 1)


def rule_tokens(c: Column) -> Column:
    """``explain`` as a Column: array of (token, rule)."""
    parts = F.filter(_marked(c), lambda x: F.contains(x, F.lit("\u0002")))
    return F.filter(F.transform(parts, lambda x: F.struct(_token(x).alias("token"), _rule(x).alias("rule"))), lambda t: t["token"] != "")


def rule_rows(units: DataFrame, *keep: str) -> DataFrame:
    """One row a token: ``keep``, place, token, rule.  The parts are read as rows, where expressions compile."""
    parts = units.select(*keep, F.posexplode(_marked(F.col("text"))).alias("place", "part")).where(F.contains("part", F.lit("\u0002")))
    rows = parts.select(*keep, "place", _token(F.col("part")).alias("token"), _rule(F.col("part")).alias("rule"))
    return rows.where("token != ''")


#: A sign that was cut off, and what it belongs to: (token before, token).
_REJOIN = tuple(
    (re.compile(a, re.I), re.compile(b, re.I))
    for a, b in (
        (r"^([-+]?\d[\d,]*(?:\.\d+)?)$", r"^(?:%|per\s+cent|percent)$"),
        (r"^(?:₹|US\$|Rs\.?|INR|\$|€|GBP)$", r"^\d"),
        (r"^/$", r"^\d"),
    )
)
_WHOLE = re.compile("|".join(f"(?:{p})" for _, p in sorted(CATEGORIES, key=lambda c: -len(c[1]))), re.I)


def hybrid(text: str, split: Callable[[str], list[str]]) -> list[str]:
    """Expressions as one token each, what lies between them by ``split``, cut-off signs joined again."""
    plain, pieces, at = surface(text), [], 0
    for m in _WHOLE.finditer(plain):
        if not (own := m[0].strip()):
            continue
        pieces += [*split(plain[at : m.start()]), own]
        at = m.end()
    out: list[str] = []
    for token in [*pieces, *split(plain[at:])]:
        if out and any(b.match(token) and a.match(out[-1]) for a, b in _REJOIN):
            out[-1] += token
        else:
            out.append(token)
    return out


def protect(text: str, tokens: list[str]) -> list[str]:
    """Runs of tokens that spell an expression become one term, longest expressions first."""
    out = list(tokens)
    for surface in sorted({e[1] for e in expressions(text) if " " in e[1] or not e[1].isalnum()}, key=lambda s: (-len(s), s)):
        bare = re.sub(r"\s+", "", surface).lower()
        i = 0
        while i < len(out):
            j, have = i, ""
            while j < len(out) and len(have) < len(bare):
                have += re.sub(r"\s+", "", out[j]).lower()
                j += 1
            if have == bare and j - i > 1:
                out[i:j] = [re.sub(r"\s+", " ", surface).lower()]
            i += 1
    return out


def typed_components(text: str) -> list[tuple[str, str]]:
    """Expressions split into typed parts: marks, numbers, scale and unit words, dates."""
    part = re.compile(rf"(?P<currency>{CURRENCY})|(?P<percent>%|per\s+cent|percent|pct\.?)|(?P<scale>{SCALE})|(?P<period>FY|Q[1-4])|(?P<month>{MONTH})|(?P<number>{NUMBER})")
    return [(m.lastgroup, m[0]) for _, surface, _, _ in expressions(text) for m in part.finditer(surface)]
