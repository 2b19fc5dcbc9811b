"""Snippets, chunks and a treebank-like tokenizer, as pure functions over one text."""

from __future__ import annotations

import re


def snippet(text: str, terms: list[str], phrase: str = "", size: int = 220, context: int = 90) -> str:
    """The part of a text that shows a query best.

    With a phrase that stands in the text, the part around it; else the window of ``size`` characters
    that starts near an occurrence and holds the most different terms, the first of several.
    """
    flat = " ".join(text.split())
    low = flat.lower()
    if len(flat) <= size:
        return flat
    at = low.find(phrase.lower()) if phrase else -1
    if at >= 0:
        start = max(0, at - context)
    else:
        places = sorted((m.start(), t) for t in {t.lower() for t in terms if t} for m in re.finditer(rf"(?<!\w){re.escape(t)}(?!\w)", low))
        best, start = 0, 0
        for p, _ in places:
            begin = max(0, p - context)
            held = len({t for q, t in places if begin <= q < begin + size})
            if held > best:
                best, start = held, begin
    end = min(len(flat), start + size)
    if start > 0:
        start = low.find(" ", start) + 1 or start
    if end < len(flat):
        end = max(start + 1, flat.rfind(" ", start, end)) if " " in flat[start:end] else end
    return ("... " if start else "") + flat[start:end].strip() + (" ..." if end < len(flat) else "")


def chunks(text: str, limit: int) -> list[tuple[int, int]]:
    """Spans of at most ``limit`` characters that cover the text, broken after the last blank that fits."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + limit)
        if end < len(text):
            blank = text.rfind(" ", at, end)
            end = blank + 1 if blank > at else end
        out.append((at, end))
        at = end
    return out


#: The published splitting rules of the treebank convention.
_RULES = [
    (re.compile(r'^"'), r"`` "), (re.compile(r'([ (\[{<])"'), r"\1 `` "), (re.compile(r"([;@#$%&?!])"), r" \1 "), (re.compile(r"([:,])([^\d]|$)"), r" \1 \2"),
    (re.compile(r"([^.])(\.)([\])}>\"']*)\s*$"), r"\1 \2\3 "), (re.compile(r"([\][(){}<>])"), r" \1 "), (re.compile(r"--"), " -- "), (re.compile(r'"'), " '' "),
    (re.compile(r"([^' ])('s|'m|'d|'ll|'re|'ve|n't)\b", re.I), r"\1 \2"), (re.compile(r"\b(can)(not)\b", re.I), r"\1 \2"), (re.compile(r"\b(gon|wan)(na)\b", re.I), r"\1 \2"),
]


def treebank(text: str) -> list[str]:
    for pattern, to in _RULES:
        text = pattern.sub(to, text)
    return text.split()
