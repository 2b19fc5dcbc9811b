"""The Boolean query language: words, "phrases", AND, OR, NOT, parentheses.

NOT binds closest, then AND, then OR; operators are case-insensitive; there is no implicit AND.  NOT
may only stand as the right side of AND, over a term, a phrase or a conjunction.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class QuerySyntaxError(ValueError):
    pass


@dataclass(frozen=True)
class Term:
    words: tuple[str, ...]
    phrase: bool = False


@dataclass(frozen=True)
class Not:
    item: object


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


_LEX = re.compile(r'\s*(?:"([^"]*)"|([()])|([^\s()"]+))')
_SPLIT = re.compile(r"[^\W_]+")


def words_of(text: str) -> tuple[str, ...]:
    return tuple(_SPLIT.findall(text.lower()))


def lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    if "&" in text:
        raise QuerySyntaxError("'&' is no operator")
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise QuerySyntaxError(f"unclosed phrase at {at}")
        phrase, paren, word = m.groups()
        if phrase is not None:
            if not words_of(phrase):
                raise QuerySyntaxError("empty phrase")
            out.append(("phrase", phrase))
        elif paren:
            out.append((paren, paren))
        else:
            out.append((word.upper() if word.upper() in ("AND", "OR", "NOT") else "word", word))
        at = m.end()
    return out


def parse(text: str):
    """The tree of a query; QuerySyntaxError if it isn't one."""
    lexemes = lex(text)
    if not lexemes:
        raise QuerySyntaxError("empty query")
    at = 0

    def peek() -> str:
        return lexemes[at][0] if at < len(lexemes) else ""

    def level(operator: str, below, node):
        nonlocal at
        left = below()
        while peek() == operator:
            at += 1
            left = node(left, below())
        return left

    def unary():
        nonlocal at
        kind = peek()
        if kind == "NOT":
            at += 1
            return Not(unary())
        if kind == "(":
            at += 1
            inner = disjunction()
            if peek() != ")":
                raise QuerySyntaxError("missing ')'")
            at += 1
            return inner
        if kind not in ("word", "phrase"):
            raise QuerySyntaxError(f"expected a term, found {kind or 'the end'}")
        value = lexemes[at][1]
        at += 1
        found = words_of(value)
        return Term(found, kind == "phrase" or len(found) > 1)

    def conjunction():
        return level("AND", unary, And)

    def disjunction():
        return level("OR", conjunction, Or)

    tree = disjunction()
    if at < len(lexemes):
        raise QuerySyntaxError(f"nothing may follow here: {lexemes[at][1]!r}")
    _guard(tree, False)
    return tree


def _guard(node, right_of_and: bool) -> None:
    if isinstance(node, Not):
        if not right_of_and or isinstance(node.item, Not | Or):
            raise QuerySyntaxError("NOT needs a left side joined by AND, and a term or a conjunction after it")
    elif isinstance(node, And):
        _guard(node.left, False)
        _guard(node.right, True)
    elif isinstance(node, Or):
        _guard(node.left, False)
        _guard(node.right, False)


def query_type(text: str) -> str:
    """group, not, and, or, phrase or keyword."""
    kinds = [k for k, _ in lex(text)]
    operators = {k for k in kinds if k in ("AND", "OR", "NOT")}
    if "(" in kinds and operators:
        return "group"
    for name in ("NOT", "AND", "OR"):
        if name in operators:
            return name.lower()
    return "phrase" if kinds == ["phrase"] else "keyword"


def render(node, above: int = 0) -> str:
    if isinstance(node, Term):
        text = " ".join(node.words)
        return f'"{text}"' if node.phrase else text
    if isinstance(node, Not):
        return f"NOT {render(node.item, 3)}"
    rank, name = (2, "AND") if isinstance(node, And) else (1, "OR")
    text = f"{render(node.left, rank)} {name} {render(node.right, rank + 1)}"
    return f"({text})" if rank < above else text


def leaves(node, wanted: bool = True) -> list[tuple[Term, bool]]:
    """(leaf, whether it is wanted rather than excluded), left to right."""
    if isinstance(node, Term):
        return [(node, wanted)]
    if isinstance(node, Not):
        return leaves(node.item, not wanted)
    return leaves(node.left, wanted) + leaves(node.right, wanted)


def excluded_terms(node) -> list[str]:
    return [" ".join(t.words) for t, wanted in leaves(node) if not wanted]
