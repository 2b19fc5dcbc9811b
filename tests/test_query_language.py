import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.operators import query_language as ql


@pytest.mark.parametrize(
    "text", ["NOT a", "NOT (a OR b)", "a AND (", "a)", "AND a", '"unclosed phrase', "a & b", "a OR NOT b", "NOT a AND b", "a AND NOT NOT b", "a AND NOT (b OR c)", "a b AND c", '""', ""]
)
def test_rejected(text):
    with pytest.raises(ql.QuerySyntaxError):
        ql.parse(text)


def test_precedence():
    assert ql.render(ql.parse("a AND b OR c")) == ql.render(ql.parse("(a AND b) OR c"))
    assert ql.parse("a OR b AND c") == ql.Or(ql.Term(("a",)), ql.And(ql.Term(("b",)), ql.Term(("c",))))
    assert ql.parse("a AND NOT b AND c") == ql.And(ql.And(ql.Term(("a",)), ql.Not(ql.Term(("b",)))), ql.Term(("c",)))
    assert ql.parse("a AND NOT (b AND NOT c)")
    assert ql.parse("x-y AND z").left == ql.Term(("x", "y"), True)


def test_types_and_exclusions():
    kinds = {"a b": "keyword", '"a b"': "phrase", "a AND b": "and", "a or b": "or", "a AND NOT b": "not", "(a OR b) AND c": "group"}
    assert {t: ql.query_type(t) for t in kinds} == kinds
    assert ql.excluded_terms(ql.parse('a AND NOT ("b c" AND d)')) == ["b c", "d"]


_leaf = st.one_of(st.sampled_from("abcd").map(lambda w: ql.Term((w,))), st.tuples(st.sampled_from("abcd"), st.sampled_from("efgh")).map(lambda w: ql.Term(w, True)))
_tree = st.recursive(_leaf, lambda t: st.one_of(st.builds(ql.Or, t, t), st.builds(ql.And, t, t), st.builds(lambda a, b: ql.And(a, ql.Not(b)), t, _leaf)), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(_tree)
def test_render_parses_back(tree):
    assert ql.parse(ql.render(tree)) == tree
