import pytest

from corvane.operators import evaluation as ev
from corvane.operators import index as ix
from corvane.operators import search as se

UNITS = [
    ("u1", "d1", "Prices rose 4.5 percent in the current year"),
    ("u2", "d1", "The current account and the capital account"),
    ("u3", "d2", "Capital flows and current prices"),
    ("u4", "d2", "current account current account deficits"),
    ("u5", "d3", "Nothing of note"),
    ("u6", "d3", "The account of the current keeper"),
]


@pytest.fixture(scope="module")
def post(spark):
    units = spark.createDataFrame(UNITS, "unit_id string, document_id string, text string")
    return ix.postings(ix.tokens(units)).persist()


def found(post, text, **kw):
    return {r.unit_id for r in se.search(post, {"q": text}, **kw).collect()}


def test_sets(post):
    a, b = found(post, "current"), found(post, "account")
    assert found(post, "current AND account") == a & b
    assert found(post, "current OR account") == a | b
    assert found(post, "current AND NOT account") == a - b
    assert found(post, '"current account"') == {"u2", "u4"} <= a & b
    assert found(post, 'current AND NOT "current account"') == a - {"u2", "u4"}
    assert found(post, "zzz AND current") == set()


def test_keywords(post):
    first = {r.unit_id: r.n_terms for r in se.search(post, {"q": "zzz account capital"}).collect()}
    assert first == {"u2": 2, "u4": 1, "u6": 1}
    assert found(post, "zzz account capital", keyword_mode="any") == {"u2", "u3", "u4", "u6"}


def test_score_and_order(post):
    rows = sorted(se.search(post, {"q": '"current account"'}).collect(), key=lambda r: r["rank"])
    assert [r.unit_id for r in rows] == ["u4", "u2"]
    assert rows[0].score == 4.1747  # two terms, the bonus, 0.25 log10(1 + 4)
    assert rows[0].matched_terms == "account;current" and rows[0].total_tf == 4


def test_cap_keeps_the_best(post):
    rows = se.search(post, {"q": "current"}, max_hits=2).collect()
    assert sorted(r["rank"] for r in rows) == [1, 2]


def test_metrics(spark):
    ranking = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("q", 3, "c")], "query_id string, rank int, item string")
    labels = spark.createDataFrame([("q", "a", 1), ("q", "b", 0), ("q", "c", 1), ("q", "z", 1)], "query_id string, item string, relevance int")
    r = ev.evaluate(ranking, labels).first()
    assert (r.tp, r.fp, r.relevant_total) == (2, 1, 3)
    assert r.ap == round((1 + 2 / 3) / 3, 6) and r.rr == 1.0 and r.p_at_10 == 0.2 and r.p_at_3 == round(2 / 3, 6)
    none = ev.evaluate(ranking, labels.where("relevance = 5")).first()
    assert none.precision is None and none.recall is None and none.ap == 0.0 and none.ndcg_at_5 == 0.0 and none.unjudged == 3


def test_judgments(spark):
    rows = [("q", "a", 1, "1"), ("q", "a", 0, "2"), ("q", "b", 2, "1"), ("", "c", 1, "1"), ("q", "d", None, "1")]
    good = ev.valid_judgments(spark.createDataFrame(rows, "query_id string, item string, relevance int, judged_at string")).collect()
    assert [(r.item, r.relevance) for r in good] == [("a", 0)]


def test_terms_that_cover_a_share(spark):
    counts = [50] + [10] * 3 + [2] * 5 + [1] * 40
    d = spark.createDataFrame([(f"t{i}", n) for i, n in enumerate(counts)], "term string, posting_frequency long")
    for share in (0.3, 0.5, 0.65, 0.7, 0.9, 0.99, 1.0):
        run, want = 0, 0
        while run < sum(counts) * share:
            run, want = run + counts[want], want + 1
        assert ix.coverage_terms(d, share).first()[0] == want, share


def test_long_phrases_and_many_leaves(spark):
    words = [f"w{i}" for i in range(70)]
    units = spark.createDataFrame([("u1", "d1", " ".join(words)), ("u2", "d2", " ".join(words[:69])), ("u3", "d3", " ".join(reversed(words)))], "unit_id string, document_id string, text string")
    own = ix.postings(ix.tokens(units)).persist()
    assert found(own, '"' + " ".join(words) + '"') == {"u1"}
    assert found(own, " AND ".join(words)) == {"u1", "u3"}
    assert found(own, " OR ".join(words) + " AND NOT w69") == {"u1", "u2", "u3"}
