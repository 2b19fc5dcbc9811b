"""Sinks, evidence, rules, tags, layout and wide evaluation on small hand-made tables."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import morphology as mo
from corvane.operators import evaluation as ev
from corvane.operators import index as ix
from corvane.operators import layout as la
from corvane.operators import query_language as ql
from corvane.operators import rules as ru
from corvane.operators import search as se
from corvane.operators import tags as tg
from corvane.sources import corpus, sinks


def test_snowball_and_lancaster():
    pairs = "consistency>consist consolidate>consolid knives>knive generously>generous communication>communic hoping>hope skies>sky dying>die rational>ration news>news agreed>agre ties>tie cries>cri gas>gas kiwis>kiwi possibly>possibl"
    assert all(mo.snowball(a) == b for a, b in (p.split(">") for p in pairs.split()))
    pairs = "maximum>maxim presumably>presum multiply>multiply provision>provid owed>ow ear>ear saying>say crying>cry string>string meant>meant cement>cem"
    assert all(mo.lancaster(a) == b for a, b in (p.split(">") for p in pairs.split()))
    assert [mo.lemma(w) for w in ("gases", "series", "news", "cases", "cities", "running", "GDP")] == ["gas", "series", "news", "case", "city", "run", "gdp"]


def test_judgments_are_kept_and_swapped(spark, tmp_path):
    path = f"file://{tmp_path}/judgments"
    schema = "query_id string, unit_id string, relevance int, notes string"
    sinks.save_judgments(spark, path, spark.createDataFrame([("q2", "u1", 1, "yes"), ("q1", "u2", 0, "no")], schema))
    sinks.save_judgments(spark, path, spark.createDataFrame([("q2", "u1", 0, ""), ("q3", "u9", 1, "new")], schema))
    rows = [tuple(r) for r in spark.read.parquet(path).orderBy("query_id").collect()]
    assert rows == [("q1", "u2", 0, "no"), ("q2", "u1", 0, "yes"), ("q3", "u9", 1, "new")]
    assert not (tmp_path / "judgments.next").exists() and not (tmp_path / "judgments.past").exists()


def test_purge_takes_own_outputs_only(spark, tmp_path):
    for name in ("a", "b", "other"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x").write_text("x")
    assert sinks.purge(spark, f"file://{tmp_path}", ("a", "missing")) == ["a"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["b", "other"]
    for bad in ("..", "a/../b", ""):
        with pytest.raises(ValueError):
            sinks.purge(spark, f"file://{tmp_path}", (bad,))


def test_manifest_does_not_depend_on_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "i int, t string")
    same, other = a.repartition(3), spark.createDataFrame([(1, "x"), (2, "y")], "i int, t string")
    digest = lambda df: sinks.manifest({"in": df}, {"run": 1}).first().sha256
    assert digest(a) == digest(same) != digest(other)
    assert sinks.manifest({"a": a, "b": other}, {}).count() == 2


def test_text_in_order(spark, tmp_path):
    units = spark.createDataFrame([(f"u{i}", "d1" if i % 2 else "d2", i, f"line {i}") for i in range(20)], "unit_id string, document_id string, unit_index int, text string")
    sinks.write_ordered_text(units.repartition(5), f"file://{tmp_path}/t")
    (file,) = (tmp_path / "t" / "document_id=d1").glob("part-*")
    assert [x for x in file.read_text().split("\n") if x.startswith("line")] == [f"line {i}" for i in range(1, 20, 2)]


def test_index_is_saved_once(spark, tmp_path):
    calls = []
    units = spark.createDataFrame([("u1", "d1", "red fox"), ("u2", "d2", "red hen red")], "unit_id string, document_id string, text string")

    def build(u):
        calls.append(1)
        return ix.postings(ix.tokens(u))

    for _ in range(3):
        post, terms, own = sinks.saved_index(spark, f"test-{tmp_path}", lambda: units, build)
    assert len(calls) == 1 and own.count() == 2
    assert {tuple(r) for r in terms.collect()} == {("red", 3, 2, 2), ("fox", 1, 1, 1), ("hen", 1, 1, 1)}
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,red)]" in post.where("term = 'red'")._jdf.queryExecution().toString()


def test_evidence(spark, tmp_path):
    (tmp_path / "ner.csv").write_text("unit_id,entity\nu1,GDP\nu1,ABC\nu2,X\n")
    schema = T.StructType([T.StructField("unit_id", T.StringType()), T.StructField("entity", T.StringType())])
    tables, problems = corpus.load_evidence(spark, {"ner": f"file://{tmp_path}/ner.csv", "lost": f"file://{tmp_path}/lost.csv"}, {"more": f"file://{tmp_path}/more.csv"}, dict.fromkeys(("ner", "lost", "more"), schema))
    assert [r.name for r in problems.collect()] == ["lost"] and tables["more"].count() == 0
    assert {r.unit_id: [e.entity for e in r.entities] for r in corpus.by_unit(tables["ner"]).collect()} == {"u1": ["ABC", "GDP"], "u2": ["X"]}


def test_rules(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", -1), ("a", 2), (None, 0)], "k string, v int")
    texts = {"A": "no key is null", "B": "values are not negative", "C": "keys are unique", "D": "empty"}
    parts = [ru.over(rows, {"A": F.count_if(F.col("k").isNull()), "B": F.count_if(F.col("v") < 0)}), ru.repeated(rows, "C", "k"), ru.rows_of(rows.where("v > 9"), "D")]
    got = {r.rule_id: (r.status, r.evidence) for r in ru.report(parts, texts, ("B",)).collect()}
    assert got == {"A": ("FAIL", 1), "B": ("WARN", 1), "C": ("FAIL", 1), "D": ("PASS", 0)}
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "x").write_text("x")
    (tmp_path / "none").mkdir()
    bad = ru.artefacts(spark, "P15", f"file://{tmp_path}", ("out", "none", "lost", "../out")).first()
    assert bad.evidence == 3
    now = spark.createDataFrame([("a", "1"), ("b", "3")], "id string, h string")
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "9")], "id string, h string")
    assert ru.unchanged(old, now, "R15", "id", "h").first().evidence == 2
    assert ru.parser(spark, "P12", ql.parse, ("a AND b", "a AND"), ("NOT a", "a")).first().evidence == 2


def test_alignment():
    t = ["The", "GDP", "grew", "by", "naïve", "7.4", "%"]
    assert tg.align(t, ["GDP", "grew"]) == ("exact", [1, 2])
    assert tg.align(t, ["gdp", "GREW"]) == ("case", [1, 2])
    assert tg.align(t, ["by", "naive"]) == ("folded", [3, 4])
    assert tg.align(t, ["gdp", "by", "74"]) == ("gaps", [1, 3, 5])
    assert tg.align(t, ["zzz"]) == ("none", []) and tg.align(t, []) == ("empty", [])


def test_retagging(spark):
    rows = [("u", "d", i, w, t) for i, (w, t) in enumerate([("nation", "VERB")] * 3 + [("nation", "NOUN")] + [("Nation", "VERB")] + [("action", "VERB")] * 2 + [("city", "NOUN")] * 5)]
    t = spark.createDataFrame(rows, "unit_id string, document_id string, pos int, token string, tag string")
    d = tg.retagging(t)
    assert [tuple(r) for r in d.collect()] == [("nation", 5, 2, "VERB", "nominal", "NOUN")]
    new = [(r.token, r.tag, r.new_tag) for r in tg.retag(t, d).orderBy("pos").collect()]
    assert new[0] == ("nation", "VERB", "NOUN") and new[3] == ("nation", "NOUN", "NOUN") and new[4] == ("Nation", "VERB", "NOUN") and new[5] == ("action", "VERB", "VERB")


def test_entity_errors(spark):
    found = spark.createDataFrame([("GDP", "PERSON"), ("Ann Bell", "PERSON"), ("Ann Bell", "PERSON"), ("Rome", "ORG")], "entity string, label string")
    known = spark.createDataFrame([("Rome", "PLACE", 4), ("Oslo", "PLACE", 7), ("Ann Bell", "PERSON", 2)], "entity string, category string, mentions long")
    assert {tuple(r) for r in tg.entity_errors(found, known).collect()} == {("person_acronym", "GDP", "PERSON", "ACRONYM", 1), ("category", "Rome", "ORG", "PLACE", 1), ("missed", "Oslo", None, "PLACE", 7)}


def test_layout(spark):
    lines = {
        "Table 3 Growth": "table", "Chart 2: Prices": "figure", "Table 3 shows growth": None, "Box 1": "box", "The table": None,
    }
    d = spark.createDataFrame(list(lines), "string").toDF("t")
    assert {r.t: r.k for r in d.select("t", la.caption_kind(F.col("t")).alias("k")).collect()} == lines
    kinds = {"MAIN RESULTS": "heading", "Review Of Markets": "heading", "1. first point here": "heading", "a b": "other", "this is a plain sentence of words.": "paragraph", "IV. later": "heading"}
    d = spark.createDataFrame(list(kinds), "string").toDF("t")
    assert {r.t: r.k for r in d.select("t", la.line_kind(F.col("t")).alias("k")).collect()} == kinds
    labels = {"Page 12": "12", "iv": "iv", "7": "7", "7 apples": None}
    d = spark.createDataFrame(list(labels), "string").toDF("t")
    assert {r.t: r.k for r in d.select("t", la.page_label(F.col("t")).alias("k")).collect()} == labels


def test_sections(spark):
    lines = ["Intro text of the paper that goes on.", "1.2 Scope of the work", "plain words follow in this line", "CHAPTER 4", "more plain words in this line", "SUMMARY OF IT"]
    d = spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], "document_id string, unit_index int, text string")
    got = [(r.section, r.number, r.method, r.first_line, r.last_line) for r in la.sections(d).orderBy("section").collect()]
    assert got == [(1, "1.2", "numbered_dotted_pattern", 1, 2), (2, "4", "chapter_pattern", 3, 4), (3, "", "standalone_heading", 5, 5)]


UNITS = [("u1", "d1", "the current account rose"), ("u2", "d1", "current the account"), ("u3", "d2", "current account and current account"), ("u4", "d3", "nothing")]


def test_phrases_and_how_they_were_met(spark):
    u = spark.createDataFrame(UNITS, "unit_id string, document_id string, text string")
    stream = ix.postings(ix.tokens(u))
    kept = ix.postings(u.select("unit_id", "document_id", F.posexplode(F.expr("filter(split(text, ' '), x -> x <> 'the')")).alias("pos", "term")))
    phrases = ix.phrase_postings(u, ix.phrases(u, least=2, least_documents=2))
    got = {r.unit_id: r.via for r in se.phrase_matches(stream, kept, ("current", "account"), phrases).collect()}
    assert got == {"u1": "stream+phrase_term", "u2": "index_positions", "u3": "stream+phrase_term"}
    row = {r.unit_id: (r.tf, r.positions) for r in phrases.where("term = 'current_account'").collect()}
    assert row == {"u1": (1, [1]), "u3": (2, [0, 3])}


def test_list_forms():
    assert ql.parse(se.all_of("a", "b OR c")) == ql.parse("a AND (b OR c)")
    assert ql.parse(se.any_of("a", '"b c"')) == ql.parse('a OR "b c"')
    assert ql.parse(se.all_but("a", "b", "c")) == ql.parse("a AND NOT b AND NOT c")
    with pytest.raises(ValueError):
        se.all_of()


def test_wide_evaluation(spark):
    hits = spark.createDataFrame([("q", 1, "u1", "d1", "a"), ("q", 2, "u2", "d1", "a;b"), ("q", 3, "u3", "d2", "b")], "query_id string, rank int, unit_id string, document_id string, matched_terms string")
    judgments = spark.createDataFrame([("q", "u1", 0), ("q", "u2", 1), ("q", "u9", 1)], "query_id string, item string, relevance int")
    queries = spark.createDataFrame([("q", "a b c", "keyword", "", "A", ["a", "b", "c"]), ("e", "zzz", "keyword", "", "A", ["zzz"])], "query_id string, query string, query_type string, description string, pipeline string, wanted array<string>")
    rows = {r.query_id: r for r in ev.evaluation_rows(hits, judgments, queries).collect()}
    q, e = rows["q"], rows["e"]
    assert len(q) == 42 and (q.retrieved_units, q.retrieved_documents, q.judged_units, q.unjudged_units) == (3, 2, 2, 1)
    assert (q.relevant_retrieved, q.relevant_total, q.false_positives, q.false_negatives) == (1, 2, 1, 1)
    assert (q.precision, q.recall, q.f1, q.average_precision, q.reciprocal_rank) == (0.5, 0.5, 0.5, 0.25, 0.5)
    assert (q.precision_at_1, q.precision_at_3, q.precision_at_10) == (0.0, 0.3333, 0.1) and (q.document_precision, q.document_recall) == (0.5, 1.0)
    assert (q.matched_terms, q.missing_terms, q.undefined_reason) == ("a;b", "c", "")
    assert e.retrieved_units == 0 and e.precision is None and "precision:" in e.undefined_reason and e.missing_terms == "zzz"
