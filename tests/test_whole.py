"""Queries that read the whole table, beside their checked slices."""

from corvane.operators import statistics as st
from corvane.plans import registry
from corvane.sources.corpus import numbered

SF = "/root/testdata/sf0.001"


def test_every_document_has_an_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("source", "doc_id").collect()
    want = {r.doc_id: f"D{i:02d}" for i, r in enumerate(sorted(docs), 1)}
    assert {r.doc_id: r.assigned for r in registry.queries()["sc3_ids"](spark, SF).collect()} == want


def test_numbers_over_ranges(spark):
    df = spark.createDataFrame([(i * 37 % 101, "x") for i in range(101)] + [(5, "again"), (None, "null")], "k long, v string")
    got = sorted((r.number, -1 if r.k is None else r.k) for r in numbered(df, "k", "v").collect())
    assert got == list(enumerate([-1, *sorted([*range(101), 5])], 1))


def test_odd_judgments_stay(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    got = {r.doc_id for r in registry.queries()["fl7_judgments"](spark, SF).collect()}
    assert got == {r.doc_id for r in labels if r.quality == 1} and any(i % 2 for i in got)


def test_ngrams_of_all_sizes(spark):
    texts = ["red fox runs far away", "red fox runs far away", "red fox sleeps", "a red fox runs", "red fox runs far", "red fox runs far"]
    units = spark.createDataFrame([(f"u{i}", t) for i, t in enumerate(texts)], "unit_id string, text string")
    rows = st.ngram_rows_of(units, (1, 2, 3, 4, 5))
    freq = {r.ngram: (r.n, r.freq, r.repeated) for r in rows.collect()}
    assert freq["fox sleeps"] == (2, 1, False) and freq["red fox runs far away"] == (5, 2, True)
    assert sorted((r.n, r.total) for r in st.ngram_summary(rows).collect()) == [(1, 25), (2, 19), (3, 13), (4, 7), (5, 2)]
    mined = [(r.n, r.ngram) for r in st.ranked_phrases(st.ngram_rows_of(units, (2, 3, 4)), 4).collect()]
    assert mined == [(2, "red fox"), (3, "red fox runs"), (2, "fox runs"), (4, "red fox runs far"), (3, "fox runs far"), (2, "runs far")]


def test_texts_are_read_to_their_end(spark):
    head = "".join(f"{i:08d}" for i in range(30_000))  # 240,000 characters
    rest = "".join(f"r{i:07d}" for i in range(30_000))
    docs = spark.createDataFrame([(1, head), (2, head[:200_000] + rest), (3, head + "tail"), (4, head)], "doc_id long, text string")
    assert [tuple(r) for r in st.identical(docs).collect()] == [(4, 1)]
    got = {(r.doc_id, r.owner): r.similarity for r in st.shingle_overlap(docs, least=0.1).collect()}
    assert got == {(2, 1): round(1000 / 2200, 6), (3, 1): round(1200 / 1201, 6), (4, 1): 1.0}
    opening = {r.doc_id: r.similarity for r in st.shingle_overlap(docs, chars=20_000).collect()}
    assert opening == {2: 1.0, 3: 1.0, 4: 1.0}
