"""Counts and postings by chunks of whole documents: the same as plain ones, and no row for each token is moved."""

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from corvane.operators import chunks as ch
from corvane.operators import index as ix
from corvane.operators import search as se

TEXTS = [("d1", "u1", "b a b c"), ("d1", "u2", "a b"), ("d2", "u1", "c c c b a"), ("d2", "u3", ""), ("d3", "u4", "a b c a b c a"), ("d3", "u4", "c a b"), ("d4", "u5", "zz")]


def batches(size):
    rows = [(d, u, t.split()) for d, u, t in TEXTS]
    for i in range(0, len(rows), size):
        part = rows[i : i + size]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), (pa.string(), pa.string(), pa.list_(pa.string())))], names=["document_id", "unit_id", "t"])


def plain(n):
    freq, units, docs = Counter(), defaultdict(set), defaultdict(set)
    for d, u, t in TEXTS:
        w = t.split()
        for i in range(len(w) - n + 1):
            g = " ".join(w[i : i + n])
            freq[g] += 1
            units[g].add((d, u))
            docs[g].add(d)
    return {g: (freq[g], len(units[g]), len(docs[g])) for g in freq}


def test_totals_add_up_over_chunks_of_any_size():
    for n in (1, 2, 3):
        for size in (1, 2, 3, 7):
            for most in (1, 4, 6, 100):
                got = defaultdict(lambda: (0, 0, 0))
                for chunk in ch.chunks(batches(size), most):
                    for r in chunk.totals(n, " ").to_pylist():
                        got[r["gram"]] = tuple(a + b for a, b in zip(got[r["gram"]], (r["freq"], r["units"], r["docs"])))
                assert dict(got) == plain(n), (n, size, most)


def test_chunks_hold_whole_documents():
    for most in (1, 4, 6, 100):
        seen = [d for chunk in ch.chunks(batches(2), most) for d in set(chunk.documents.to_pylist())]
        assert sorted(seen) == ["d1", "d2", "d3", "d4"]


def test_wide_numbers_sort_alike(monkeypatch):
    want = [r for chunk in ch.chunks(batches(7)) for r in chunk.totals(3, " ").to_pylist()]
    monkeypatch.setattr(ch, "_BITS", 1)
    assert [r for chunk in ch.chunks(batches(7)) for r in chunk.totals(3, " ").to_pylist()] == want


def test_postings_are_those_of_the_tokens(spark):
    u = spark.createDataFrame([(d, u, t) for d, u, t in TEXTS if t], "document_id string, unit_id string, text string")
    rows = lambda df: sorted((r.term, r.unit_id, r.document_id, r.tf, tuple(r.positions)) for r in df.collect())
    assert rows(ch.postings(u)) == rows(ix.postings(ix.tokens(u)))
    terms = lambda df: sorted(tuple(r) for r in df.select("term", "term_frequency", "posting_frequency", "document_frequency").collect())
    assert terms(ix.term_counts(u)) == terms(ix.terms(ix.postings(ix.tokens(u))))


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("Exchange ")[1] for line in plan.splitlines() if "Exchange " in line]


def test_postings_move_texts_only(spark):
    u = spark.createDataFrame([("d", "u", "a b")], "document_id string, unit_id string, text string")
    (moved,) = _exchanges(ch.postings(u))
    assert moved.startswith("hashpartitioning(document_id")


def test_search_moves_postings_once_whatever_the_queries(spark, tmp_path):
    u = spark.createDataFrame([("d", f"u{i}", "a b c") for i in range(3)], "document_id string, unit_id string, text string")
    ch.postings(u).write.parquet(f"{tmp_path}/p")
    post = spark.read.parquet(f"{tmp_path}/p")
    few, many = (_exchanges(se.search(post, q)) for q in ({"q": '"a b"'}, {f"q{i}": f'"a b" AND c AND NOT z{i}' for i in range(9)}))
    assert len(few) == len(many) == 2 and sum("hashpartitioning(unit_id" in x for x in many) == 1
    assert not _exchanges(se.matches(post, {"q": "a"}).where(F.lit(False)).limit(0))[1:]


def test_ngrams_of_all_sizes_from_one_sort(spark):
    import random

    r = random.Random(5)
    units = [(f"d{i % 7}", f"u{i:03d}", " ".join(r.choice(("a", "b", "ab", "a1", "é")) for _ in range(r.randrange(1, 12)))) for i in range(300)]
    u = spark.createDataFrame(units, "document_id string, unit_id string, text string")
    want = {}
    for _, unit, text in units:
        w = text.split()
        for n in range(1, 6):
            for i in range(len(w) - n + 1):
                own = want.setdefault((n, " ".join(w[i : i + n])), [0, set()])
                own[0] += 1
                own[1].add(unit)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for sizes in ((1, 2, 3, 4, 5), (2, 3, 4), (2,), (1,)):
            rows = ch.grams(u, sizes).collect()
            got = {(x.n, x.gram): (x.freq, x.units, x.first_unit) for x in rows}
            assert len(got) == len(rows) and got == {g: (f, len(s), min(s)) for g, (f, s) in want.items() if g[0] in sizes}, sizes
        summary = {x.n: (x.total, x.unique_ngrams, x.singletons) for x in ch.gram_summary(u, (1, 2, 3, 4, 5)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for n in range(1, 6):
        freq = [f for g, (f, _) in want.items() if g[0] == n]
        assert summary[n] == (sum(freq), len(freq), freq.count(1))
    moved = _exchanges(ch.grams(u, (1, 2, 3, 4, 5)))
    assert len(moved) == 2
