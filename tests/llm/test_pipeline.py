"""Each stage of the pipeline on the smallest tables, held against a plain version on its own input."""

import re
from collections import Counter

import brute
import corpus_pipeline
import pytest
from corvane.llm import exact_dedup, registry, toxicity
from corvane.plans.scratch import materialize
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF))
        out[name] = (before, docs)
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_columns(stages):
    for name, (before, after) in stages.items():
        assert name == "bpe" or after.columns == before.columns


def test_toxicity(stages, spark):
    before, after = stages["toxicity"]
    model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    dense = model.dense()
    want = {r["doc_id"] for r in rows(before) if model.score(dense, toxicity.features(r["text"] or "")) < 0.3}
    assert {r["doc_id"] for r in rows(after)} == want


def test_exact(stages):
    before, after = stages["exact_dedup"]
    first: dict = {}
    for r in sorted(rows(before), key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(brute.WS + "+", " ", r["text"] or ""), r)
    assert sorted(rows(after), key=str) == sorted(first.values(), key=str)


def test_near(stages):
    before, after = stages["near_dedup"]
    have = sorted(rows(before), key=lambda r: r["doc_id"])
    _, label = brute.near([r["text"] or "" for r in have])
    assert sorted(rows(after), key=str) == sorted((r for i, r in enumerate(have) if label[i] == i), key=str)


def test_mix(stages):
    before, after = stages["mix"]
    texts = {r["doc_id"]: r for r in rows(before)}
    sizes: Counter = Counter()
    for r in texts.values():
        sizes[r["source"]] += len(brute.WORD.findall(r["text"]))
    want, taken, times = brute.targets(dict(sizes)), Counter(), Counter()
    for r in rows(after):
        own = texts[r["doc_id"]]
        assert own["text"].startswith(r["text"]) and r["source"] == own["source"] and r["n_chars"] == len(r["text"])
        taken[r["source"]] += len(brute.WORD.findall(r["text"]))
        times[r["doc_id"]] += 1
    assert max(times.values()) <= 3 and all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_bpe(stages):
    before, after = stages["bpe"]
    lib = Tokenizer.from_file(registry.vocabulary())
    want = sorted((r["doc_id"], lib.encode(r["text"], add_special_tokens=False).ids) for r in rows(before))
    assert sorted((r["doc_id"], r["ids"]) for r in rows(after)) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows(after))


def test_bpe_decodes(stages):
    before, after = stages["bpe"]
    lib = Tokenizer.from_file(registry.vocabulary())
    want = sorted(lib.decode(lib.encode(r["text"], add_special_tokens=False).ids, skip_special_tokens=False) for r in rows(before))
    assert sorted(r["decoded"] for r in rows(after)) == want
    assert all(r["decoded"] == lib.decode(r["ids"], skip_special_tokens=False) for r in rows(after))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    """The rows of an independent engine, on odd texts and on the smallest table."""
    import duckdb
    import test_operators

    con = duckdb.connect()
    odd = spark.createDataFrame(test_operators.ROWS, test_operators.SCHEMA)
    con.register("odd", odd.select("doc_id", "text").toArrow())
    key = lambda rows: sorted(str(tuple(r)) for r in rows)
    for table, docs in (("odd", odd), (f"read_parquet('{SF}/documents.parquet')", spark.read.parquet(f"{SF}/documents.parquet"))):
        con.execute(f"create or replace view documents as select * from {table}")
        got = {"op7_secrets": registry.scan_secrets, "op9_exact": exact_dedup.classes}[name](docs)
        assert key(got.collect()) == key(con.execute(f"select {', '.join(got.columns)} from ({registry.oracle_sql()[name]})").fetchall())


def test_run_leaves_one_table_behind(spark):
    """Each stage's scratch goes once the next table stands; the rows are those of the stages."""
    from corvane.plans import scratch

    before = set(scratch._live)
    got = corpus_pipeline.run(spark, SF)
    left = [p for p in scratch._live if p not in before]
    assert sorted(p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in left) == ["stage-mix", "words"]
    assert got.count() == spark.read.parquet(next(p for p in left if "stage-mix" in p)).count()
