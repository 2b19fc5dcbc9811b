"""Clashing columns, very long texts, nulls everywhere, repeated rows: each operator and each stage."""

import hashlib
import random
import re
import zlib

import brute
import corpus_pipeline
import pytest
from corvane.llm import bpe, exact_dedup, jaccard_join, media, mixing, pii, registry, secrets, suffix_dedup, token_counts, toxicity
from corvane.plans.scratch import materialize
from pyspark.sql import functions as F
from tokenizers import Tokenizer

VOCAB = registry.vocabulary()
#: Names that the operators use inside or give out.
NAMES = (
    "Score _score predicted _predicted kept _keep keep_id size copies _copies cuts _n _id _h _s _own _gone _part key label nid uid sid mult "
    "blob path unseen spans chunk bucket id ids decoded y f text_hash _t _k m n media tracks error base_sha256 source_size target taken"
).split()
BASE = "doc_id long, text string, lang string, source string, n_chars long"


def _texts() -> list:
    rng = random.Random(1)
    words = [f"{rng.choice('abcdef')}{rng.randint(0, 500)}" for _ in range(60)]
    return [None, "", " ", "one", " ".join(words), " ".join(words), " ".join(words[:-1] + ["z"]), "vile " * 3, "mail a@b.org token=abcdef", " ".join(words) * 2]


def _rows() -> list[tuple]:
    out = []
    for i, t in enumerate(_texts()):
        out.append((i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None, None if t is None else len(t), *(f"{n}{i}" for n in NAMES)))
    return [*out, out[4], out[7], (None, *out[5][1:]), (None,) * len(out[0]), (3, *out[6][1:])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), BASE + "".join(f", `{n}` string" for n in NAMES)).repartition(3).persist()


@pytest.fixture(scope="module")
def labels(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rows = [(i, 1, int(i == 7)) for i in range(10)] + [(None, None, None), (7, None, 1), (8, 1, None)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def key(rows):
    return sorted(map(str, rows))


def test_clashing_columns_are_not_read(docs, spark, labels):
    slim = docs.select("doc_id", "text", "source")
    found = spark.read.parquet(f"{labels}/labels.parquet")
    for run in (
        lambda d: pii.digest(pii.extract(d)),
        lambda d: suffix_dedup.remove_repeats(d, digest=True),
        media.media_columns,
        lambda d: bpe.encode(d, VOCAB, digest=True),
        mixing.mix_plan,
        jaccard_join.links,
        lambda d: secrets.digest(secrets.scan_history([d], secrets.Ledger(spark))),
        lambda d: toxicity.score(d, toxicity.fit(d, found)).select("doc_id", "score", "predicted"),
        exact_dedup.classes,
        lambda d: token_counts.count_tokens(d, VOCAB),
    ):
        wide, narrow = run(docs).collect(), run(slim).collect()
        assert len(wide) == len(_rows()) and key(wide) == key(narrow)


def test_stages_with_clashing_columns(docs, spark, labels):
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, now, labels))
        if name == "bpe":
            assert after.columns == ["doc_id", "n_tokens", "ids", "decoded"] and after.count() == now.count()
            continue
        assert after.columns == docs.columns
        rows = after.collect()
        if name == "mix":
            assert {r.doc_id for r in rows} <= {r.doc_id for r in now.collect()} and all(r.n_chars == len(r.text) for r in rows)
        else:
            assert set(key(rows)) <= set(key(now.collect()))
        for r in rows:  # a row keeps its own values
            assert r[NAMES[0]] is None or r[NAMES[0]][len(NAMES[0]) :] == r["taken"][len("taken") :]
        now = after


def test_stages_on_empty_tables(docs, spark, labels):
    now = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = materialize(stage(spark, now, labels))
        assert now.count() == 0


def test_stages_without_further_columns(spark, labels):
    now = spark.createDataFrame([(r[0], r[1], r[3]) for r in _rows()], "doc_id long, text string, source string")
    for name, stage in corpus_pipeline.STAGES:
        now = materialize(stage(spark, now, labels))
        assert name == "bpe" or now.columns == ["doc_id", "text", "source"]
    assert now.count()


def _long() -> list[str]:
    rng = random.Random(2)
    words = [f"{rng.choice('ghjkl')}{rng.randint(0, 10**6)}" for _ in range(120_000)]
    tail = words[: len(words) - 40] + [f"x{i}" for i in range(40)]
    return [" ".join(words) + " a@b.org, token=abcdefgh\n" + "word " * 500_000, " ".join(words), " ".join(tail), "".join(rng.choice("abcdefgh") for _ in range(60_000))]


def test_very_long_texts(spark):
    """Texts of up to 4 MB, one of them a single word, beside short ones."""
    texts = [*_long(), "short", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))
    plain = [t or "" for t in texts]
    got = {r.doc_id: r for r in pii.digest(pii.extract(docs)).collect()}
    assert got[0].n_email == 1 and all(got[i].n_card == sum(k == "card" for _, _, k, _ in brute.spans(t, brute.PII[2:3])) for i, t in enumerate(plain))
    got = {r.doc_id: r for r in secrets.digest(secrets.scan_history([docs], secrets.Ledger(spark))).collect()}
    assert got[0].n_assign == 1 and got[3].n_hex == sum(k == "hex" for _, _, k, _ in brute.spans(plain[3], brute.SECRETS))
    got = {r.doc_id: r for r in exact_dedup.classes(docs).collect()}
    assert all(got[i].text_sha256 == brute.sha(re.sub(brute.WS + "+", " ", t)) for i, t in enumerate(plain))
    got = {r.doc_id: r for r in mixing.mix_plan(docs).collect()}
    assert all(got[i]["size"] == len(brute.WORD.findall(t)) for i, t in enumerate(plain))
    got = {r.doc_id: r for r in media.media_columns(docs).collect()}
    assert all(got[i].payload_sha256 == brute.sha(media.pad(t.encode())) and got[i].tail_crc32 == zlib.crc32(media.pad(t.encode())[-32:]) for i, t in enumerate(plain))
    lib = Tokenizer.from_file(VOCAB)
    want = [lib.encode(t, add_special_tokens=False).ids for t in plain]
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, VOCAB).collect()}
    assert all(got[i].n_tokens == len(w) for i, w in enumerate(want))
    got = {r.doc_id: r for r in bpe.encode(docs, VOCAB, digest=True).collect()}
    assert all(got[i].ids_sha256 == brute.sha(" ".join(map(str, w))) and got[i].decoded_sha256 == brute.sha(lib.decode(w, skip_special_tokens=False)) for i, w in enumerate(want))
    got = {r.doc_id: r for r in jaccard_join.links(docs).collect()}
    assert got[1].n_links == got[2].n_links == 2 and got[2].class_id == 0 and got[4].n_links == 0
    scored = toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int"))).collect()
    assert len(scored) == len(texts) and all(0 <= r.score <= 1 for r in scored)
    # the same bytes as from windows found in a dictionary
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, digest=True).collect()}
    raw = [t.encode() for t in plain]
    seen: dict = {}
    for t in raw:
        for i in range(len(t) - 199):
            h = hash(t[i : i + 200])
            seen[h] = seen.get(h, 0) + 1
    for k, t in enumerate(raw):
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[hash(t[i : i + 200])] > 1:
                gone[i : i + 200] = b"\x01" * 200
        kept = bytes(c for c, g in zip(t, gone) if not g)
        assert got[k].kept_sha256 == hashlib.sha256(kept).hexdigest() and got[k].n_removed == len(t) - len(kept)
