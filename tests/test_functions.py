import random

from pyspark.sql import functions as F

from corvane.functions import morphology as mo
from corvane.functions import text as tx
from corvane.functions import snippets, text, typed
from corvane.operators import annotate, statistics
from corvane.sources import corpus, sinks


def test_porter():
    pairs = "caresses>caress ponies>poni agreed>agre plastered>plaster sized>size hopping>hop filing>file happy>happi relational>relat digitizer>digit hopefulness>hope adoption>adopt controll>control"
    for p in pairs.split():
        word, stem = p.split(">")
        assert mo.porter(word) == stem


def test_sentences_and_lemmas():
    assert mo.sentences("Dr. Low came. He left. No. 5 won!") == ["Dr. Low came.", "He left.", "No. 5 won!"]
    assert [mo.lemma(w) for w in ("payments", "grew", "RBI", "hopping", "crises", "cities")] == ["payment", "grow", "rbi", "hop", "crisis", "city"]


def test_expressions():
    found = typed.expressions("7.4 per cent in FY2025-26, Rs. 50,000 on 31 March 2026")
    assert [f[0] for f in found] == ["percentage", "fiscal_year_range", "currency_amount", "day_month_year"]
    assert typed.domain_tokens("up 7.4% year-on-year, Rs 1.25 lakh crore") == ["up", "7.4%", "year-on-year", ",", "Rs 1.25 lakh crore"]
    assert "7.4 per cent" in typed.protect("rose 7.4 per cent", ["rose", "7.4", "per", "cent"])


def test_text_columns(spark):
    row = spark.createDataFrame([("a-\nb c\n\n\n\nd", "word " * 60, " 12 ", "x;; y")], "a string, b string, c string, d string").select(
        tx.join_wrapped(F.col("a")).alias("a"), tx.truncate(F.col("b"), 50).alias("b"), tx.as_int(F.col("c")).alias("c"), tx.split_list(F.col("d")).alias("d")
    ).first()
    assert row.a.startswith("ab c") and len(row.b) <= 50 and row.b.endswith("...") and row.c == 12 and row.d == ["x", "y"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("q", "u", 1.5, [1, 2], True, None)], "query_id string, unit_id string, s double, l array<int>, b boolean, n string")
    assert tuple(sinks.flat(df).first()) == ("q", "u", "1.5", "1;2", "true", "")
    old = spark.createDataFrame([("q", "u", "1", "old")], "query_id string, unit_id string, relevance string, notes string")
    new = spark.createDataFrame([("q", "u", "0", ""), ("q", "v", "1", "n")], old.schema)
    got = {r.unit_id: (r.relevance, r.notes) for r in sinks.upsert_judgments(old, new).collect()}
    assert got == {"u": ("0", "old"), "v": ("1", "n")}
    sinks.write_jsonl(spark.createDataFrame([("u1", "x")], "unit_id string, text string"), str(tmp_path / "u"))
    assert corpus.read_units(spark, str(tmp_path / "u")).first().text == "x"


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "f.txt").write_bytes(b"x" * 600)
    (tmp_path / "g.txt").write_bytes(b"y")
    assert {r.path.rsplit("/", 1)[1]: r.status for r in corpus.file_inventory(spark, str(tmp_path), "*.txt").collect()} == {"f.txt": "OK", "g.txt": "INVALID"}


def test_as_of(spark):
    p = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9)], "id int, k string, t int")
    m = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y")], "k string, t int, v string")
    assert {r.id: r.v for r in statistics.as_of(p, m, "k", "t", "v").collect()} == {1: "y", 2: None, 3: None}


def test_stem_families(spark):
    words = spark.createDataFrame([("growing",), ("grow",), ("grows",), ("sea",)], "term string")
    assert [(r.stem, r.n) for r in annotate.stem_families(words).collect()] == [("grow", 3)]


TYPED = [
    "up 7.4% in FY2025-26, Rs. 1.25 lakh crore on 31 March 2026; Ph.D. and B.Tech. at the U.S.A.", "rs. 500 crore, US $2.5 billion; Q1 FY26–27 or 3rd quarter", "COVID-19 M4 ABCdef GSTINs year-on-year bank's don’t",
    "1,25,000 and +3.2 million; 31/03/2026 2025/26 � x y — z\tend", "é naïve straße №5 ½ 日本 a​b", "", "   ", "3.4per cent 5pct. bps 25 bps e.g. M.finance a.b.c.d",
]


def test_rule_tokens_as_a_column(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rng = random.Random(3)
    parts = ["Jan", "January", "2026", "rs", "Rs", "a", "B", "US", "$", "q", "Q1", "FY", "26", "word", "Word", "GDP", "é", ".", ",", "-", "/", "'s", " ", " ", " ", "  ", "%", "x1", "M", "per", "cent", "(", ")", ";", "e.g.", "crore"]
    mixed = ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    rows = list(enumerate(TYPED + docs + mixed))
    got = spark.createDataFrame(rows, "i int, t string").select("i", typed.rule_tokens(F.col("t")).alias("x")).collect()
    for r in got:
        assert [(x.token, x.rule) for x in r.x] == typed.explain(rows[r.i][1]), rows[r.i][1]
    flat: dict = {}
    for r in sorted(typed.rule_rows(spark.createDataFrame(rows, "i int, text string"), "i").collect(), key=lambda r: (r.i, r.place)):
        flat.setdefault(r.i, []).append((r.token, r.rule))
    assert flat == {i: x for i, t in rows if (x := typed.explain(t))}


def test_rules_keep_their_expressions():
    rule = lambda t: typed.explain(t)
    assert rule("Ph.D.")[0] == ("Ph.D.", "R10") and rule("rs. 500 crore") == [("rs. 500 crore", "R02")]
    assert rule("COVID-19") == [("COVID-19", "R12")] and rule("GDP") == [("GDP", "R11")] and rule("1,25,000 crore") == [("1,25,000 crore", "R01")]
    assert rule("7.4 per cent") == [("7.4 per cent", "R04")] and rule("FY2025-26") == [("FY2025-26", "R06")] and rule("January 2026") == [("January 2026", "R09")]


def test_hybrid_keeps_expressions_whole():
    split = snippets.treebank
    assert typed.hybrid("grew 7.4 per cent in FY2025-26.", split) == ["grew", "7.4 per cent", "in", "FY2025-26", "."]
    assert typed.hybrid("x $ 2", str.split) == ["x", "$ 2"] and typed.hybrid("it's 6.50 % now", split)[2] == "6.50 %"
    assert typed.hybrid("a / 5", str.split) == ["a", "/5"]


def test_paragraphs_and_keys(spark):
    d = spark.createDataFrame([(" a  b\n\nc ", "ﬁne  STRASSE Ⅳ"), (None, None)], "t string, k string")
    got = d.select(text.paragraphs(F.col("t")), text.normalised_key(F.col("k"))).collect()
    assert tuple(got[0]) == (["a", "b", "c"], "fine strasse iv") and tuple(got[1]) == (None, None)
