"""Queries: tags and entities, layout by lines, registries, samples and report tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import morphology, snippets, typed
from corvane.functions import text as tx
from corvane.functions import tokens as tk
from corvane.operators import annotate as an
from corvane.operators import evaluation as ev
from corvane.operators import layout as la
from corvane.operators import query_language as ql
from corvane.operators import search as se
from corvane.operators import tags as tg
from corvane.plans import q_corpus as qc
from corvane.plans import q_search as qs
from corvane.plans.queries import POSTINGS, TERMS, TOKENS, UNITS, query
from corvane.sources.corpus import numbered, registry, structured, table

# --- tags


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_TAG_SQL = (
    "CASE WHEN regexp_matches(token, '^[0-9]') THEN 'NUM' WHEN NOT regexp_matches(token, '\\p{L}') THEN 'PUNCT' "
    + " ".join(f"WHEN lower(token) IN {_in(w)} THEN '{n}'" for n, w in tg.CLOSED.items())
    + " WHEN regexp_matches(token, '^\\p{Lu}{2,6}$') THEN 'PROPN' WHEN regexp_matches(token, '^\\p{Lu}') AND pos > 0 THEN 'PROPN' "
    + " ".join(f"WHEN regexp_matches(lower(token), '{p}') THEN '{n}'" for n, p in tg.ENDINGS)
    + " ELSE 'NOUN' END"
)
TAGGED = UNITS + f""", words AS (SELECT unit_id, document_id, unnest(a) AS token, generate_subscripts(a, 1) - 1 AS pos FROM (SELECT unit_id, document_id, regexp_extract_all(text, '{tk.SIMPLE}') AS a FROM units)),
  tagged AS (SELECT *, {_TAG_SQL} AS tag FROM words)"""


def _case(c: str, pairs: dict[str, str], other: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items()) + f" ELSE '{other}' END"


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    return tg.annotate(qs.unit_rows(spark, sf))


@query("mo15_annotation", f"WITH {TAGGED} SELECT unit_id, pos, token, tag FROM tagged")
def mo15_annotation(spark, sf):
    return tagged(spark, sf).select("unit_id", F.col("pos").cast("long").alias("pos"), "token", "tag")


@query(
    "mo7_distribution",
    f"""WITH {TAGGED} SELECT tag, {_case('tag', tg.COARSE, 'other')} AS coarse_category, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM tagged), 4) AS percent_of_tokens,
    count(DISTINCT document_id) AS documents_containing_tag FROM tagged GROUP BY 1""",
)
def mo7_distribution(spark, sf):
    return tg.distribution(tagged(spark, sf))


def _expect(k: int) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(term, '{e[1]}') THEN '{e[k]}'" for e in tg.EXPECTED) + " END"


_RETAG = f"""{TAGGED}, n AS (SELECT lower(token) AS term, tag, count(*) AS n FROM tagged GROUP BY 1, 2),
  b AS (SELECT term, arg_max(tag, n * 1000 + ascii(tag) + ascii(substr(tag, 2)) / 1000.0) AS default_tag, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS distinct_tags FROM n GROUP BY 1),
  d AS (SELECT term, occurrences, distinct_tags, default_tag, {_expect(0)} AS rule, {_expect(2)} AS expected_tag FROM b),
  dictionary AS (SELECT * FROM d WHERE expected_tag IS NOT NULL AND occurrences >= 3 AND {_case('default_tag', tg.FAMILY, 'other')} <> {_case('expected_tag', tg.FAMILY, 'other')} ORDER BY occurrences DESC, term LIMIT 60)"""


@query("mo8_dictionary", f"WITH {_RETAG} SELECT * FROM dictionary")
def mo8_dictionary(spark, sf):
    """Words whose usual tag is of another family than their shape lets expect."""
    return tg.retagging(tagged(spark, sf))


@query(
    "mo8_retagged",
    f"""WITH {_RETAG} SELECT t.document_id, count(*) AS tokens, count(*) FILTER (d.term IS NOT NULL AND {_case('t.tag', tg.FAMILY, 'other')} <> {_case('d.expected_tag', tg.FAMILY, 'other')}) AS changed
    FROM tagged t LEFT JOIN dictionary d ON d.term = lower(t.token) GROUP BY 1""",
)
def mo8_retagged(spark, sf):
    t = tagged(spark, sf)
    r = tg.retag(t, tg.retagging(t))
    return r.groupBy("document_id").agg(F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("tag") != F.col("new_tag")).alias("changed"))


@query("mo9_classifier")
def mo9_classifier(spark, sf):
    """Held-out measures of a classifier that learns the tags."""
    _, held = tg.train_tagger(tagged(spark, sf))
    return ev.classification(held.select("gold", "pred"))


_SEEN = 4


@query("mo10_alignment")
def mo10_alignment(spark, sf):
    """Tokens of the words pattern aligned to the tokens of each unit, and how."""
    u = qs.unit_rows(spark, sf).select("unit_id", tk.tokenize(F.col("text"), tk.SIMPLE, False).alias("tokens"), F.slice(tk.tokenize(F.col("text")), 2, _SEEN).alias("gold"))
    return tg.aligned(u).groupBy("how").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.size("places")), 4).alias("mean_places"))


_NAMES = UNITS + """, found AS (SELECT unit_id, document_id, entity, CASE WHEN len(string_split(entity, ' ')) = 1 THEN 'ACRONYM' WHEN len(string_split(entity, ' ')) = 2 THEN 'PERSON' ELSE 'ORG' END AS label
  FROM (SELECT unit_id, document_id, unnest(list_distinct(list_concat(regexp_extract_all(text, '\\p{Lu}\\p{Ll}+(?: \\p{Lu}\\p{Ll}+)+'), list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda t: regexp_full_match(t, '[A-Z]{2,6}'))))) AS entity FROM units))"""


def found_entities(spark: SparkSession, sf: str) -> DataFrame:
    return tg.entities(qs.unit_rows(spark, sf))


@query("mo12_entities", f"WITH {_NAMES} SELECT label, entity, count(*) AS units, count(DISTINCT document_id) AS documents FROM found GROUP BY 1, 2")
def mo12_entities(spark, sf):
    return found_entities(spark, sf).groupBy("label", "entity").agg(F.count(F.lit(1)).alias("units"), F.countDistinct("document_id").alias("documents"))


@query("mo12_contexts")
def mo12_contexts(spark, sf):
    return found_entities(spark, sf)


@query("fl5_entities", f"WITH {_NAMES} SELECT unit_id, document_id, entity, label FROM found WHERE label = 'PERSON' AND contains(lower(entity), 'th')")
def fl5_entities(spark, sf):
    return tg.filter_entities(found_entities(spark, sf), label="PERSON", holds="th").select("unit_id", "document_id", "entity", "label")


#: A dictionary of words of the corpus by category.
DICTIONARY = {w: c for c, ws in {"ARTICLE": ("the", "der", "les"), "JOIN": ("and", "und", "que"), "PLACE": ("of", "in", "zzzz"), "OTHER": ("tion", "er", "qqqq")}.items() for w in ws}
_DICT = ", ".join(f"('{w}', '{c}')" for w, c in DICTIONARY.items())


@query(
    "mo13_dictionary",
    f"WITH {TOKENS}, d(entity, category) AS (VALUES {_DICT}), c AS (SELECT unit_id, category, entity, count(*) AS n FROM tokens JOIN d ON entity = term GROUP BY 1, 2, 3) "
    "SELECT unit_id, category, entity, n FROM c QUALIFY row_number() OVER (PARTITION BY unit_id, category ORDER BY n DESC, entity) <= 3",
)
def mo13_dictionary(spark, sf):
    return an.dictionary_entities(qs.unit_rows(spark, sf), DICTIONARY)


def known_entities(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, category, mentions): each dictionary entry with its mentions, 0 among them."""
    d = spark.createDataFrame(list(DICTIONARY.items()), "entity string, category string")
    t = qs.term_rows(spark, sf).where(F.col("term").isin(*DICTIONARY)).select(F.col("term").alias("entity"), "term_frequency")
    return d.join(t, "entity", "left").select("entity", "category", F.coalesce("term_frequency", F.lit(0)).alias("mentions"))


@query("rp11_dictionary_evidence", f"WITH {TERMS}, d(entity, category) AS (VALUES {_DICT}) SELECT entity, category, CAST(coalesce(term_frequency, 0) AS BIGINT) AS mentions FROM d LEFT JOIN terms ON term = entity")
def rp11_dictionary_evidence(spark, sf):
    return known_entities(spark, sf)


@query(
    "mo14_errors",
    f"""WITH {TOKENS}, found AS (SELECT unit_id, CASE WHEN len(string_split(entity, ' ')) = 1 THEN 'ACRONYM' WHEN len(string_split(entity, ' ')) = 2 THEN 'PERSON' ELSE 'ORG' END AS label, lower(entity) AS entity
    FROM (SELECT unit_id, unnest(list_distinct(list_concat(regexp_extract_all(text, '\\p{{Lu}}\\p{{Ll}}+(?: \\p{{Lu}}\\p{{Ll}}+)+'), list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda t: regexp_full_match(t, '[A-Z]{{2,6}}'))))) AS entity FROM units)),
    c AS (SELECT entity, label, count(*) AS n FROM found GROUP BY 1, 2), d(entity, category) AS (VALUES {_DICT}),
    k AS (SELECT entity, category, (SELECT count(*) FROM tokens WHERE term = entity) AS mentions FROM d)
    SELECT 'category' AS error, c.entity, label, category AS expected, n FROM c JOIN k USING (entity) WHERE label <> category
    UNION ALL SELECT * FROM (SELECT 'missed', entity, NULL, category, mentions FROM k WHERE entity NOT IN (SELECT entity FROM c) ORDER BY mentions DESC, entity LIMIT 400)""",
)
def mo14_errors(spark, sf):
    found = found_entities(spark, sf).withColumn("entity", F.lower("entity"))
    return tg.entity_errors(found, known_entities(spark, sf))


_LEMMAS = [(f, l, "VERB" if l in ("be", "have", "do", "go", "make", "grow", "rise", "fall", "hold", "lead", "pay", "say", "see", "take") else "NOUN") for f, l in morphology.EXCEPTIONS.items()]
_LEMMAS += [("the", "the", "DET"), ("les", "le", "DET"), ("der", "die", "DET")]
_LEMMA_SQL = ", ".join(f"('{f}', '{l}', '{t}')" for f, l, t in _LEMMAS)


@query(
    "mo4_lookup",
    f"""WITH {TERMS}, l(form, lemma, tag) AS (VALUES {_LEMMA_SQL}), v AS (SELECT form, min(lemma) AS lemma FROM l WHERE tag IN ('VERB', 'DET') GROUP BY 1), a AS (SELECT form, min(lemma) AS lemma FROM l GROUP BY 1)
    SELECT term, coalesce(a.lemma, term) AS lemma, coalesce(v.lemma, term) AS verb_lemma FROM terms LEFT JOIN a ON a.form = term LEFT JOIN v ON v.form = term""",
)
def mo4_lookup(spark, sf):
    t, words = spark.createDataFrame(_LEMMAS, "form string, lemma string, tag string"), qs.term_rows(spark, sf)
    return tg.lookup_lemmas(words, t).join(tg.lookup_lemmas(words, t, ("VERB", "DET")).withColumnRenamed("lemma", "verb_lemma"), "term")


_PREDICTED = "CASE WHEN regexp_matches(token, '^[0-9]') THEN 'NUM' WHEN lower(token) IN ('the', 'of', 'and') THEN 'DET' WHEN regexp_matches(token, '\\p{L}') THEN 'NOUN' END"


@query(
    "rp10_tag_comparison",
    f"""WITH {TAGGED}, p AS (SELECT t.tag AS gold, coalesce({_PREDICTED}, 'X') AS pred FROM tagged t), l AS (SELECT gold AS label FROM p UNION SELECT pred FROM p), c AS (SELECT gold, pred, count(*) AS n FROM p GROUP BY 1, 2),
    s AS (SELECT label, coalesce(sum(n) FILTER (gold = label AND pred = label), 0) AS tp, coalesce(sum(n) FILTER (gold <> label AND pred = label), 0) AS fp, coalesce(sum(n) FILTER (gold = label AND pred <> label), 0) AS fn FROM l, c GROUP BY 1),
    m AS (SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS pr, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS rc FROM s)
    SELECT label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END, 6) AS f1 FROM m""",
)
def rp10_tag_comparison(spark, sf):
    """A small tagger's predictions joined to the tags by place; a place without one counts as X."""
    t = tagged(spark, sf)
    tok = F.col("token")
    guess = F.when(tok.rlike("^[0-9]"), "NUM").when(F.lower(tok).isin("the", "of", "and"), "DET").when(tok.rlike(r"\p{L}"), "NOUN")
    other = t.select("unit_id", "pos", guess.alias("pred")).where("pred is not null")
    both = t.join(other, ["unit_id", "pos"], "left").select(F.col("tag").alias("gold"), F.coalesce("pred", F.lit("X")).alias("pred"))
    return ev.classification(both)


@query(
    "rp12_tagged_examples",
    f"""WITH {TAGGED}, u AS (SELECT document_id, unit_id, count(*) AS n, string_agg(token || '/' || tag, ' ' ORDER BY pos) AS example FROM tagged GROUP BY 1, 2 HAVING count(*) BETWEEN 6 AND 45),
    r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n, unit_id) AS r, count(*) OVER (PARTITION BY document_id) AS k FROM u) SELECT document_id, unit_id, example FROM r WHERE r = k // 2 + 1""",
)
def rp12_tagged_examples(spark, sf):
    """The unit of median length of each document, tagged."""
    u = tagged(spark, sf).groupBy("document_id", "unit_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("pos", "token", "tag"))).alias("x")).where("n between 6 and 45")
    w = Window.partitionBy("document_id")
    r = u.withColumn("r", F.row_number().over(w.orderBy("n", "unit_id"))).withColumn("k", F.count(F.lit(1)).over(w)).where("r = floor(k / 2) + 1")
    return r.select("document_id", "unit_id", F.array_join(F.transform("x", lambda t: F.concat_ws("/", t["token"], t["tag"])), " ").alias("example"))


# --- layout

_LINES = "lines AS (SELECT document_id, unit_index, unit_type, text, list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '') AS ws FROM units)"
_HEADING_SQL = """(len(ws) > 0 AND len(ws) <= 20 AND NOT (regexp_matches(text, '[.,;]$') AND len(ws) > 3)
  AND (regexp_matches(text, '^(?:\\(?[0-9]{1,2}[.)]|[IVXLC]{1,6}[.)])\\s+\\S') OR len(list_filter(ws, lambda w: regexp_matches(w, '\\p{L}') AND upper(w) = w)) >= greatest(1, floor(len(ws) * 0.7))
  OR (NOT regexp_matches(text, '(?:^|[^\\p{L}])\\p{Ll}|\\p{L}\\p{Lu}') AND regexp_matches(text, '\\p{L}'))))"""


@query("st4_line_kinds", f"WITH {UNITS}, {_LINES} SELECT document_id, unit_index, CASE WHEN {_HEADING_SQL} THEN 'heading' WHEN len(ws) < 4 AND length(text) < 40 THEN 'other' ELSE 'paragraph' END AS kind FROM lines")
def st4_line_kinds(spark, sf):
    return qs.unit_rows(spark, sf).select("document_id", F.col("unit_index").cast("long").alias("unit_index"), la.line_kind(F.col("text")).alias("kind"))


@query(
    "st5_notes",
    f"""WITH {UNITS}, {_LINES} SELECT document_id, count(*) FILTER ((regexp_matches(text, '^(?:[0-9]{{1,3}}|\\*{{1,3}}|†)\\s+\\S') AND regexp_matches(text, '\\p{{L}}')) OR regexp_matches(text, '^(?:Notes?|Source|SOURCE)')
    OR (len(ws) <= 40 AND regexp_matches(text, '\\((?:19|20)[0-9]{{2}}\\)|https?://|ibid|op\\. cit'))) AS footnotes, CAST(sum(len(regexp_extract_all(text, '\\[([0-9]{{1,3}})\\]', 1))) AS BIGINT) AS reference_marks,
    count(*) FILTER (regexp_matches(text, '^\\s*(?:[Pp]age\\s+)?([0-9]{{1,4}}|[ivxlc]{{1,7}})\\s*$')) AS page_labels FROM lines GROUP BY 1""",
)
def st5_notes(spark, sf):
    c = F.col("text")
    return qs.unit_rows(spark, sf).groupBy("document_id").agg(
        F.count_if(la.is_footnote(c)).alias("footnotes"), F.sum(F.size(la.reference_marks(c))).alias("reference_marks"), F.count_if(la.page_label(c).isNotNull()).alias("page_labels")
    )


@query(
    "st2_captions",
    """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(line, '^\\S+\\s+[A-Z]?[0-9.]+\\s+(?:shows|gives|presents|and|which|indicates|below|above)\\b') THEN 'none'
    WHEN regexp_matches(line, '^(?:Table|TABLE)\\s+[A-Z]?[0-9]+') THEN 'table' WHEN regexp_matches(line, '^(?:Figure|FIGURE|Chart|CHART|Fig\\.)\\s+[A-Z]?[0-9]+') THEN 'figure' WHEN regexp_matches(line, '^(?:Box|BOX)\\s+[A-Z]?[0-9]+') THEN 'box'
    ELSE 'none' END AS kind FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY 1""",
)
def st2_captions(spark, sf):
    lines = qc.docs(spark, sf).select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(F.coalesce(la.caption_kind(F.col("line")), F.lit("none")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "st7_sections",
    f"""WITH {UNITS}, {_LINES}, h AS (SELECT *, {_HEADING_SQL} AS heading, regexp_extract(text, '^([0-9]{{1,2}}(?:\\.[0-9]{{1,3}})+)\\.?\\s', 1) AS dotted, regexp_extract(text, '^(?:[Cc]hapter|CHAPTER)\\s+([0-9IVXLC]+)', 1) AS chapter,
    regexp_extract(text, '^\\(?([0-9]{{1,2}})[.)]\\s+\\S', 1) AS simple FROM lines),
    s AS (SELECT document_id, unit_index, CASE WHEN dotted <> '' AND (heading OR len(ws) > 3) THEN 'numbered_dotted_pattern' WHEN chapter <> '' AND heading THEN 'chapter_pattern' WHEN heading THEN 'standalone_heading' END AS method,
      CASE WHEN dotted <> '' AND (heading OR len(ws) > 3) THEN dotted WHEN chapter <> '' AND heading THEN chapter WHEN simple <> '' AND heading THEN simple ELSE '' END AS number,
      CASE WHEN dotted <> '' AND (heading OR len(ws) > 3) THEN CASE WHEN heading THEN 0.95 ELSE 0.8 END WHEN chapter <> '' AND heading THEN 0.9 WHEN simple <> '' AND heading THEN 0.85 WHEN heading THEN 0.7 END AS confidence FROM h),
    e AS (SELECT document_id, max(unit_index) AS last FROM lines GROUP BY 1)
    SELECT document_id, row_number() OVER w AS section, number, method, CAST(confidence AS DOUBLE) AS confidence, unit_index AS first_line, coalesce(lead(unit_index) OVER w - 1, last) AS last_line
    FROM s JOIN e USING (document_id) WHERE method IS NOT NULL AND confidence >= 0.7 WINDOW w AS (PARTITION BY document_id ORDER BY unit_index)""",
)
def st7_sections(spark, sf):
    r = la.sections(qs.unit_rows(spark, sf))
    long = lambda c: F.col(c).cast("long").alias(c)
    return r.select("document_id", long("section"), "number", "method", F.col("confidence").cast("double").alias("confidence"), long("first_line"), long("last_line"))


@query(
    "st3_tables",
    f"""WITH {UNITS}, t AS (SELECT document_id, unit_index, len(string_split_regex(trim(text), ' *[|] *| {{2,}}')) AS cells, unit_index - row_number() OVER (PARTITION BY document_id ORDER BY unit_index) AS run FROM units WHERE unit_type = 'table'),
    g AS (SELECT document_id, min(unit_index) AS first_line, count(*) AS lines, min(cells) AS least, max(cells) AS columns FROM t GROUP BY document_id, run)
    SELECT document_id, first_line, lines, columns, CASE WHEN lines >= 2 AND least >= 3 THEN 'HIGH' WHEN columns >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS quality FROM g""",
)
def st3_tables(spark, sf):
    r = la.tables(qs.unit_rows(spark, sf))
    return r.select("document_id", F.col("first_line").cast("long").alias("first_line"), "lines", F.col("columns").cast("long").alias("columns"), "quality")


# --- text functions and tokenizers


@query("pj2_marks", r"""SELECT doc_id, sha256(regexp_replace(translate(text, chr(65533) || '’‘“”–—−' || chr(160), ' ''''""--- '), '[\p{C}\p{Z}]', ' ', 'g')) AS h FROM documents""")
def pj2_marks(spark, sf):
    return qc.docs(spark, sf).select("doc_id", F.sha2(tx.ascii_marks(F.col("text")), 256).alias("h"))


@query("pj9_paragraphs", r"SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS BIGINT) AS n FROM documents")
def pj9_paragraphs(spark, sf):
    return qc.docs(spark, sf).select("doc_id", F.size(tx.paragraphs(F.col("text"))).cast("long").alias("n"))


@query("pj4_keys")
def pj4_keys(spark, sf):
    return qc.docs(spark, sf).select("doc_id", F.sha2(tx.normalised_key(F.col("text")), 256).alias("key"))


@query("tk3_explain")
def tk3_explain(spark, sf):
    """Each token with the rule that made it."""
    return typed.rule_rows(qs.unit_rows(spark, sf), "unit_id")


@query("tk8_typed_components")
def tk8_typed_components(spark, sf):
    """Typed parts of the expressions of all units."""
    return qs.unit_rows(spark, sf).select("unit_id", F.inline(an.typed_parts(F.col("text"))))


@query("tk9_protected")
def tk9_protected(spark, sf):
    t = qs.unit_rows(spark, sf).select("unit_id", F.explode(an.protected_tokens(F.col("text"))).alias("term"))
    return t.where(F.col("term").rlike("[0-9]")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("cm2_preservation")
def cm2_preservation(spark, sf):
    """Share of the expressions of all units that come out of the hybrid tokenizer as exactly one term, by category."""
    u = qs.unit_rows(spark, sf).select("unit_id", "text").where(F.col("text").rlike("[0-9]"))
    spans = u.select("unit_id", F.inline(an.expression_spans(F.col("text")))).select("unit_id", "category", F.lower(F.regexp_replace("text", r"\s+", " ")).alias("term"))
    terms = u.select("unit_id", F.explode(an.hybrid_tokens(F.col("text"))).alias("term")).distinct().withColumn("kept", F.lit(1))
    joined = spans.join(terms, ["unit_id", "term"], "left").groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count("kept").alias("kept"))
    return joined.withColumn("share", F.round(F.col("kept") / F.col("n"), 4))


@query("cm7_orders")
def cm7_orders(spark, sf):
    """Both orders of stopword removal and stemming: tokens, vocabulary, type-token ratio, reductions."""
    t = an.stem_tokens(qc.toks(spark, sf))
    stop = lambda c: ~F.col(c).isin(*tk.STOPWORDS)
    before = t.agg(F.count(F.lit(1)).alias("before"))
    out = None
    for name, kept in (("A", t.where(stop("term"))), ("B", t.where(stop("stem")))):
        per = kept.groupBy("stem").agg(F.count(F.lit(1)).alias("n"))
        row = per.agg(F.lit(name).alias("pipeline"), F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("vocabulary"))
        out = row if out is None else out.unionByName(row)
    rows = out.crossJoin(before)
    return rows.select("pipeline", "tokens", "vocabulary", F.round(F.col("vocabulary") / F.col("tokens"), 6).alias("ttr"), tx.percent_reduction(F.col("before"), F.col("tokens")).alias("reduction"))


_RAW_TOKENS = {"words": tk.WORDS, "simple": tk.SIMPLE, "baseline": tk.BASELINE}


def _raw_sql(name: str) -> str:
    return f"SELECT '{name}' AS tokenizer, unnest(regexp_extract_all(text, '{_RAW_TOKENS[name].replace(chr(39), chr(39) * 2)}')) AS t FROM documents"


_LONG = ("tokens", "distinct_tokens", "vocabulary")
_LONG_SQL = " UNION ALL ".join(
    f"SELECT tokenizer, metric, value FROM (SELECT tokenizer, count(*) AS tokens, count(DISTINCT t) AS distinct_tokens, count(DISTINCT lower(t)) FILTER (regexp_matches(t, '\\p{{L}}')) AS vocabulary FROM ({_raw_sql(n)}) GROUP BY 1) "
    f"UNPIVOT (value FOR metric IN ({', '.join(_LONG)}))"
    for n in _RAW_TOKENS
)


@query("rp9_long", _LONG_SQL)
def rp9_long(spark, sf):
    """The measures of all tokenizers as long rows; types are counted by grouping, not by distinct counts."""
    out = None
    for name, pattern in _RAW_TOKENS.items():
        t = qc.docs(spark, sf).select(F.explode(tk.tokenize(F.col("text"), pattern, False)).alias("t"))
        types = t.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
        folded = types.where(F.col("t").rlike(r"\p{L}")).select(F.lower("t").alias("t")).distinct().agg(F.count(F.lit(1)).alias("vocabulary"))
        row = types.agg(F.lit(name).alias("tokenizer"), F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("distinct_tokens")).crossJoin(folded)
        rows = row.unpivot(["tokenizer"], list(_LONG), "metric", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("rp21_overview", f"SELECT arg_min(tokenizer, value) AS most_compact, min(value) AS tokens, (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT source) FROM documents) AS sources FROM ({_LONG_SQL}) WHERE metric = 'tokens'")
def rp21_overview(spark, sf):
    d = qc.docs(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("documents"), F.count("source").alias("sources"))
    t = rp9_long(spark, sf).where("metric = 'tokens'").agg(F.min_by("tokenizer", "value").alias("most_compact"), F.min("value").alias("tokens"))
    return t.crossJoin(d)


@query(
    "rp4_tokens_by_method",
    "SELECT tokenizer, t AS token, count(*) AS n FROM (" + " UNION ALL ".join(_raw_sql(n) for n in _RAW_TOKENS) + ") GROUP BY 1, 2",
)
def rp4_tokens_by_method(spark, sf):
    """All tokenizers over one input, as one tagged table."""
    def marked(name: str, pattern: str):
        return F.transform(tk.tokenize(F.col("text"), pattern, False), lambda t: F.struct(F.lit(name).alias("tokenizer"), t.alias("token")))

    every = F.concat(*(marked(n, p) for n, p in _RAW_TOKENS.items()))
    return qc.docs(spark, sf).select(F.inline(every)).groupBy("tokenizer", "token").agg(F.count(F.lit(1)).alias("n"))


_LIVE = "Rs. 1.25 lakh crore in FY2025-26, up 7.4% year-on-year; the U.S.A. said 'fine'."


@query("rp24_live")
def rp24_live(spark, sf):
    """Every tokenizer on one text."""
    d = spark.createDataFrame([(_LIVE,)], "text string")
    c = F.col("text")
    methods = {n: tk.tokenize(c, p, False) for n, p in _RAW_TOKENS.items()} | {"domain": F.transform(typed.rule_tokens(c), lambda x: x["token"]), "hybrid": an.hybrid_tokens(c), "protected": an.protected_tokens(c)}
    rows = d.select(F.explode(F.array(*(F.struct(F.lit(n).alias("tokenizer"), t.alias("tokens")) for n, t in methods.items()))).alias("x")).select("x.*")
    return rows.select("tokenizer", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("tokens"))


@query("rp14_collisions")
def rp14_collisions(spark, sf):
    """Stems of several words or several tokens, with both counts, for three stemmers."""
    words = qc.toks(spark, sf).where(F.col("term").rlike("^[a-z]+$")).groupBy("term").agg(F.count(F.lit(1)).alias("k"))
    out = None
    for name in ("porter", "snowball", "lancaster"):
        stems = words.join(an.map_vocabulary(words, morphology.STEMMERS[name], "stem"), "term")
        rows = stems.groupBy("stem").agg(F.sum("k").alias("tokens"), F.count(F.lit(1)).alias("surfaces")).where("tokens > 1").withColumn("method", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("rp6_examples")
def rp6_examples(spark, sf):
    """Of the first 40 expressions of each category the one of median length."""
    e = qs.unit_rows(spark, sf).where(F.col("text").rlike("[0-9]")).select("unit_id", F.inline(an.expression_spans(F.col("text"))))
    w = Window.partitionBy("category")
    first = e.withColumn("r", F.row_number().over(w.orderBy("unit_id", "start"))).where("r <= 40")
    ranked = first.withColumn("m", F.row_number().over(w.orderBy(F.length("text"), "unit_id", "start"))).withColumn("k", F.count(F.lit(1)).over(w))
    return ranked.where("m = floor(k / 2) + 1").select("category", "unit_id", "text")


_BEFORE = f"""WITH {UNITS}, a AS (SELECT unit_id, text, regexp_extract_all(lower(text), '[\\p{{L}}0-9]+') AS t FROM units)
SELECT unit_id, substr(text, 1, 600) AS before, substr(array_to_string(t, ' '), 1, 600) AS tokens, substr(array_to_string(list_filter(t, lambda w: w NOT IN {qc.STOP}), ' '), 1, 600) AS content FROM a"""


@query("rp8_before_after", _BEFORE)
def rp8_before_after(spark, sf):
    """The first 600 characters of each unit as it is, as tokens, and as tokens without stopwords: a report's columns."""
    t = qs.unit_rows(spark, sf).select("unit_id", "text", F.explode(F.array(tk.tokenize(F.col("text")))).alias("t"))
    cut = lambda c: F.substring(c, 1, 600)
    return t.select("unit_id", cut(F.col("text")).alias("before"), cut(F.array_join("t", " ")).alias("tokens"), cut(F.array_join(tk.drop_stopwords(F.col("t")), " ")).alias("content"))


_PROTECTED, _EXTRA = ("not", "nor", "may", "zwar"), ("may", "per", "cent")


@query(
    "rp13_stoplist",
    "SELECT w AS word FROM (SELECT unnest(" + "[" + ", ".join(f"'{w}'" for w in tk.STOPWORDS) + "]) AS w) WHERE w NOT IN " + _in(_PROTECTED) + " UNION SELECT unnest([" + ", ".join(f"'{w}'" for w in _EXTRA) + "])",
)
def rp13_stoplist(spark, sf):
    """(standard without protected) with extra words: an extra word is in the list even if it is protected."""
    own = F.array_union(F.array_except(F.array(*map(F.lit, tk.STOPWORDS)), F.array(*map(F.lit, _PROTECTED))), F.array(*map(F.lit, _EXTRA)))
    return spark.range(1).select(F.explode(own).alias("word"))


# --- samples

#: Categories of illustrative units and what their text must hold; table_text asks for the unit's type.
SAMPLE = {
    "normal_economic_paragraph": r"(?i)econom|growth|inflation",
    "paragraph_containing_dates": r"\b(20[12]\d|January|February|March|April|September|October|November|December|quarter)\b",
    "paragraph_containing_percentages": r"%|per cent",
    "paragraph_containing_currency": r"[₹$€£]|Rs\.?\s|₹",
    "paragraph_containing_abbreviations": r"\b(GDP|GVA|CPI|WPI|FDI|RBI|SEBI|IMF|NP|GST)\b",
    "paragraph_containing_financial_institutions": r"\b(bank|Bank|RBI|SEBI|NBFC|commercial bank|financial institution|IMF|World Bank)\b",
    "paragraph_containing_hyphenated_terminology": r"[a-zA-Z]{3,}-[a-zA-Z]{3,}",
    "paragraph_containing_numerical_expressions": r"(?i)\d[\d,.]*\s*(lakh|crore|billion|million|trillion|mn|bn)",
    "rare_domain_specific_terminology": r"(?i)\b(demonetisation|disinflation|securitisation|macroeconomic|financialisation|capitalisation|nowcasting|insolvency|procyclical)\b",
}
_PICK = "SELECT '{n}' AS category, unit_id, document_id, unit_type, length(text) AS char_count, replace(text, chr(10), ' | ') AS text FROM (SELECT *, row_number() OVER (ORDER BY length(text), unit_id) AS r, count(*) OVER () AS n FROM units WHERE {w}) WHERE r = n // 2 + 1"
_SAMPLE_SQL = " UNION ALL ".join(
    [_PICK.format(n=n, w=f"unit_type = 'paragraph' AND regexp_matches(text, '{p}')" + (" AND length(text) > 200" if n.startswith("normal") else "")) for n, p in SAMPLE.items()] + [_PICK.format(n="table_text", w="unit_type = 'table'")]
)


@query("fl9_representative", f"WITH {UNITS} {_SAMPLE_SQL}")
def fl9_representative(spark, sf):
    """The unit of median length of each of ten categories, by an exact rank over length counts, then over that length only."""
    u = qs.unit_rows(spark, sf)
    paragraph = F.col("unit_type") == "paragraph"
    marks = [F.when(paragraph & F.col("text").rlike(p) & (F.length("text") > (200 if n.startswith("normal") else 0)), F.lit(n)) for n, p in SAMPLE.items()]
    marks.append(F.when(F.col("unit_type") == "table", F.lit("table_text")))
    rows = u.select(F.explode(F.filter(F.array(*marks), lambda x: x.isNotNull())).alias("category"), F.length("text").alias("char_count"), "unit_id")
    by = rows.groupBy("category", "char_count").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("category")
    runs = by.withColumn("below", F.coalesce(F.sum("k").over(w.orderBy("char_count").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("k").over(w))
    at = runs.withColumn("want", F.floor(F.col("n") / 2) + 1).where("want > below and want <= below + k").select("category", "char_count", (F.col("want") - F.col("below")).alias("r"))
    inside = rows.join(at, ["category", "char_count"]).withColumn("i", F.row_number().over(Window.partitionBy("category").orderBy("unit_id"))).where("i = r")
    return inside.select("category", "unit_id", F.col("char_count").cast("long").alias("char_count")).join(u, "unit_id").select("category", "unit_id", "document_id", "unit_type", "char_count", F.replace("text", F.lit("\n"), F.lit(" | ")).alias("text"))


@query("rp1_sample", f"WITH {UNITS} SELECT unit_id, document_id, length(text) AS char_count, row_number() OVER (ORDER BY unit_id) AS place FROM units WHERE unit_type IN ('paragraph', 'table')")
def rp1_sample(spark, sf):
    """The frozen input of all experiments: the selected units in the order of their ids, numbered over key ranges."""
    u = qs.unit_rows(spark, sf).where(F.col("unit_type").isin("paragraph", "table")).select("unit_id", "document_id", F.length("text").cast("long").alias("char_count"))
    return numbered(u, "unit_id").select("unit_id", "document_id", "char_count", F.col("number").cast("long").alias("place"))


_EXPERIMENTS = ("tokenization", "stopwords", "stemming")


@query(
    "rp3_manifest",
    f"WITH {UNITS}, s AS (SELECT unit_id, document_id, row_number() OVER (ORDER BY unit_id) AS place FROM units WHERE unit_type IN ('paragraph', 'table')) SELECT e AS experiment_id, unit_id, document_id, place FROM s, (VALUES "
    + ", ".join(f"('{e}')" for e in _EXPERIMENTS) + ") v(e)",
)
def rp3_manifest(spark, sf):
    """One row for each experiment and unit of the sample."""
    return rp1_sample(spark, sf).select(F.explode(F.array(*map(F.lit, _EXPERIMENTS))).alias("experiment_id"), "unit_id", "document_id", "place")


# --- registries and documents

_RULES = ((1, "^src1[0-9]$", "^d0000", "LATE_FIRST"), (2, "^src1[0-9]$", ".*", "LATE"), (3, "^src[0-4]$", "[02468][.]txt$", "EARLY_EVEN"))
_RULE_CASE = " ".join(f"WHEN regexp_matches(source, '{a}') AND regexp_matches(printf('d%06d.txt', doc_id), '{b}') THEN '{r}'" for _, a, b, r in _RULES)


@query("sc4_rules", f"SELECT doc_id, CASE {_RULE_CASE} ELSE 'UNKNOWN' END AS resolved FROM documents")
def sc4_rules(spark, sf):
    """The first rule whose folder and file name both match; the rules are a broadcast table joined by what they match."""
    rules = F.broadcast(spark.createDataFrame(_RULES, "rule_order int, folder string, file string, resolved string"))
    d = registry(qc.docs(spark, sf)).select("doc_id", "source_id", "filename")
    hits = d.join(rules, F.expr("rlike(source_id, folder) and rlike(filename, file)"), "left")
    best = hits.groupBy("doc_id").agg(F.min_by("resolved", "rule_order").alias("r"))
    return best.select("doc_id", F.coalesce("r", F.lit("UNKNOWN")).alias("resolved"))


@query(
    "sc5_derived",
    f"""WITH {UNITS}, h AS (SELECT document_id, arg_min(text, unit_index) AS title FROM units WHERE unit_type = 'heading' GROUP BY 1), d AS (SELECT *, printf('D%06d', doc_id) AS document_id, regexp_extract(text, '(19|20)[0-9]{{2}}(-?[0-9]{{2}})?') AS y FROM documents)
    SELECT doc_id, coalesce(title, printf('d%06d', doc_id)) AS title, CASE WHEN title IS NULL THEN 'inferred_from_filename' ELSE 'first_heading' END AS title_provenance, coalesce(source, 'UNKNOWN') AS publisher,
    CASE WHEN source IS NULL THEN 'missing' ELSE 'inferred_from_folder' END AS publisher_provenance, CASE WHEN y = '' THEN 'UNKNOWN' ELSE y END AS year, CASE WHEN y = '' THEN 'missing' ELSE 'text' END AS year_provenance,
    CASE WHEN title IS NOT NULL THEN 'report' WHEN n_chars < 300 THEN 'note' ELSE 'article' END AS document_type FROM d LEFT JOIN h USING (document_id)""",
)
def sc5_derived(spark, sf):
    """Title, publisher, year and type of each document, each with where it comes from."""
    u = qs.unit_rows(spark, sf).where("unit_type = 'heading'").groupBy("document_id").agg(F.min_by("text", "unit_index").alias("title"))
    year = F.regexp_extract("text", "(19|20)[0-9]{2}(-?[0-9]{2})?", 0)
    d = qc.docs(spark, sf).select("doc_id", "source", "n_chars", F.format_string("D%06d", "doc_id").alias("document_id"), year.alias("y")).join(u, "document_id", "left")
    none = F.col("y") == ""
    return d.select(
        "doc_id", F.coalesce("title", F.format_string("d%06d", "doc_id")).alias("title"), F.when(F.col("title").isNull(), "inferred_from_filename").otherwise("first_heading").alias("title_provenance"),
        F.coalesce("source", F.lit("UNKNOWN")).alias("publisher"), F.when(F.col("source").isNull(), "missing").otherwise("inferred_from_folder").alias("publisher_provenance"),
        F.when(none, "UNKNOWN").otherwise(F.col("y")).alias("year"), F.when(none, "missing").otherwise("text").alias("year_provenance"),
        F.when(F.col("title").isNotNull(), "report").when(F.col("n_chars") < 300, "note").otherwise("article").alias("document_type"),
    )


@query(
    "sc3_kept_ids",
    """WITH old AS (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) AS n FROM documents WHERE lang = 'en'),
    new AS (SELECT doc_id, (SELECT count(*) FROM old) + row_number() OVER (ORDER BY source, doc_id) AS n FROM documents WHERE lang <> 'en' OR lang IS NULL)
    SELECT doc_id, printf('D%02d', n) AS assigned FROM (SELECT * FROM old UNION ALL SELECT * FROM new)""",
)
def sc3_kept_ids(spark, sf):
    """An earlier registry, here that of the English documents, keeps its ids; all others are numbered after them."""
    d = qc.docs(spark, sf).select("doc_id", "source", "lang")
    old = numbered(d.where("lang = 'en'"), "source", "doc_id").select("doc_id", "number")
    rest = numbered(d.join(old.select("doc_id"), "doc_id", "left_anti"), "source", "doc_id").select("doc_id", "number")
    last = old.agg(F.coalesce(F.max("number"), F.lit(0)).alias("last"))
    every = old.unionByName(rest.crossJoin(last).select("doc_id", (F.col("number") + F.col("last")).alias("number")))
    return every.select("doc_id", F.format_string("D%02d", "number").alias("assigned"))


@query("fl4_documents", "SELECT doc_id, source, lang, n_chars FROM documents WHERE lang = 'en' AND source = 'src3' AND (contains(lower(text), 'the') OR contains(source, 'the') OR contains(lang, 'the') OR contains(printf('d%06d.txt', doc_id), 'the'))")
def fl4_documents(spark, sf):
    d = qc.docs(spark, sf).withColumn("filename", F.format_string("d%06d.txt", "doc_id"))
    return tx.matching(d, {"lang": "en", "source": "src3", "status": None}, "The", ("text", "source", "lang", "filename")).select("doc_id", "source", "lang", "n_chars")


@query("fl8_ids", "SELECT source AS id, regexp_matches(source, '^[A-Za-z0-9_]{1,120}$') AS good, count(*) AS n FROM (SELECT source FROM documents UNION ALL SELECT * FROM (VALUES ('../etc'), (''), ('a b'), ('ok_1'))) GROUP BY 1, 2")
def fl8_ids(spark, sf):
    """Each id asked for, and whether it may be used."""
    asked = qc.docs(spark, sf).select(F.col("source").alias("id")).unionByName(spark.createDataFrame([("../etc",), ("",), ("a b",), ("ok_1",)], "id string"))
    return asked.groupBy("id", tx.is_safe_id(F.col("id")).alias("good")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "jn3_registry",
    f"""WITH {UNITS}, s AS (SELECT document_id, count(*) AS units FROM units GROUP BY 1)
    SELECT d.doc_id, coalesce(s.units, 0) AS units, l.quality, sha256(d.text) AS sha256, CASE WHEN octet_length(encode(d.text)) < 512 THEN 'INVALID' ELSE 'OK' END AS status, octet_length(encode(d.text)) AS bytes
    FROM documents d LEFT JOIN s ON s.document_id = printf('D%06d', d.doc_id) LEFT JOIN labels l USING (doc_id)""",
)
def jn3_registry(spark, sf):
    """Registry with statistics, quality and inventory: three left joins."""
    d = qc.docs(spark, sf)
    s = qs.unit_rows(spark, sf).groupBy("document_id").agg(F.count(F.lit(1)).alias("units"))
    inventory = registry(d).select("doc_id", "sha256", "status", "bytes")
    rows = d.select("doc_id", F.format_string("D%06d", "doc_id").alias("document_id")).join(s, "document_id", "left").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.join(inventory, "doc_id", "left").select("doc_id", F.coalesce("units", F.lit(0)).alias("units"), "quality", "sha256", "status", "bytes")


@query(
    "jn8_entities_by_unit",
    f"WITH {_NAMES} SELECT u.unit_id, count(f.entity) AS n, coalesce(string_agg(f.label || ':' || f.entity, ';' ORDER BY f.label, f.entity), '') AS entities FROM units u LEFT JOIN found f USING (unit_id) GROUP BY 1",
)
def jn8_entities_by_unit(spark, sf):
    """Units with what was found in them, those without anything among them."""
    e = found_entities(spark, sf).groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("label", "entity"))).alias("x"))
    listed = F.array_join(F.transform("x", lambda r: F.concat_ws(":", r["label"], r["entity"])), ";")
    return qs.unit_rows(spark, sf).select("unit_id").join(e, "unit_id", "left").select("unit_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(listed, F.lit("")).alias("entities"))


@query(
    "rp20_documents",
    f"""WITH {UNITS}, p AS (SELECT document_id, unit_type, count(*) AS n FROM units GROUP BY 1, 2)
    SELECT document_id, count(*) AS units, count(DISTINCT unit_index // 40) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, (SELECT string_agg(unit_type || ':' || n, ';' ORDER BY unit_type) FROM p WHERE p.document_id = u.document_id) AS by_type FROM units u GROUP BY 1""",
)
def rp20_documents(spark, sf):
    """The page of each document: units, pages, characters, units by type."""
    u = structured(qs.unit_rows(spark, sf))
    pages = u.groupBy("document_id", "page_number").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("c"))
    sums = pages.groupBy("document_id").agg(F.sum("n").alias("units"), F.count(F.lit(1)).alias("pages"), F.sum("c").alias("chars"))
    types = u.groupBy("document_id", "unit_type").agg(F.count(F.lit(1)).alias("n")).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("unit_type", "n"))).alias("x"))
    return sums.join(types, "document_id").select("document_id", "units", "pages", "chars", F.array_join(F.transform("x", lambda r: F.concat_ws(":", r["unit_type"], r["n"])), ";").alias("by_type"))


@query(
    "rp25_sources",
    f"""WITH {UNITS}, r AS (SELECT source AS source_id, count(*) AS documents, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, count(*) FILTER (octet_length(encode(text)) < 512) AS invalid FROM documents GROUP BY 1),
    s AS (SELECT source_id, count(*) AS units, count(*) FILTER (unit_type = 'table') AS tables FROM units GROUP BY 1) SELECT source_id, documents, bytes, invalid, coalesce(units, 0) AS units, coalesce(tables, 0) AS tables FROM r LEFT JOIN s USING (source_id)""",
)
def rp25_sources(spark, sf):
    """The source registry: documents, size, what is too small, units and tables."""
    r = registry(qc.docs(spark, sf)).groupBy("source_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("bytes").alias("bytes"), F.count_if(F.col("status") == "INVALID").alias("invalid"))
    s = qs.unit_rows(spark, sf).groupBy("source_id").agg(F.count(F.lit(1)).alias("units"), F.count_if(F.col("unit_type") == "table").alias("tables"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return r.join(s, "source_id", "left").select("source_id", "documents", "bytes", "invalid", none("units"), none("tables"))


@query(
    "rp22_typed",
    "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, try_cast(event_type AS BIGINT) AS type_number, try_cast(CAST(value AS VARCHAR) AS DOUBLE) AS value, array_to_string(list_filter(string_split(event_type || ';a; ;b', ';'), lambda x: trim(x) <> ''), '|') AS parts FROM events",
)
def rp22_typed(spark, sf):
    """Text columns read with tolerant types: what does not parse is null."""
    e = table(spark, sf, "events")
    return e.select(
        "event_id", tx.as_int(F.get_json_object("props", "$.k")).alias("k"), tx.as_int(F.col("event_type")).alias("type_number"), tx.as_float(F.col("value").cast("string")).alias("value"),
        F.array_join(tx.split_list(F.concat("event_type", F.lit(";a; ;b"))), "|").alias("parts"),
    )


@query(
    "rp16_list_forms",
    f"""WITH {POSTINGS}, w AS (SELECT unit_id, list(DISTINCT term) AS t FROM postings GROUP BY 1), f AS (SELECT unit_id, list_contains(t, 'the') AS a, list_contains(t, 'of') AS b, list_contains(t, 'th') AS c FROM w)
    SELECT 'all' AS form, count(*) FILTER (a AND b) AS n FROM f UNION ALL SELECT 'any', count(*) FILTER (a OR b OR c) FROM f UNION ALL SELECT 'but', count(*) FILTER (a AND NOT b AND NOT c) FROM f""",
)
def rp16_list_forms(spark, sf):
    """Queries built from lists of operands."""
    forms = {"all": se.all_of("the", "of"), "any": se.any_of("the", "of", "th"), "but": se.all_but("the", "of", "th")}
    hits = se.matches(qs.posting_rows(spark, sf), forms)
    n = hits.groupBy(F.col("query_id").alias("form")).agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([(f,) for f in forms], "form string").join(n, "form", "left").select("form", F.coalesce("n", F.lit(0)).alias("n"))


# --- measures of tokenizers, snippets, lemmas

_CLASS_LONG = ", ".join(f"CAST(coalesce(sum(n) FILTER ({c}), 0) AS BIGINT) AS {k}_tokens" for k, c in qs._CLASS_SQL.items())


@query(
    "ag18_tokenizer_metrics",
    " UNION ALL ".join(
        f"SELECT '{n}' AS tokenizer, CAST(sum(n) AS BIGINT) AS total_tokens, count(*) AS unique_tokens, count(DISTINCT CASE WHEN regexp_matches(t, '\\p{{L}}') THEN lower(t) END) AS vocabulary_size, "
        f"round(sum(n) / CAST((SELECT count(*) FROM documents) AS DOUBLE), 2) AS avg_tokens_per_document, {_CLASS_LONG} FROM (SELECT t, count(*) AS n FROM ({_raw_sql(n)}) GROUP BY 1)"
        for n in _RAW_TOKENS
    ),
)
def ag18_tokenizer_metrics(spark, sf):
    """The measures of each tokenizer; classes are tested once for each different token."""
    d, out = qc.docs(spark, sf), None
    documents = d.agg(F.count(F.lit(1)).alias("documents"))
    own = tk.classes(F.col("t"))
    for name, pattern in _RAW_TOKENS.items():
        types = d.select(F.explode(tk.tokenize(F.col("text"), pattern, False)).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
        flagged = types.select("n", F.when(F.col("t").rlike(r"\p{L}"), F.lower("t")).alias("low"), *(F.when(own[c], F.col("n")).otherwise(0).alias(c) for c in tk.CLASSES))
        per = flagged.groupBy("low").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), *(F.sum(c).alias(c) for c in tk.CLASSES))
        row = per.agg(F.lit(name).alias("tokenizer"), F.sum("n").alias("total_tokens"), F.sum("k").alias("unique_tokens"), F.count("low").alias("vocabulary_size"), *(F.sum(c).alias(f"{c}_tokens") for c in tk.CLASSES))
        out = row if out is None else out.unionByName(row)
    rows = out.crossJoin(documents)
    return rows.withColumn("avg_tokens_per_document", F.round(F.col("total_tokens") / F.col("documents"), 2)).drop("documents")


@query("ag20_survival")
def ag20_survival(spark, sf):
    """Expressions by category and in all, and how many a plain tokenizer leaves in one piece."""
    u = qs.unit_rows(spark, sf).where(F.col("text").rlike("[0-9]")).select("unit_id", "text")
    spans = u.select("unit_id", F.inline(an.expression_spans(F.col("text")))).select("unit_id", "category", F.col("text").alias("token"))
    tokens = u.select("unit_id", F.explode(tk.tokenize(F.col("text"), tk.SIMPLE, False)).alias("token")).distinct().withColumn("x", F.lit(1))
    joined = spans.join(tokens, ["unit_id", "token"], "left")
    rows = joined.rollup("category").agg(F.count(F.lit(1)).alias("detected"), F.count("x").alias("intact"))
    return rows.select(F.coalesce("category", F.lit("TOTAL")).alias("category"), "detected", "intact", F.round(F.col("intact") * 100.0 / F.col("detected"), 2).alias("percent"))


@query(
    "rp5_strided_examples",
    f"WITH {UNITS}, c AS (SELECT unit_id, row_number() OVER (PARTITION BY source_id ORDER BY unit_id) AS r FROM units WHERE length(text) BETWEEN 40 AND 400) SELECT unit_id FROM c WHERE r % 50 = 1",
)
def rp5_strided_examples(spark, sf):
    """Every fiftieth unit of a source: numbered over key ranges, so that a large source is many tasks."""
    u = qs.unit_rows(spark, sf).where(F.length("text").between(40, 400)).select("source_id", "unit_id")
    rows = numbered(u, "source_id", "unit_id")
    first = rows.groupBy("source_id").agg(F.min("number").alias("first")).withColumnRenamed("source_id", "s")
    placed = rows.join(F.broadcast(first), F.col("source_id").eqNullSafe(F.col("s")))  # one row a source
    return placed.where((F.col("number") - F.col("first")) % 50 == 0).select("unit_id")


@query("ix15_snippets")
def ix15_snippets(spark, sf):
    """Snippets of the capped hits, around the phrase where the query has one; texts are joined after the cap."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, terms: pd.Series, phrase: pd.Series) -> pd.Series:
        return pd.Series([snippets.snippet(t, w.split(";"), p) for t, w, p in zip(text, terms, phrase)])

    asked = [(q, next((" ".join(leaf.words) for leaf, yes in ql.leaves(ql.parse(t)) if yes and len(leaf.words) > 1), "")) for q, t in qs.QUERY_SET.items()]
    hits = qs.ix17_query_set(spark, sf).select("query_id", "rank", "unit_id", "matched_terms").join(F.broadcast(spark.createDataFrame(asked, "query_id string, phrase string")), "query_id")
    texts = qs.index_units(spark, sf).select("unit_id", "text")
    return hits.join(texts, "unit_id").select("query_id", "rank", "unit_id", cut("text", "matched_terms", "phrase").alias("snippet"))


@query("mo6_lemma_comparison")
def mo6_lemma_comparison(spark, sf):
    """Distinct terms that each way to lemmatise leaves, against none: by table, by its verbs only, by rules, by a light stemmer."""
    words = qs.term_rows(spark, sf).select("term").where(F.col("term").rlike("^[a-z]+$"))
    t = spark.createDataFrame(_LEMMAS, "form string, lemma string, tag string")
    methods = {
        "table": tg.lookup_lemmas(words, t), "table_of_verbs": tg.lookup_lemmas(words, t, ("VERB",)), "rules": an.map_vocabulary(words, morphology.lemma, "lemma"),
        "light": an.map_vocabulary(words, morphology.light, "lemma"),
    }
    out = None
    for name, rows in methods.items():
        per = rows.groupBy("lemma").agg(F.count(F.lit(1)).alias("k"))
        row = per.agg(F.lit(name).alias("method"), F.sum("k").alias("before"), F.count(F.lit(1)).alias("after"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("reduction", tx.percent_reduction(F.col("before"), F.col("after")))
