"""Queries: text functions, filters, statistics, n-grams, duplicates, joins, rules, annotation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions import tokens as tk
from corvane.functions import typed
from corvane.operators import annotate as an
from corvane.operators import chunks
from corvane.operators import index as ix
from corvane.operators import statistics as st
from corvane.plans.q_search import term_rows, unit_rows
from corvane.plans.queries import TERMS, TOKENS, UNITS, query
from corvane.sources.corpus import numbered, page_sections, table, turns

STOP = "(" + ", ".join(f"'{w}'" for w in tk.STOPWORDS) + ")"
_DOCS = "documents"


def docs(spark, sf):
    return table(spark, sf, "documents")


def toks(spark, sf):
    return ix.tokens(unit_rows(spark, sf))


# --- scalar text functions


@query("pj1_normalise", r"SELECT doc_id, sha256(regexp_replace(replace(text, chr(65533), ' '), '[\r\n]+', ' ', 'g')) AS h FROM documents")
def pj1_normalise(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2(tx.normalise_for_tokens(F.col("text")), 256).alias("h"))


@query("pj3_clean", r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' *\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')) AS h FROM documents""")
def pj3_clean(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2(tx.clean_text(F.col("text")), 256).alias("h"))


@query("pj4_casefold_words", r"SELECT doc_id, len(list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda w: w <> '')) AS n_words, sha256(replace(lower(text), 'ß', 'ss')) AS folded FROM documents")
def pj4_casefold_words(spark, sf):
    return docs(spark, sf).select("doc_id", tx.count_words(F.col("text")).alias("n_words"), F.sha2(tx.casefold(F.col("text")), 256).alias("folded"))


@query("pj5_join_wrapped", r"SELECT doc_id, sha256(replace(regexp_replace(text, '-\n([a-z])', '\1', 'g'), chr(10), ' ')) AS h FROM documents")
def pj5_join_wrapped(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2(tx.join_wrapped(F.col("text")), 256).alias("h"))


@query(
    "pj6_furniture",
    f"""WITH {UNITS}, n AS (SELECT source_id, count(DISTINCT document_id) AS n FROM units GROUP BY 1),
    s AS (SELECT source_id, trim(text) AS line, count(DISTINCT document_id) AS pages FROM units GROUP BY 1, 2)
    SELECT source_id, line, pages FROM s JOIN n USING (source_id) WHERE pages >= greatest(3, floor(n * 0.05))""",
)
def pj6_furniture(spark, sf):
    return st.furniture(unit_rows(spark, sf), 3, 0.05)


@query(
    "pj6_strip",
    f"""WITH {UNITS}, n AS (SELECT source_id, count(DISTINCT document_id) AS n FROM units GROUP BY 1),
    s AS (SELECT source_id, trim(text) AS line, count(DISTINCT document_id) AS pages FROM units GROUP BY 1, 2),
    f AS (SELECT source_id, line FROM s JOIN n USING (source_id) WHERE pages >= greatest(3, floor(n * 0.05)))
    SELECT document_id, count(*) AS left_units FROM units u WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.source_id = u.source_id AND f.line = trim(u.text)) GROUP BY 1""",
)
def pj6_strip(spark, sf):
    u = unit_rows(spark, sf)
    return st.strip_furniture(u, st.furniture(u, 3, 0.05)).groupBy("document_id").agg(F.count(F.lit(1)).alias("left_units"))


@query(
    "pj7_rotation",
    f"""WITH {UNITS} SELECT count(*) FILTER (len(regexp_extract_all(text, '[A-Za-z]')) >= 6
    AND len(regexp_extract_all(text, '[a-z]')) > len(regexp_extract_all(text, '[A-Za-z]')) * 0.9) AS n FROM units""",
)
def pj7_rotation(spark, sf):
    return unit_rows(spark, sf).agg(F.count_if(tx.is_rotation_private(F.col("text"))).alias("n"))


@query("pj10_citation", f"WITH {UNITS} SELECT unit_id, concat_ws(' | ', document_id, 'p' || (unit_index // 40 + 1), CASE WHEN unit_type = 'heading' THEN unit_type END, unit_id) AS citation FROM units")
def pj10_citation(spark, sf):
    page = (F.floor(F.col("unit_index") / 40) + 1).cast("string")
    section = F.when(F.col("unit_type") == "heading", F.col("unit_type")).otherwise("")
    return unit_rows(spark, sf).select("unit_id", tx.citation(F.col("document_id"), page, section, F.col("unit_id")).alias("citation"))


@query(
    "pj11_truncate",
    """WITH h AS (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents), g AS (SELECT *, substr(t, 1, 217) AS head, instr(reverse(substr(t, 1, 217)), ' ') AS b FROM h)
    SELECT doc_id, CASE WHEN length(t) <= 220 THEN t ELSE rtrim(CASE WHEN b > 0 AND length(head) - b > 110 THEN substr(head, 1, length(head) - b) ELSE head END) || '...' END AS snippet FROM g""",
)
def pj11_truncate(spark, sf):
    return docs(spark, sf).select("doc_id", tx.truncate(F.replace("text", F.lit("\n"), F.lit(" ")), 220).alias("snippet"))


@query("pj12_coerce", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, lower(event_type) IN ('true', '1', 'yes') AS b FROM events")
def pj12_coerce(spark, sf):
    return table(spark, sf, "events").select("event_id", tx.as_int(F.get_json_object("props", "$.k")).alias("k"), tx.as_bool(F.col("event_type")).alias("b"))


# --- filters


@query("fl1_policy", f"WITH {UNITS} SELECT unit_type, count(*) AS n FROM units WHERE unit_type IN ('paragraph', 'table') AND trim(text) <> '' GROUP BY 1")
def fl1_policy(spark, sf):
    u = unit_rows(spark, sf).where(F.col("unit_type").isin("paragraph", "table") & (F.trim("text") != ""))
    return u.groupBy("unit_type").agg(F.count(F.lit(1)).alias("n"))


@query("fl2_stopwords", f"WITH {TOKENS} SELECT document_id, count(*) AS before, count(*) FILTER (term NOT IN {STOP}) AS after FROM tokens GROUP BY 1")
def fl2_stopwords(spark, sf):
    u = unit_rows(spark, sf).select("document_id", tk.tokenize(F.col("text")).alias("t")).where(F.size("t") > 0)
    return u.groupBy("document_id").agg(F.sum(F.size("t")).alias("before"), F.sum(F.size(tk.drop_stopwords(F.col("t")))).alias("after"))


_SHAPES = [("7",), ("%",), ("%5",), ("5%",), ("-",), ("--3",), ("per cent",), ("fy26",), ("250",), ("3.5",), ("",), ("½",), ("_",)]


@query(
    "fl3_indexable",
    f"""WITH {TOKENS}, w AS (SELECT DISTINCT term FROM tokens UNION SELECT term FROM (VALUES {', '.join(f"('{x}')" for (x,) in _SHAPES)}) v(term)
    UNION SELECT DISTINCT unnest(string_split_regex(text, '[ \\n]+')) FROM documents)
    SELECT term FROM w WHERE term <> '' AND (regexp_matches(term, '[\\p{{L}}\\p{{No}}\\p{{Nl}}]')
    OR (regexp_matches(term, '[0-9]') AND regexp_matches(lower(term), '^(%|per *cent|percent|fy[0-9]|fiscal|[0-9][0-9]? +[a-z][a-z][a-z]|[0-9])')))""",
)
def fl3_indexable(spark, sf):
    raw = docs(spark, sf).select(F.explode(F.split("text", r"[ \n]+")).alias("term"))
    w = toks(spark, sf).select("term").unionByName(raw).unionByName(spark.createDataFrame(_SHAPES, "term string"))
    return w.where(tk.is_indexable(F.col("term"))).distinct()


@query("fl7_judgments", "SELECT doc_id, quality, toxic FROM labels WHERE quality = 1")
def fl7_judgments(spark, sf):
    return table(spark, sf, "labels").where("quality = 1").select("doc_id", "quality", "toxic")


# --- statistics


@query(
    "ag1_totals",
    f"""WITH {TOKENS} SELECT count(*) AS tokens, count(DISTINCT term) AS unique_terms, count(DISTINCT term) FILTER (regexp_matches(term, '\\p{{L}}')) AS vocabulary,
    count(DISTINCT unit_id) AS units, count(DISTINCT document_id) AS documents, round(count(DISTINCT term) / CAST(count(*) AS DOUBLE), 6) AS ttr FROM tokens""",
)
def ag1_totals(spark, sf):
    return st.corpus_totals(unit_rows(spark, sf))


@query("ag2_frequencies", f"WITH {TOKENS} SELECT term, count(*) AS term_frequency, count(DISTINCT unit_id) AS unit_frequency, count(DISTINCT document_id) AS document_frequency FROM tokens GROUP BY 1")
def ag2_frequencies(spark, sf):
    return st.frequencies(unit_rows(spark, sf))


@query("ag3_first_seen", f"WITH {TOKENS} SELECT term, unit_id AS first_unit, pos AS first_pos FROM tokens QUALIFY row_number() OVER (PARTITION BY term ORDER BY unit_id, pos) = 1")
def ag3_first_seen(spark, sf):
    return st.first_seen(toks(spark, sf))


@query(
    "ag4_document_statistics",
    f"""WITH {UNITS} SELECT document_id, count(*) AS units, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len(regexp_extract_all(lower(text), '[\\p{{L}}0-9]+'))) AS BIGINT) AS words,
    count(*) FILTER (unit_type = 'paragraph') AS paragraphs, count(*) FILTER (unit_type = 'heading') AS headings, count(*) FILTER (unit_type = 'table') AS tables FROM units GROUP BY 1""",
)
def ag4_document_statistics(spark, sf):
    return st.document_statistics(unit_rows(spark, sf))


@query("ag5_corpus", "SELECT count(*) AS documents, count(DISTINCT source) AS sources, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS longest, round(avg(n_chars), 4) AS mean_chars, count(DISTINCT lang) AS langs FROM documents")
def ag5_corpus(spark, sf):
    return docs(spark, sf).agg(
        F.count(F.lit(1)).alias("documents"), F.countDistinct("source").alias("sources"), F.sum("n_chars").alias("chars"),
        F.max("n_chars").alias("longest"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.countDistinct("lang").alias("langs"),
    )


@query("ag6_vocabulary", f"WITH {TOKENS} SELECT term, count(*) AS freq, count(DISTINCT document_id) AS docs FROM tokens GROUP BY 1 ORDER BY freq DESC, term LIMIT 100")
def ag6_vocabulary(spark, sf):
    f = st.frequencies(unit_rows(spark, sf)).select("term", F.col("term_frequency").alias("freq"), F.col("document_frequency").alias("docs"))
    return st.top(f, "freq", "term", 100)


@query("ex_event_types", "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean_value, round(median(value), 4) AS median_value, round(max(value), 4) AS max_value FROM events GROUP BY 1")
def ex_event_types(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(v), 4).alias("mean_value"), F.round(F.median(v), 4).alias("median_value"), F.round(F.max(v), 4).alias("max_value")
    )


@query("ag15_overview", f"WITH {UNITS} SELECT source_id, lang, unit_type, count(*) AS n FROM units GROUP BY 1, 2, 3")
def ag15_overview(spark, sf):
    return unit_rows(spark, sf).groupBy("source_id", "lang", "unit_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ag20_rollup",
    """SELECT coalesce(c, 'TOTAL') AS category, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(t, '^(19|20)[0-9]{2}$') THEN 'year' WHEN regexp_matches(t, '%') THEN 'percentage'
    WHEN regexp_matches(t, '^[0-9]+$') THEN 'integer' ELSE 'other' END AS c FROM (SELECT unnest(string_split_regex(text, '[ \\n]+')) AS t FROM documents) WHERE regexp_matches(t, '[0-9]')) GROUP BY ROLLUP (c)""",
)
def ag20_rollup(spark, sf):
    t = docs(spark, sf).select(F.explode(F.split("text", r"[ \n]+")).alias("t")).where(F.col("t").rlike("[0-9]"))
    kind = F.when(F.col("t").rlike("^(19|20)[0-9]{2}$"), "year").when(F.col("t").rlike("%"), "percentage").when(F.col("t").rlike("^[0-9]+$"), "integer").otherwise("other")
    return t.select(kind.alias("c")).rollup("c").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("c", F.lit("TOTAL")).alias("category"), "n")


#: Stopword lists: none, the ordinary one, and the ordinary one that protects some words and has some more.
STRATEGIES = {"none": (), "standard": tk.STOPWORDS, "domain_aware": tuple(sorted((set(tk.STOPWORDS) - {"not", "no", "ne"}) | {"th", "per"}))}


def _strategy_sql(name: str, words) -> str:
    held = f"term IN ({', '.join(repr(w) for w in words)})" if words else "false"
    return (
        f"SELECT '{name}' AS strategy, count(*) AS before, count(*) FILTER (NOT {held}) AS after, count(DISTINCT term) AS types_before, count(DISTINCT term) FILTER (NOT {held}) AS types_after, "
        f"round((count(*) - count(*) FILTER (NOT {held})) * 100.0 / count(*), 2) AS reduction, count(DISTINCT term) FILTER ({held}) AS removed_terms, "
        f"coalesce(arg_max(term, n * 1.0) FILTER ({held}), '') AS most_removed FROM (SELECT term, count(*) OVER (PARTITION BY term) AS n FROM tokens)"
    )


@query("ag17_stopword_strategies", f"WITH {TOKENS} " + " UNION ALL ".join(_strategy_sql(n, w) for n, w in STRATEGIES.items()))
def ag17_stopword_strategies(spark, sf):
    """What each stopword list takes away; types are counted by grouping once."""
    types = ix.token_arrays(unit_rows(spark, sf)).select(F.explode("t").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    out = None
    for name, words in STRATEGIES.items():
        held = F.col("term").isin(*words) if words else F.lit(False)
        n = F.col("n")
        total, after = F.sum(n), F.sum(F.when(~held, n).otherwise(0))
        row = types.agg(
            F.lit(name).alias("strategy"), total.alias("before"), after.alias("after"), F.count(F.lit(1)).alias("types_before"), F.count_if(~held).alias("types_after"),
            tx.percent_reduction(total, after).alias("reduction"), F.count_if(held).alias("removed_terms"), F.coalesce(F.max_by(F.when(held, F.col("term")), F.when(held, n)), F.lit("")).alias("most_removed"),
        )
        out = row if out is None else out.unionByName(row)
    return out


# --- n-grams


def _grams(n: int) -> str:
    return f"""{UNITS}, t AS (SELECT unit_id, regexp_extract_all(lower(text), '[\\p{{L}}0-9]+') AS a FROM units),
    g AS (SELECT unit_id, unnest(list_transform(range(1, len(a) - {n} + 2), lambda i: array_to_string(a[i:i + {n} - 1], ' '))) AS ngram FROM t WHERE len(a) >= {n}),
    c AS (SELECT ngram, count(*) AS freq, count(DISTINCT unit_id) AS units, min(unit_id) AS first_unit FROM g GROUP BY 1),
    f AS (SELECT *, len(list_filter(string_split(ngram, ' '), lambda w: w IN {STOP})) / CAST({n} AS DOUBLE) AS ratio FROM c)"""


#: Words that make an n-gram one of the domain, in this corpus of invented words.
DOMAIN = ("th", "er", "tion", "nd", "ha", "les", "der")
_ROWS = "SELECT ngram, CAST({n} AS BIGINT) AS n, freq, units, round(ratio, 4) AS function_ratio, ratio < 0.85 AS has_content, freq > 1 AS repeated, list_has_any(string_split(ngram, ' '), [" + ", ".join(f"'{w}'" for w in DOMAIN) + "]) AS has_domain FROM f"
_SUMMARY = "SELECT CAST({n} AS BIGINT) AS n, CAST(sum(freq) AS BIGINT) AS total, count(*) AS unique_ngrams, count(*) FILTER (freq = 1) AS singletons FROM c"


def _each(select: str, sizes) -> str:
    return " UNION ALL ".join(f"SELECT * FROM (WITH {_grams(n)} {select.format(n=n)})" for n in sizes)


@query("ng2_ngrams", _each("SELECT CAST({n} AS BIGINT) AS n, ngram, freq, units, first_unit FROM c", range(1, 6)))
def ng2_ngrams(spark, sf):
    return st.ngrams_of(unit_rows(spark, sf), (1, 2, 3, 4, 5))


@query("ng3_rows", _each(_ROWS, range(1, 6)))
def ng3_rows(spark, sf):
    return st.ngram_rows_of(unit_rows(spark, sf), (1, 2, 3, 4, 5), DOMAIN)


@query("ng4_summary", _each(_SUMMARY, range(1, 6)))
def ng4_summary(spark, sf):
    return chunks.gram_summary(unit_rows(spark, sf), (1, 2, 3, 4, 5))


@query("ng5_mined", f"SELECT * FROM ({_each(_ROWS, (2, 3, 4))}) WHERE freq >= 5 AND units >= 3 AND function_ratio < 0.85 AND has_domain ORDER BY freq DESC, n DESC, ngram LIMIT 1200")
def ng5_mined(spark, sf):
    return st.ranked_phrases(st.ngram_rows_of(unit_rows(spark, sf), (2, 3, 4), DOMAIN), of_domain=True)


@query(
    "ng6_stopword_effect",
    f"""WITH {_grams(2)}, t2 AS (SELECT unit_id, list_filter(a, lambda w: w NOT IN {STOP}) AS a FROM t),
    g2 AS (SELECT DISTINCT unnest(list_transform(range(1, len(a)), lambda i: array_to_string(a[i:i + 1], ' '))) AS ngram FROM t2 WHERE len(a) >= 2)
    SELECT (SELECT count(*) FROM c WHERE ngram IN (SELECT ngram FROM g2)) AS shared, (SELECT count(*) FROM c WHERE ngram NOT IN (SELECT ngram FROM g2)) AS lost,
    (SELECT count(*) FROM g2 WHERE ngram NOT IN (SELECT ngram FROM c)) AS introduced""",
)
def ng6_stopword_effect(spark, sf):
    t = ix.token_arrays(unit_rows(spark, sf)).withColumnRenamed("t", "a")
    a = t.select(F.explode(tk.ngrams(F.col("a"), 2)).alias("ngram")).distinct().withColumn("x", F.lit(1))
    left = t.select(F.explode(F.array(tk.drop_stopwords(F.col("a")))).alias("a"))
    b = left.select(F.explode(tk.ngrams(F.col("a"), 2)).alias("ngram")).distinct().withColumn("y", F.lit(1))
    j = a.join(b, "ngram", "full_outer")
    return j.agg(F.count_if(F.expr("x = 1 and y = 1")).alias("shared"), F.count_if(F.expr("y is null")).alias("lost"), F.count_if(F.expr("x is null")).alias("introduced"))


# --- duplicates


@query("du1_identical", "SELECT doc_id, o AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS o FROM documents) WHERE o < doc_id")
def du1_identical(spark, sf):
    return st.identical(docs(spark, sf), chars=1 << 30)


@query("du2_identical", "SELECT doc_id, o AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS o FROM documents WHERE length(text) >= 1000) WHERE o < doc_id")
def du2_identical(spark, sf):
    return st.identical(docs(spark, sf), 1000)


@query(
    "du3_near",
    """WITH t AS (SELECT doc_id, text AS t FROM documents WHERE length(text) >= 1000),
    b AS (SELECT doc_id, md5(substr(t, i * 200 + 1, 200)) AS h FROM (SELECT doc_id, t, unnest(range(0, (length(t) + 199) // 200)) AS i FROM t)),
    o AS (SELECT h, min(doc_id) AS owner FROM b GROUP BY 1), n AS (SELECT doc_id, count(*) AS n FROM b GROUP BY 1)
    SELECT * FROM (SELECT doc_id, owner, round(count(*) / CAST(any_value(n) AS DOUBLE), 6) AS similarity FROM b JOIN o USING (h) JOIN n USING (doc_id) WHERE owner < doc_id GROUP BY 1, 2) WHERE similarity >= 0.5""",
)
def du3_near(spark, sf):
    return st.shingle_overlap(docs(spark, sf), least=0.5, least_chars=1000)


# --- joins and registries


@query("jn1_metadata", f"WITH {UNITS} SELECT unit_id, quality FROM units LEFT JOIN (SELECT printf('D%06d', doc_id) AS document_id, quality FROM labels) USING (document_id)")
def jn1_metadata(spark, sf):
    l = table(spark, sf, "labels").select(F.format_string("D%06d", "doc_id").alias("document_id"), "quality")
    return unit_rows(spark, sf).join(l, "document_id", "left").select("unit_id", "quality")


@query(
    "jn2_as_of",
    """SELECT e.event_id, m.value AS last_purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) m ON e.user_id = m.user_id AND e.ts >= m.ts""",
)
def jn2_as_of(spark, sf):
    e = table(spark, sf, "events")
    marks = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_purchase"))
    return st.as_of(e.select("event_id", "user_id", "ts"), marks, "user_id", "ts", "last_purchase").select("event_id", "last_purchase")


@query("jn4_sources", "SELECT source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, min(doc_id) AS first_doc, count(l.doc_id) AS labelled FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def jn4_sources(spark, sf):
    l = table(spark, sf, "labels").select("doc_id", F.lit(1).alias("x"))
    return docs(spark, sf).join(l, "doc_id", "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first_doc"), F.count("x").alias("labelled")
    )


@query("sc3_ids", "SELECT doc_id, printf('D%02d', row_number() OVER (ORDER BY source, doc_id)) AS assigned FROM documents")
def sc3_ids(spark, sf):
    return numbered(docs(spark, sf).select("doc_id", "source"), "source", "doc_id").select("doc_id", F.format_string("D%02d", "number").alias("assigned"))


@query("sc2_inventory", "SELECT doc_id, octet_length(encode(text)) AS bytes, sha256(text) AS sha256, CASE WHEN octet_length(encode(text)) < 512 THEN 'INVALID' ELSE 'OK' END AS status FROM documents")
def sc2_inventory(spark, sf):
    n = F.octet_length("text").cast("long")
    return docs(spark, sf).select("doc_id", n.alias("bytes"), F.sha2("text", 256).alias("sha256"), F.when(n < 512, "INVALID").otherwise("OK").alias("status"))




@query("sc_turns", "SELECT printf('C%06d', conv_id) AS document_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT role) AS roles FROM conversations GROUP BY 1")
def sc_turns(spark, sf):
    return turns(table(spark, sf, "conversations")).groupBy("document_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"), F.countDistinct("role").alias("roles"))


@query("st_page_sections")
def st_page_sections(spark, sf):
    """Elements of web pages with the heading that holds at their place."""
    e = page_sections(table(spark, sf, "pages"))
    w = Window.partitionBy("page_id").orderBy("element_index").rowsBetween(Window.unboundedPreceding, 0)
    title = F.last(F.when(F.col("level").isNotNull(), F.col("text")), ignorenulls=True).over(w)
    return e.withColumn("section_title", F.coalesce(title, F.lit("UNKNOWN")))


# --- set operations and windows


@query("set_vocabulary_difference", f"WITH {TOKENS}, x AS (SELECT DISTINCT term, lang FROM tokens JOIN units USING (unit_id)) (SELECT term FROM x WHERE lang = 'fr' EXCEPT SELECT term FROM x WHERE lang <> 'fr')")
def set_vocabulary_difference(spark, sf):
    u = unit_rows(spark, sf)
    fr, rest = ix.tokens(u.where("lang = 'fr'")).select("term"), ix.tokens(u.where("lang <> 'fr'")).select("term")
    return fr.subtract(rest)


@query("wn_section_end", f"WITH {UNITS} SELECT unit_id, lead(unit_index) OVER (PARTITION BY document_id ORDER BY unit_index) AS next_index, row_number() OVER (PARTITION BY document_id, unit_type ORDER BY unit_index) AS ordinal FROM units")
def wn_section_end(spark, sf):
    w = Window.partitionBy("document_id")
    return unit_rows(spark, sf).select(
        "unit_id", F.lead("unit_index").over(w.orderBy("unit_index")).cast("long").alias("next_index"),
        F.row_number().over(Window.partitionBy("document_id", "unit_type").orderBy("unit_index")).cast("long").alias("ordinal"),
    )


# --- selection between pipelines


@query(
    "cm4_variants",
    f"""WITH {TERMS}, v(g, w) AS (VALUES (1, 'the'), (1, 'of'), (2, 'and'), (2, 'qqzz'), (3, 'in'), (3, 'is'))
    SELECT g AS variant_group, count(*) AS surfaces, count(t.term) AS indexed, count(t.term) = count(*) AS complete FROM (SELECT CAST(g AS BIGINT) AS g, w FROM v) LEFT JOIN terms t ON t.term = w GROUP BY 1""",
)
def cm4_variants(spark, sf):
    v = spark.createDataFrame([(1, "the"), (1, "of"), (2, "and"), (2, "qqzz"), (3, "in"), (3, "is")], "variant_group long, term string")
    known = ix.among(term_rows(spark, sf), v).select("term", F.lit(1).alias("x"))
    n, k = F.count(F.lit(1)), F.count("x")
    return v.join(known, "term", "left").groupBy("variant_group").agg(n.alias("surfaces"), k.alias("indexed"), (n == k).alias("complete"))


@query(
    "cm8_metric_table",
    f"""WITH {TERMS} SELECT metric, value FROM (SELECT count(*) AS terms, CAST(sum(posting_frequency) AS BIGINT) AS postings, CAST(sum(term_frequency) AS BIGINT) AS occurrences FROM terms)
    UNPIVOT (value FOR metric IN (terms, postings, occurrences))""",
)
def cm8_metric_table(spark, sf):
    s = term_rows(spark, sf).agg(F.count(F.lit(1)).alias("terms"), F.sum("posting_frequency").alias("postings"), F.sum("term_frequency").alias("occurrences"))
    return s.unpivot([], ["terms", "postings", "occurrences"], "metric", "value")


# --- annotation without an SQL form


@query("tk2_domain_tokens")
def tk2_domain_tokens(spark, sf):
    t = typed.rule_rows(unit_rows(spark, sf))
    per = t.groupBy("rule", "token").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy("rule").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("distinct_tokens"))


@query("tk6_hybrid_tokens")
def tk6_hybrid_tokens(spark, sf):
    return unit_rows(spark, sf).select("unit_id", F.array_join(an.hybrid_tokens(F.col("text")), " ").alias("tokens"))


@query("tk7_expressions")
def tk7_expressions(spark, sf):
    e = unit_rows(spark, sf).select("unit_id", F.inline(an.expression_spans(F.col("text"))))
    return e.select("unit_id", "category", "text", "start", "end")


@query("tk11_sentences")
def tk11_sentences(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(an.sentences(F.col("text"))).alias("n_sentences"))


@query("mo1_stems")
def mo1_stems(spark, sf):
    return an.map_vocabulary(toks(spark, sf), an.morphology.porter, "stem")


@query("mo2_families")
def mo2_families(spark, sf):
    return an.stem_families(toks(spark, sf).where(F.col("term").rlike("^[a-z]+$")))


@query("mo3_order")
def mo3_order(spark, sf):
    a, b = an.stop_then_stem(toks(spark, sf))
    return a.subtract(b).select("stem", F.lit("stop_first").alias("only_in")).unionByName(b.subtract(a).select("stem", F.lit("stem_first").alias("only_in")))


@query("mo5_lemmas")
def mo5_lemmas(spark, sf):
    return an.map_vocabulary(toks(spark, sf), an.morphology.lemma, "lemma")




@query("cm1_pipeline")
def cm1_pipeline(spark, sf):
    t = an.run_pipeline(toks(spark, sf), ("lower", "letters", "stopwords", "stem"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
