"""Queries: remaining filters, joins, comparisons, event windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions import tokens as tk
from corvane.functions import snippets
from corvane.operators import annotate as an
from corvane.operators import evaluation as ev
from corvane.operators import index as ix
from corvane.operators import statistics as st
from corvane.plans import q_corpus as qc
from corvane.plans import q_search as qs
from corvane.plans.queries import TERMS, TOKENS, query
from corvane.sources.corpus import table
from corvane.streaming import index_stream


@query("fl6_ngram_filter", f"WITH {qc._grams(2)} SELECT ngram, freq FROM c WHERE contains(ngram, 'the') AND freq >= 3")
def fl6_ngram_filter(spark, sf):
    g = st.ngram_counts(qs.unit_rows(spark, sf), 2)
    return g.where(F.contains("ngram", F.lit("the")) & (F.col("freq") >= 3)).select("ngram", "freq")


@query("ag16_labels", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2 ORDER BY n DESC")
def ag16_labels(spark, sf):
    return table(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


@query(
    "ag19_stages",
    f"""WITH {TOKENS}, s AS (SELECT 1 AS stage, count(*) AS tokens FROM tokens UNION ALL SELECT 2, count(*) FILTER (regexp_matches(term, '\\p{{L}}')) FROM tokens
    UNION ALL SELECT 3, count(*) FILTER (regexp_matches(term, '\\p{{L}}') AND term NOT IN {qc.STOP}) FROM tokens)
    SELECT CAST(stage AS BIGINT) AS stage, tokens, round((first_value(tokens) OVER (ORDER BY stage) - tokens) * 100.0 / first_value(tokens) OVER (ORDER BY stage), 2) AS reduction FROM s""",
)
def ag19_stages(spark, sf):
    t = F.col("term")
    letter, stop = t.rlike(r"\p{L}"), t.isin(*tk.STOPWORDS)
    row = qc.toks(spark, sf).agg(F.count(F.lit(1)).alias("a"), F.count_if(letter).alias("b"), F.count_if(letter & ~stop).alias("c"))
    stages = row.select("a", F.posexplode(F.array("a", "b", "c")).alias("p", "tokens"))
    return stages.select((F.col("p") + 1).cast("long").alias("stage"), "tokens", tx.percent_reduction(F.col("a"), F.col("tokens")).alias("reduction"))


@query("jn5_judged_ranking", f"{qs._RANKING} SELECT query_id, item, rank, relevance FROM rows0")
def jn5_judged_ranking(spark, sf):
    r = ev.judged(*qs._ranking(spark, sf))
    return r.select("query_id", "item", F.col("rank").cast("long").alias("rank"), "relevance")


@query("ex_turns_by_conversation", "SELECT conv_id, count(*) AS n, string_agg(role, ';' ORDER BY turn, role) AS roles FROM conversations GROUP BY 1")
def ex_turns_by_conversation(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return c.select("conv_id", "n", F.array_join(F.transform("r", lambda x: x["role"]), ";").alias("roles"))


_DOMAIN = ["of the", "in the", "zzzz the", "and", "qqqq"]


@query(
    "cm3_domain_recall",
    f"""WITH {TERMS}, d(phrase) AS (VALUES {", ".join(f"('{p}')" for p in _DOMAIN)}),
    p AS (SELECT phrase, unnest(string_split(phrase, ' ')) AS term FROM d), k AS (SELECT phrase, bool_and(t.term IS NOT NULL) AS present FROM p LEFT JOIN terms t USING (term) GROUP BY 1)
    SELECT count(*) AS terms, count(*) FILTER (present) AS found, round(count(*) FILTER (present) / CAST(count(*) AS DOUBLE), 6) AS recall FROM k""",
)
def cm3_domain_recall(spark, sf):
    p = spark.createDataFrame([(x,) for x in _DOMAIN], "phrase string").select("phrase", F.explode(F.split("phrase", " ")).alias("term"))
    known = ix.among(qs.term_rows(spark, sf), p).select("term", F.lit(True).alias("known"))
    k = p.join(known, "term", "left").groupBy("phrase").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("present"))
    n, f = F.count(F.lit(1)), F.count_if("present")
    return k.agg(n.alias("terms"), f.alias("found"), F.round(f / n, 6).alias("recall"))


@query("cm5_answerability", f"{qs._HITS} SELECT q.query_id, count(h.unit_id) > 0 AS answered FROM (SELECT printf('Q%02d', i) AS query_id FROM (SELECT unnest(range(1, 16)) AS i)) q LEFT JOIN hits h USING (query_id) GROUP BY 1")
def cm5_answerability(spark, sf):
    q = spark.createDataFrame([(x,) for x in qs.QUERY_SET], "query_id string")
    hits = qs.ix17_query_set(spark, sf).select("query_id", "unit_id")
    return q.join(hits, "query_id", "left").groupBy("query_id").agg((F.count("unit_id") > 0).alias("answered"))


@query(
    "ev13_probe",
    f"{qs._HITS} SELECT count(DISTINCT query_id) AS with_hits, count(*) AS hits, round(avg(score), 4) AS mean_score, count(DISTINCT document_id) AS documents FROM hits",
)
def ev13_probe(spark, sf):
    h = qs.ix17_query_set(spark, sf)
    return h.agg(F.countDistinct("query_id").alias("with_hits"), F.count(F.lit(1)).alias("hits"), F.round(F.avg("score"), 4).alias("mean_score"), F.countDistinct("document_id").alias("documents"))


@query(
    "rp18_result_summary",
    f"{qs._HITS} SELECT query_id, count(*) AS hits, round(sum(CASE WHEN rank <= 10 THEN score ELSE 0 END), 4) AS top10_score_sum, max(score) AS best FROM hits GROUP BY 1",
)
def rp18_result_summary(spark, sf):
    top = F.sum(F.when(F.col("rank") <= 10, F.col("score")).otherwise(0.0))
    return qs.ix17_query_set(spark, sf).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.round(top, 4).alias("top10_score_sum"), F.max("score").alias("best"))


@query("rp7_substring_counts", "SELECT e AS expression, CAST(sum(len(regexp_extract_all(text, e))) AS BIGINT) AS n FROM documents, (VALUES ('the'), ('tion'), ('555')) v(e) GROUP BY 1")
def rp7_substring_counts(spark, sf):
    d, found = qc.docs(spark, sf), ["the", "tion", "555"]
    row = d.agg(*(F.sum(F.regexp_count("text", F.lit(e))).alias(e) for e in found))
    return row.unpivot([], found, "expression", "n").withColumn("n", F.col("n").cast("long"))


@query("rp15_typed_totals")
def rp15_typed_totals(spark, sf):
    e = qs.unit_rows(spark, sf).select(F.inline(an.expression_spans(F.col("text"))))
    return e.groupBy("category").agg(F.count(F.lit(1)).alias("n"))




@query("ex_event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ex_event_windows(spark, sf):
    return index_stream.windowed_counts(table(spark, sf, "events"))


@query(
    "ex_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def ex_sessions(spark, sf):
    return index_stream.sessions(table(spark, sf, "events"))


@query("tk4_treebank")
def tk4_treebank(spark, sf):
    @F.pandas_udf("array<string>")
    def split(text: pd.Series) -> pd.Series:
        return text.map(snippets.treebank)

    t = qs.unit_rows(spark, sf).select(F.explode(split("text")).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("pj8_chunks")
def pj8_chunks(spark, sf):
    @F.pandas_udf("array<struct<start:int,end:int>>")
    def split(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [{"start": a, "end": b} for a, b in snippets.chunks(t, 1000)])

    return qc.docs(spark, sf).select("doc_id", F.posexplode(split("text")).alias("chunk", "span")).select("doc_id", "chunk", "span.start", "span.end")


@query(
    "st9_low_text",
    "SELECT doc_id, CASE WHEN n_chars < 60 AND w < 15 THEN 'scanned' WHEN n_chars < 120 OR w < 20 THEN 'low' ELSE 'ok' END AS status FROM (SELECT doc_id, n_chars, len(list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> '')) AS w FROM documents)",
)
def st9_low_text(spark, sf):
    w = tx.count_words(F.col("text"))
    status = F.when((F.col("n_chars") < 60) & (w < 15), "scanned").when((F.col("n_chars") < 120) | (w < 20), "low").otherwise("ok")
    return qc.docs(spark, sf).select("doc_id", status.alias("status"))
