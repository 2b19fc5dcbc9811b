"""A query is a function of (spark, sf_dir) registered with the SQL that an independent engine runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


#: Common table expressions of the oracle side.
UNITS = """units AS (
  SELECT printf('D%06d_U%05d', doc_id, i) AS unit_id, printf('D%06d', doc_id) AS document_id, source AS source_id, lang,
         i AS unit_index, line AS text,
         CASE WHEN length(regexp_replace(line, '[^\\p{L}]', '', 'g')) * 2 <= length(line) THEN 'table'
              WHEN len(regexp_split_to_array(trim(line), ' +')) <= 8
               AND length(regexp_replace(line, '[^\\p{Lu}]', '', 'g')) * 10 >= length(regexp_replace(line, '[^\\p{L}]', '', 'g')) * 7 THEN 'heading'
              ELSE 'paragraph' END AS unit_type
  FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
  WHERE trim(line) <> '')"""
TOKENS = UNITS + """, tokens AS (
  SELECT unit_id, document_id, unnest(a) AS term, generate_subscripts(a, 1) - 1 AS pos
  FROM (SELECT unit_id, document_id, regexp_extract_all(lower(text), '[\\p{L}0-9]+') AS a FROM units))"""
POSTINGS = TOKENS + """, postings AS (
  SELECT term, unit_id, document_id, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM tokens GROUP BY ALL)"""
TERMS = POSTINGS + """, terms AS (
  SELECT term, sum(tf) AS term_frequency, count(*) AS posting_frequency, count(DISTINCT document_id) AS document_frequency
  FROM postings GROUP BY term)"""
