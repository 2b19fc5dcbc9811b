"""The queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, exact_dedup, jaccard_join, media, mixing, pii, secrets, suffix_dedup, token_counts, toxicity
from corvane.llm.common import documents


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.extract(documents(spark, sf_dir)))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), digest=True)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), vocabulary(), digest=True)


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "cut_words")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.links(documents(spark, sf_dir))


def scan_secrets(docs: DataFrame) -> DataFrame:
    # a history of two snapshots, together the whole table: what the first one holds is not scanned again
    newer = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    return secrets.digest(secrets.scan_history([docs.where(~newer), docs.where(newer)], secrets.Ledger(docs.sparkSession)))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(documents(spark, sf_dir))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), vocabulary())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_repeats": op2_repeats,
        "op3_media": op3_media,
        "op4_bpe": op4_bpe,
        "op5_mix": op5_mix,
        "op6_jaccard": op6_jaccard,
        "op7_secrets": op7_secrets,
        "op8_toxicity": op8_toxicity,
        "op9_exact": op9_exact,
        "op10_tokens": op10_tokens,
    }


_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

SQL_OP9 = f"""
WITH n AS (SELECT doc_id, {_NORM} AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


#: The rules in the other engine's patterns: (order, kind, pattern, group, least length of the group).
_SECRETS = (
    (0, "assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    (1, "access", "AKIA[A-Z0-9]+", 0, 20),
    (2, "hex", "[0-9a-f]+", 0, 24),
    (3, "pem", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1),
)
_FOUND = " UNION ALL ".join(
    f"SELECT rid, {o} AS ord, '{k}' AS kind, {least} AS least, regexp_extract_all(s, '{p}') AS ms, regexp_extract_all(s, '{p}', {g}) AS gs, string_split_regex(s, '{p}') AS gaps FROM t"
    for o, k, p, g, least in _SECRETS
)

SQL_OP7 = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS s FROM documents),
f AS ({_FOUND}),
u AS (
  SELECT rid, ord, kind, least, unnest(ms) AS m, unnest(gs) AS g, unnest(gaps[1:len(ms)]) AS gap, unnest(range(len(ms))) AS i
  FROM f WHERE len(ms) > 0
),
p AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY rid, ord ORDER BY i) AS BIGINT) AS stop FROM u),
g AS (SELECT rid, ord, kind, stop - length(m) AS start, stop FROM p WHERE length(g) >= least),
a AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < 3) AS base
  FROM g GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(s) AS blob
FROM t LEFT JOIN a USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_secrets": SQL_OP7, "op9_exact": SQL_OP9}
