"""Corpus statistics, n-grams, duplicates, furniture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.tokens import STOPWORDS, tokenize
from corvane.operators import chunks
from corvane.operators.index import gram_counts, token_arrays


def corpus_totals(units: DataFrame) -> DataFrame:
    """Tokens, types and units of a corpus: terms are counted per term, units per document, and each count is summed."""
    t = token_arrays(units, "document_id").where(F.size("t") > 0)
    words = t.select(F.explode("t").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    held = t.groupBy("document_id").agg(F.count(F.lit(1)).alias("u")).agg(F.coalesce(F.sum("u"), F.lit(0)).alias("units"), F.count(F.lit(1)).alias("documents"))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("unique_terms"), F.count_if(F.col("term").rlike(r"\p{L}")).alias("vocabulary"))
    return total.crossJoin(held).withColumn("ttr", F.round(F.col("unique_terms") / F.when(F.col("tokens") > 0, F.col("tokens")), 6))


def document_statistics(units: DataFrame) -> DataFrame:
    words = F.size(tokenize(F.col("text"))).cast("long")
    return units.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("units"), F.sum(F.length("text")).alias("chars"), F.sum(words).alias("words"),
        F.sum(F.when(F.col("unit_type") == "paragraph", 1).otherwise(0)).alias("paragraphs"),
        F.sum(F.when(F.col("unit_type") == "heading", 1).otherwise(0)).alias("headings"),
        F.sum(F.when(F.col("unit_type") == "table", 1).otherwise(0)).alias("tables"),
    )


def frequencies(units: DataFrame) -> DataFrame:
    """(term, term_frequency, unit_frequency, document_frequency), summed by chunks of whole documents first."""
    return gram_counts(units).withColumnsRenamed({"gram": "term", "freq": "term_frequency", "units": "unit_frequency", "docs": "document_frequency"})


def first_seen(toks: DataFrame) -> DataFrame:
    first = F.min(F.struct("unit_id", "pos"))
    return toks.groupBy("term").agg(first.alias("f")).select("term", F.col("f.unit_id").alias("first_unit"), F.col("f.pos").cast("long").alias("first_pos"))


def top(df: DataFrame, by: str, name: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(by), name).limit(k)


def ngram_counts(units: DataFrame, n: int) -> DataFrame:
    """(ngram, freq, units, first_unit)"""
    return ngrams_of(units, (n,)).drop("n")


def ngrams_of(units: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(n, ngram, freq, units, first_unit) of the n-grams of each size, all sizes in one pass."""
    return chunks.grams(units, sizes).withColumnRenamed("gram", "ngram")


def function_ratio(ngram: Column, words: tuple[str, ...] = STOPWORDS) -> Column:
    parts = F.split(ngram, " ")
    return F.size(F.filter(parts, lambda w: w.isin(*words))) / F.size(parts)


def ngram_rows(counts: DataFrame, n: int | Column, domain: tuple[str, ...] = ()) -> DataFrame:
    """N-grams with their flags; ``domain`` are the words that make an n-gram one of the domain."""
    ratio = function_ratio(F.col("ngram"))
    of_domain = F.arrays_overlap(F.split("ngram", " "), F.array(*map(F.lit, domain))) if domain else F.lit(False)
    return counts.select(
        "ngram", F.lit(n).cast("long").alias("n"), "freq", "units", F.round(ratio, 4).alias("function_ratio"),
        (ratio < 0.85).alias("has_content"), (F.col("freq") > 1).alias("repeated"), of_domain.alias("has_domain"),
    )


def ngram_rows_of(units: DataFrame, sizes: tuple[int, ...], domain: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the n-grams of each size, those that occur once among them."""
    return ngram_rows(ngrams_of(units, sizes), F.col("n"), domain)


def ngram_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("n").agg(F.sum("freq").alias("total"), F.count(F.lit(1)).alias("unique_ngrams"), F.count_if(F.col("freq") == 1).alias("singletons"))


def ranked_phrases(rows: DataFrame, least: int = 5, least_units: int = 3, most_function: float = 0.85, k: int = 1200, of_domain: bool = False) -> DataFrame:
    """The first ``k`` of the rows of all sizes together; with ``of_domain`` only those that hold a word of the domain."""
    good = (F.col("freq") >= least) & (F.col("units") >= least_units) & (F.col("function_ratio") < most_function) & (F.col("has_domain") | F.lit(not of_domain))
    return rows.where(good).orderBy(F.desc("freq"), F.desc("n"), "ngram").limit(k)


def furniture(lines: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """Lines found in at least max(``least``, share of the documents) of a source, once a document."""
    pages = lines.groupBy("source_id").agg(F.countDistinct("document_id").alias("n"))
    seen = lines.groupBy("source_id", F.trim("text").alias("line")).agg(F.countDistinct("document_id").alias("pages"))
    return seen.join(pages, "source_id").where(F.col("pages") >= F.greatest(F.lit(least), F.floor(F.col("n") * share))).select("source_id", "line", "pages")


def strip_furniture(lines: DataFrame, found: DataFrame) -> DataFrame:
    marked = lines.withColumn("line", F.trim("text"))
    return marked.join(found.select("source_id", "line"), ["source_id", "line"], "left_anti").drop("line")


def identical(docs: DataFrame, least: int = 0, chars: int | None = None) -> DataFrame:
    """(doc_id, duplicate_of): later rows whose text, or its first ``chars`` characters, has the hash of an earlier row."""
    text = F.col("text") if chars is None else F.substring("text", 1, chars)
    keyed = docs.where(F.length("text") >= least).select("doc_id", F.sha2(text, 256).alias("h"))
    first = keyed.groupBy("h").agg(F.min("doc_id").alias("duplicate_of"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(first, "h").where("doc_id > duplicate_of").select("doc_id", "duplicate_of")


def shingle_overlap(docs: DataFrame, size: int = 200, chars: int | None = None, least: float = 0.995, least_chars: int = 5000) -> DataFrame:
    """(doc_id, owner, similarity): share of a row's fixed blocks first seen in an earlier row.

    The blocks cover the whole text, the last one shorter.  With ``chars`` it is a probe of the opening:
    the whole blocks of the first ``chars`` characters.
    """
    text = F.col("text") if chars is None else F.substring("text", 1, chars)
    long = docs.where(F.length("text") >= F.greatest(F.lit(least_chars), F.lit(1))).select("doc_id", text.alias("t"))
    n = F.ceil(F.length("t") / size) if chars is None else F.floor(F.length("t") / size)
    starts = F.sequence(F.lit(0), n.cast("int") - 1)
    blocks = long.select("doc_id", F.explode(F.transform(starts, lambda i: F.substring(F.col("t"), i * size + 1, F.lit(size)))).alias("b"))
    keyed = blocks.select("doc_id", F.md5("b").alias("h"))
    owner = keyed.groupBy("h").agg(F.min("doc_id").alias("owner"))
    total = keyed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = keyed.join(owner, "h").where("owner < doc_id").groupBy("doc_id", "owner").agg(F.count(F.lit(1)).alias("hits")).join(total, "doc_id")
    return pairs.select("doc_id", "owner", F.round(F.col("hits") / F.col("n"), 6).alias("similarity")).where(F.col("similarity") >= least)


def as_of(points: DataFrame, marks: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Each point with the last mark at or before it: one sorted pass over the union."""
    a = points.withColumn("_m", F.lit(1)).withColumn(value, F.lit(None).cast(marks.schema[value].dataType))
    b = marks.select(by, at, value).withColumn("_m", F.lit(0))
    w = Window.partitionBy(by).orderBy(at, "_m").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_m = 1").drop("_m")
