"""The positional inverted index as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.tokens import WORDS, tokenize
from corvane.operators import chunks


def tokens(units: DataFrame, pattern: str = WORDS, lower: bool = True) -> DataFrame:
    """(unit_id, document_id, pos, term), positions from 0."""
    return units.select("unit_id", "document_id", F.posexplode(tokenize(F.col("text"), pattern, lower)).alias("pos", "term"))


def token_arrays(units: DataFrame, *keep: str) -> DataFrame:
    """Units with their tokens in the array ``t``.

    The explode of a one-element array pins the tokens down as a column: inlined into a lambda over
    their places, the tokenizer would run once for each place.
    """
    return units.select(*keep, F.explode(F.array(tokenize(F.col("text")))).alias("t"))


def postings(toks: DataFrame) -> DataFrame:
    """(term, unit_id, document_id, tf, positions).  A row's group is one term of one unit, bounded by the unit."""
    return toks.groupBy("term", "unit_id", "document_id").agg(
        F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions")
    )


def terms(post: DataFrame) -> DataFrame:
    """One row a term.  Units are counted per document first, so no row is multiplied to count distinct documents."""
    keys = ["term", "is_phrase"] if "is_phrase" in post.columns else ["term"]
    per = post.groupBy(*keys, "document_id").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("units"))
    return per.groupBy(*keys).agg(
        F.sum("tf").alias("term_frequency"),
        F.sum("units").alias("posting_frequency"),
        F.count(F.lit(1)).alias("document_frequency"),
    )


def phrases(units: DataFrame, sizes: tuple[int, ...] = (2, 3), least: int = 5, least_documents: int = 2, most: int = 20_000) -> DataFrame:
    """(phrase, freq, units, docs, rank): frequent runs of indexable tokens; ``most`` is the dictionary's size.

    Runs are counted by chunks of whole documents first; the tokens of the default pattern are all indexable.
    """
    counted = gram_counts(units, sizes, "_").withColumnRenamed("gram", "phrase")
    chosen = counted.where((F.col("freq") >= least) & (F.col("docs") >= least_documents))
    top = chosen.orderBy(F.desc("freq"), "phrase").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("freq"), "phrase")))


def phrase_postings(units: DataFrame, chosen: DataFrame, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """Postings of indexed phrases; ``chosen`` is bounded by the dictionary's size."""
    return chunks.gram_postings(units, [r.phrase for r in chosen.select("phrase").collect()], sizes, "_")


def gram_counts(units: DataFrame, sizes: tuple[int, ...] = (1,), joiner: str = " ", form: Callable[[Column], Column] | None = None) -> DataFrame:
    """(gram, freq, units, docs): how often n-grams stand in texts, and in how many units and documents."""
    return chunks.totals(units, sizes, joiner, form).groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("freq", "units", "docs")))


def term_counts(units: DataFrame, form: Callable[[Column], Column] | None = None) -> DataFrame:
    """The dictionary that ``terms`` makes of postings, from the texts: no posting is made for it.  Words count in ``form``."""
    named = {"gram": "term", "freq": "term_frequency", "units": "posting_frequency", "docs": "document_frequency"}
    return gram_counts(units, form=form).withColumnsRenamed(named)


def among(dictionary: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of a dictionary for the terms of a small table: the dictionary is read, not moved."""
    return dictionary.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")


def phrase_terms(chosen: DataFrame) -> DataFrame:
    """The dictionary of the indexed phrases."""
    return chosen.select(F.col("phrase").alias("term"), F.col("freq").alias("term_frequency"), F.col("units").alias("posting_frequency"), F.col("docs").alias("document_frequency"))


def with_phrases(post: DataFrame, phrase_post: DataFrame) -> DataFrame:
    return post.withColumn("is_phrase", F.lit(False)).unionByName(phrase_post.withColumn("is_phrase", F.lit(True)))


def index_statistics(dictionary: DataFrame, units: DataFrame) -> DataFrame:
    """The twenty measures of an index as one row, from its terms and its indexed units."""
    n = F.col("posting_frequency")
    phrase = F.col("is_phrase")
    per_document = units.groupBy("document_id").agg(F.count(F.lit(1)).alias("u"))
    held = per_document.agg(F.sum("u").alias("indexed_units"), F.count(F.lit(1)).alias("indexed_documents"))
    a = dictionary.agg(
        F.count(F.lit(1)).alias("index_terms"), F.count_if(~phrase).alias("unigram_terms"), F.count_if(phrase).alias("phrase_terms"),
        F.sum(n).alias("total_postings"), F.sum(F.when(~phrase, n).otherwise(0)).alias("unigram_postings"), F.sum(F.when(phrase, n).otherwise(0)).alias("phrase_postings"),
        F.sum("term_frequency").alias("total_positions"), F.count_if(n == 1).alias("singleton_terms"), F.round(F.avg("term_frequency"), 4).alias("mean_term_frequency"),
        F.round(F.avg("document_frequency"), 4).alias("mean_document_frequency"), F.max(n).alias("longest_posting_list"),
        F.min(F.struct((-n).alias("n"), "term"))["term"].alias("longest_posting_term"),
    )
    rows = a.crossJoin(held).crossJoin(coverage_terms(dictionary).withColumnRenamed("terms_for_share", "terms_in_90_percent_of_postings"))
    share = lambda x, y, places=4: F.coalesce(F.round(F.col(x) / F.when(F.col(y) > 0, F.col(y)), places), F.lit(0.0))
    return rows.select(
        "*",
        share("indexed_units", "indexed_documents", 2).alias("units_per_document"),
        share("total_postings", "index_terms").alias("postings_per_term"),
        share("total_positions", "total_postings").alias("mean_positions_per_posting"),
        share("total_postings", "indexed_units").alias("postings_per_unit"),
        share("singleton_terms", "index_terms").alias("hapax_ratio"),
    )


def coverage_terms(dictionary: DataFrame, share: float = 0.9) -> DataFrame:
    """How many of the most frequent terms cover ``share`` of all postings.

    Terms are counted by posting frequency first; the running sum then goes over the distinct
    frequencies, of which there are about the square root of the number of postings at most.
    """
    levels = dictionary.groupBy("posting_frequency").agg(F.count(F.lit(1)).alias("k"))
    order = Window.orderBy(F.desc("posting_frequency")).rowsBetween(Window.unboundedPreceding, -1)
    run = levels.withColumn("before", F.coalesce(F.sum(F.col("k") * F.col("posting_frequency")).over(order), F.lit(0))).withColumn(
        "above", F.coalesce(F.sum("k").over(order), F.lit(0))
    )
    total = dictionary.agg(F.sum("posting_frequency").alias("total"))
    need = F.ceil((F.col("total") * share - F.col("before")) / F.col("posting_frequency"))
    target = F.col("total") * share
    reached = (F.col("before") < target) & (F.col("before") + F.col("k") * F.col("posting_frequency") >= target)
    return run.crossJoin(total).where(reached).agg(F.min(F.col("above") + need).cast("long").alias("terms_for_share"))
