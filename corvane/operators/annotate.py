"""Annotation operators: distinct-vocabulary morphology, typed expressions, dictionary entities, pipelines."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import morphology, snippets, typed
from corvane.functions.tokens import STOPWORDS


def map_vocabulary(words: DataFrame, function: Callable[[str], str], name: str) -> DataFrame:
    """(term, name) for the distinct terms of ``words``: the function runs once a word."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(function)

    return words.select("term").distinct().withColumn(name, run("term"))


def stem_tokens(toks: DataFrame, method: str = "porter") -> DataFrame:
    """Tokens with a column ``stem``, joined back from the distinct vocabulary."""
    return toks.join(map_vocabulary(toks.where(F.col("term").rlike("[a-z]")), morphology.STEMMERS[method], "stem"), "term", "left").withColumn(
        "stem", F.coalesce("stem", "term")
    )


def stem_families(words: DataFrame, method: str = "porter") -> DataFrame:
    """(stem, surfaces, n) of stems that several surfaces share."""
    stems = map_vocabulary(words, morphology.STEMMERS[method], "stem")
    grouped = stems.groupBy("stem").agg(F.array_join(F.sort_array(F.collect_set("term")), ";").alias("surfaces"), F.countDistinct("term").alias("n"))
    return grouped.where("n > 1")


def stop_then_stem(toks: DataFrame, stop: tuple[str, ...] = STOPWORDS) -> tuple[DataFrame, DataFrame]:
    """Vocabularies of both orders of stopword removal and stemming."""
    stems = stem_tokens(toks)
    first = stems.where(~F.col("term").isin(*stop)).select("stem").distinct()
    second = stems.where(~F.col("stem").isin(*stop)).select("stem").distinct()
    return first, second


_TYPED = "array<struct<category:string,text:string,start:int,end:int>>"


def expression_spans(c: Column) -> Column:
    @F.pandas_udf(_TYPED)
    def run(s: pd.Series) -> pd.Series:
        keys = ("category", "text", "start", "end")
        return s.map(lambda t: [dict(zip(keys, e)) for e in typed.expressions(t or "")])

    return run(c)


def hybrid_tokens(c: Column) -> Column:
    """Domain tokens with every multi-part expression as one term, lower case."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [w.lower() for w in typed.hybrid(t or "", snippets.treebank)])

    return run(c)


def protected_tokens(c: Column) -> Column:
    """Domain tokens, the parts of each expression joined again."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: typed.protect(t or "", typed.domain_tokens(t or "")))

    return run(c)


def typed_parts(c: Column) -> Column:
    @F.pandas_udf("array<struct<kind:string,part:string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"kind": k, "part": p} for k, p in typed.typed_components(t or "")])

    return run(c)


def sentences(c: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: morphology.sentences(t or ""))

    return run(c)


def dictionary_entities(units: DataFrame, terms: dict[str, str], per_unit: int = 3) -> DataFrame:
    """(unit_id, category, entity, n): whole-word matches of a dictionary, longest entry first.

    The dictionary is part of the query, so the alternation is bounded; at most ``per_unit`` different
    entities of a category are listed for a unit, by frequency, while ``n`` counts all.
    """
    alternation = "|".join(sorted((t.lower() for t in terms), key=lambda t: (-len(t), t)))
    pattern = rf"(?<![\p{{L}}0-9])({alternation})(?![\p{{L}}0-9])"
    found = units.select("unit_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(1))).alias("entity"))
    kinds = F.create_map(*(F.lit(x) for t, k in terms.items() for x in (t.lower(), k)))
    counted = found.groupBy("unit_id", kinds[F.col("entity")].alias("category"), "entity").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    order = Window.partitionBy("unit_id", "category").orderBy(F.desc("n"), "entity")
    return counted.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_unit).drop("_r")


def dominant_tags(tagged: DataFrame, least: int = 3) -> DataFrame:
    """(term, tag, n): each term's most frequent tag, ties by name."""
    counts = tagged.groupBy("term", "tag").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("term").agg(F.max(F.struct("n", F.col("tag"))).alias("b"), F.sum("n").alias("total"))
    return best.where(F.col("total") >= least).select("term", F.col("b.tag").alias("tag"), F.col("b.n").alias("n"))


STEPS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "lower": lambda d: d.withColumn("term", F.lower("term")),
    "letters": lambda d: d.where(F.col("term").rlike(r"\p{L}")),
    "stopwords": lambda d: d.where(~F.col("term").isin(*STOPWORDS)),
    "stem": lambda d: stem_tokens(d).withColumn("term", F.col("stem")).drop("stem"),
    "lemma": lambda d: stem_tokens(d, "lemma").withColumn("term", F.col("stem")).drop("stem"),
}


def run_pipeline(toks: DataFrame, steps: tuple[str, ...]) -> DataFrame:
    """A declared list of steps over (unit_id, document_id, pos, term), each applied once."""
    unknown = [s for s in steps if s not in STEPS]
    if unknown:
        raise ValueError(f"unknown steps: {unknown}")
    for s in steps:
        toks = toks.transform(STEPS[s])
    return toks
