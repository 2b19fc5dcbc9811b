"""Search: query trees compiled to one aggregation over postings, scored and ranked.

All queries of a set run in one job.  A term filter reaches the scan; one aggregation by unit gathers the
frequencies and places of the words asked for, whatever the number of queries, and each query's tree is a
predicate over that row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import query_language as ql

#: Fixed values of the ranking.
TERM_WEIGHT, PHRASE_BONUS, TF_WEIGHT, MAX_HITS = 1.0, 2.0, 0.25, 50


def score(n: Column, phrase: Column, tf: Column) -> Column:
    """Matched terms, a bonus for a phrase, and a damped frequency; four places, so shown ties are ties."""
    bonus = F.when(phrase, F.lit(PHRASE_BONUS)).otherwise(F.lit(0.0))
    return F.round(n * TERM_WEIGHT + bonus + TF_WEIGHT * F.log10(1 + tf), 4)


def _places(words: tuple[str, ...] | list[str]) -> Column:
    """The aggregate of a unit's postings that lists where ``words`` stand in it."""
    return F.collect_list(F.when(F.col("term").isin(*words), F.struct("term", "positions")))


def _stands(places: Column, words: tuple[str, ...]) -> Column:
    """Whether ``words`` stand side by side: positions shifted by the word's place meet."""
    none = F.array().cast("array<int>")
    at = lambda w: F.coalesce(F.flatten(F.transform(F.filter(places, lambda x: x["term"] == w), lambda x: x["positions"])), none)
    back = lambda k: lambda p: p.cast("int") - k
    return F.size(reduce(F.array_intersect, [F.transform(at(w), back(k)) for k, w in enumerate(words)])) > 0


def phrase_units(post: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """Units that hold ``words`` side by side."""
    own = post.where(F.col("term").isin(*words)).groupBy("unit_id").agg(_places(words).alias("places"))
    return own.where(F.size("places") >= len(set(words))).where(_stands(F.col("places"), words)).select("unit_id")


#: Words whose marks share one integer.
_BITS = 62


def _flag(node, held: dict) -> Column:
    """Whether a unit satisfies a tree, from what it holds of the leaves."""
    if isinstance(node, ql.Term):
        return held[node.words] if node.words else F.lit(False)
    if isinstance(node, ql.Not):
        return ~_flag(node.item, held)
    left, right = _flag(node.left, held), _flag(node.right, held)
    return left & right if isinstance(node, ql.And) else left | right


def _known(post: DataFrame, words: set[str]) -> set[str]:
    """Which words of the queries the index has."""
    return {r.term for r in post.where(F.col("term").isin(sorted(words))).select("term").distinct().collect()}


def _planned(post: DataFrame, queries: dict[str, str], types: dict[str, str] | None, keyword_mode: str) -> tuple[dict, dict]:
    """(trees, words): the tree of each query, and the words that score its hits."""
    trees, extra = {}, {}
    for q, text in queries.items():
        kind = (types or {}).get(q) or ql.query_type(text)
        if kind == "keyword":
            words = [w for _, v in ql.lex(text) for w in ql.words_of(v)]
            trees[q] = reduce(ql.Or, [ql.Term((w,)) for w in words]) if words else ql.Term(())
            if keyword_mode == "first" and len(words) > 1:
                extra[q] = words
        elif kind == "phrase":
            trees[q] = ql.Term(ql.words_of(text), True)
        else:
            trees[q] = ql.parse(text)
    known = _known(post, {w for words in extra.values() for w in words}) if extra else set()
    for q, words in extra.items():
        trees[q] = ql.Term((next((w for w in words if w in known), words[0]),))
    scored = {q: sorted({w for leaf, yes in ql.leaves(tree) if yes for w in leaf.words} | set(extra.get(q, []))) for q, tree in trees.items()}
    return trees, scored


def _matched(post: DataFrame, trees: dict, scored: dict[str, list[str]]) -> tuple[DataFrame, list[str]]:
    """(hits without rank, words): each unit's postings of the words asked for meet once, and all queries are settled on that row.

    The words of a hit are marks in the columns ``m0``, ``m1``, ..., by their number in ``words``.
    """
    leaves = {leaf.words for tree in trees.values() for leaf, _ in ql.leaves(tree) if leaf.words}
    words = sorted({w for own in scored.values() for w in own} | {w for leaf in leaves for w in leaf})
    phrases = sorted(leaf for leaf in leaves if len(leaf) > 1)
    # a unit's postings come together first, so that nothing else is moved until hits are ranked
    own = post.where(F.col("term").isin(*words)).select("unit_id", "document_id", "term", "tf", *(["positions"] if phrases else [])).repartition("unit_id")
    number = {w: n for n, w in enumerate(words)}
    tf = {w: F.col(f"tf{n}") for w, n in number.items()}
    asked = [F.sum(F.when(F.col("term") == w, F.col("tf")).otherwise(0)).alias(f"tf{n}") for w, n in number.items()]
    if phrases:
        asked.append(_places(sorted({w for leaf in phrases for w in leaf})).alias("places"))
    unit = own.groupBy("unit_id", "document_id").agg(*asked)
    for n, leaf in enumerate(phrases):
        every = reduce(lambda a, b: a & b, [tf[w] > 0 for w in leaf])
        # the explode of a one-element array pins the answer down as a column, read by several queries
        unit = unit.select("*", F.explode(F.array(F.when(every, _stands(F.col("places"), leaf)).otherwise(False))).alias(f"p{n}"))
    held = {(w,): tf[w] > 0 for w in words} | {leaf: F.col(f"p{n}") for n, leaf in enumerate(phrases)}
    width = -(-len(words) // _BITS) or 1

    def hit(q: str, tree) -> Column:
        every = scored[q]
        of = lambda leaf: leaf.words in held and len(leaf.words) > 1
        phrase = reduce(lambda a, b: a | b, [held[leaf.words] for leaf, _ in ql.leaves(tree) if of(leaf)], F.lit(False))
        mark = lambda w, i: F.when(tf[w] > 0, F.lit(1 << number[w] % _BITS) if number[w] // _BITS == i else F.lit(0)).otherwise(F.lit(0)).cast("long")
        total = lambda parts: reduce(lambda a, b: a + b, parts, F.lit(0).cast("long"))
        # a phrase that only stands under NOT can't hold in a unit that is kept, so any phrase is a wanted one
        columns = [
            F.lit(q).alias("query_id"), total([(tf[w] > 0).cast("long") for w in every]).alias("n_terms"), total([tf[w] for w in every]).alias("total_tf"), phrase.alias("any_phrase"),
            *(total([mark(w, i) for w in every]).alias(f"m{i}") for i in range(width)),
        ]
        return F.when(_flag(tree, held), F.struct(*columns))

    rows = unit.select("unit_id", "document_id", F.inline(F.array_compact(F.array(*(hit(q, tree) for q, tree in trees.items())))))
    return rows.where("n_terms > 0"), words


def matches(post: DataFrame, queries: dict[str, str], types: dict[str, str] | None = None, keyword_mode: str = "first") -> DataFrame:
    """(query_id, unit_id, document_id) of all units that queries find, without scores and ranks."""
    return _matched(post, *_planned(post, queries, types, keyword_mode))[0].select("query_id", "unit_id", "document_id")


def search(
    post: DataFrame, queries: dict[str, str], max_hits: int = MAX_HITS, types: dict[str, str] | None = None, keyword_mode: str = "first"
) -> DataFrame:
    """(query_id, rank, score, unit_id, document_id, n_terms, total_tf, phrase_match, matched_terms).

    A keyword query of several words takes the units of its first word that the index has, and scores
    all its words; with ``keyword_mode`` "any" it takes the units of any word.
    """
    rows, words = _matched(post, *_planned(post, queries, types, keyword_mode))
    scored = rows.withColumn("score", score(F.col("n_terms"), F.col("any_phrase"), F.col("total_tf")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "unit_id"))
    top = scored.withColumn("rank", rank).where(F.col("rank") <= max_hits)
    named = [F.when(F.col(f"m{n // _BITS}").bitwiseAND(F.lit(1 << n % _BITS)) != 0, F.lit(w)) for n, w in enumerate(words)]
    return top.select(
        "query_id", "rank", "score", "unit_id", "document_id", "n_terms", "total_tf",
        F.col("any_phrase").alias("phrase_match"), F.concat_ws(";", *named).alias("matched_terms"),
    )


def phrase_matches(stream: DataFrame, post: DataFrame, words: tuple[str, ...], phrase_post: DataFrame | None = None) -> DataFrame:
    """(unit_id, via): units that hold a phrase and how it was found.

    ``stream`` are the postings of all words, stopwords included; units that only meet the phrase at the
    positions of the index ``post`` come second.  ``phrase_post`` marks units that its phrase term has too.
    """
    a = phrase_units(stream, words).withColumn("how", F.lit(0))
    b = phrase_units(post, words).withColumn("how", F.lit(1))
    found = a.unionByName(b).groupBy("unit_id").agg(F.min("how").alias("how"))
    via = F.when(F.col("how") == 0, "stream").otherwise("index_positions")
    if phrase_post is None:
        return found.select("unit_id", via.alias("via"))
    own = phrase_post.where(F.col("term") == "_".join(words)).select("unit_id", F.lit("+phrase_term").alias("more")).distinct()
    return found.join(own, "unit_id", "left").select("unit_id", F.concat(via, F.coalesce("more", F.lit(""))).alias("via"))


def all_of(*queries: str) -> str:
    """The list form of AND."""
    return _joined("AND", queries, 1)


def any_of(*queries: str) -> str:
    """The list form of OR."""
    return _joined("OR", queries, 1)


def all_but(query: str, *without: str) -> str:
    """The first query without the units of the others."""
    return f"({query}) AND NOT ({_joined('OR', without, 1)})" if len(without) < 2 else " AND ".join([f"({query})", *(f"NOT ({w})" for w in without)])


def _joined(operator: str, queries: tuple[str, ...], least: int) -> str:
    if len(queries) < least:
        raise ql.QuerySyntaxError(f"{operator} needs {least} or more operands")
    return f" {operator} ".join(f"({q})" for q in queries)


def document_hits(hits: DataFrame) -> DataFrame:
    """Documents of ranked hits: best score and unit, number of hits."""
    return hits.groupBy("query_id", "document_id").agg(
        F.max("score").alias("score"), F.min_by("unit_id", "rank").alias("best_unit"), F.count(F.lit(1)).alias("n_hits"), F.min("rank").alias("best_rank")
    )


def page(df: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)
