"""Mixing sources to target weights, in DataFrame operations only.

Sizes are word counts.  Targets share the total by weight; a target stops at ``max_epochs`` times its
source's size and the excess is shared again by weight (water filling).  Each row gets a hash-random
key; rows are range-sorted by it within their source and the prefix sum of sizes decides where the
budget cuts.  As keys are uniform, equal ranges of the key space are equal shares of a source, so a
source of any size spreads over ``buckets`` ranges; prefix sums are taken inside a range and shifted
by the totals of the ranges before it.  Whole epochs come first, then the rows below the cut; the row
on the cut is taken up to the exact word.

Cases: a null or empty text has size 0 and is never taken; a very long text is one row, cut at the
exact word if it lies on the cut; a null source is a source and sorts last; rows that repeat an id are
told apart by the text's hash, and rows that repeat both share their part of the range in any order
(they are equal, so the result is too); null ids sort first; with no words at all every target is 0;
an empty table gives an empty result; other columns pass through ``mix``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import NOT_WS, WS, fresh, shuffle_width, sized, whole_text
from corvane.plans.scratch import materialize

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def n_words(col: str = "text") -> Column:
    """Words of a text: each becomes one character, the white space between goes."""
    return F.length(F.regexp_replace(F.regexp_replace(whole_text(col), f"{NOT_WS}+", "x"), f"{WS}+", "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    The level L of sum(min(cap, w * L)) = total is found in one pass over the sources in the order in
    which they reach their cap: with the first k at their cap, L = (total - caps before) / weights left.
    One row a source; the rows of the corpus are not involved.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.array(*(F.lit(float(w)) for w in weights))
    ranked = (
        sizes.withColumn("_w", F.element_at(pick, (F.row_number().over(by_name) - 1) % len(weights) + 1))
        .withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("_reach", F.col("_cap") / F.col("_w"))
    )
    order = Window.orderBy("_reach", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    # the first source that the level no longer lifts over its cap fixes the level for all after it; a later
    # source's level leaves out caps that are not reached and is never higher, so the highest is the first's
    found = ranked.withColumn("_level", level)
    free = found.where("_level <= _reach").agg(F.max("_level").alias("_final"))
    target = F.when(F.col("_final").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_w") * F.col("_final")))
    return found.crossJoin(F.broadcast(free)).select("source", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 17, buckets: int | None = None) -> DataFrame:
    """(doc_id, text_hash, source, size, source_size, target, copies, cut_words, taken) of each row.

    A row is taken ``copies`` times whole and once more up to its first ``cut_words`` words.
    """
    spark = docs.sparkSession
    buckets = buckets or shuffle_width(spark)
    slim = docs.select("doc_id", "source", n_words().alias("size"), F.xxhash64(whole_text()).alias("text_hash"))
    slim = slim.withColumn("_key", F.xxhash64("doc_id", "text_hash", F.lit(seed)))
    # equal ranges of the key space
    slim = slim.withColumn("_range", F.floor((F.col("_key") / F.lit(2.0**64) + F.lit(0.5)) * buckets).cast("int"))
    slim = materialize(slim, "mix")
    totals = slim.groupBy("source", "_range").agg(F.sum("size").alias("_n"))
    ranges = totals.withColumn(
        "_before",
        F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    targets = source_targets(totals.groupBy("source").agg(F.sum("_n").alias("source_size")), weights, max_epochs)
    ranges = ranges.join(targets, ranges["source"].eqNullSafe(targets["source"])).select(
        ranges["source"].alias("_s"), F.col("_range").alias("_r"), "_before", "source_size", "target"
    )
    inside = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    summed = slim.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = summed.join(ranges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    budget = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = budget - full * F.col("source_size") - (F.col("_before") + F.col("_in"))  # of the budget at this row
    return (
        placed.withColumn("_left", F.greatest(F.lit(0), F.least("size", left)))
        .withColumn("copies", F.when(F.col("size") > 0, full + (F.col("_left") == F.col("size")).cast("long")).otherwise(F.lit(0)))
        .withColumn("cut_words", F.when(F.col("_left") < F.col("size"), F.col("_left")).otherwise(F.lit(0)).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size") + F.col("cut_words"))
        .select("doc_id", "text_hash", "source", "size", "source_size", "target", "copies", "cut_words", "taken")
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word, white space as it is."""
    # every character but the last of each word becomes a letter, the last a mark: a mark's place is a word's end
    marks = F.regexp_replace(F.regexp_replace(text, f"{NOT_WS}(?={NOT_WS})", "a"), NOT_WS + f"(?={WS}|\\z)", "b")
    plain = F.translate(marks, " \t\n\x0b\x0c\r", "aaaaaa")
    return F.substring(text, F.lit(1), F.length(F.call_function("substring_index", plain, F.lit("b"), n)) + 1)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows: each row of ``docs`` as often as the mix takes it, the row on a cut shortened."""
    id_, hash_, source_, copies, cuts, n, own, part = fresh(docs, "_id", "_h", "_s", "_copies", "_cuts", "_n", "_own", "_part")
    plan = mix_plan(docs, **options).where("taken > 0")
    plays = plan.groupBy(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("source").alias(source_)).agg(
        F.sum("copies").alias(copies), F.collect_list(F.when(F.col("cut_words") > 0, F.col("cut_words"))).alias(cuts), F.count(F.lit(1)).alias(n)
    )
    plays = materialize(plays, "plays")
    keyed = docs.withColumn(own, F.xxhash64(whole_text()))
    if not plays.where(F.col(n) > 1).isEmpty():
        # rows that repeat an id, a text and a source are played from one of them
        keyed = keyed.dropDuplicates(["doc_id", "source", own])
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(source_)) & (F.col(own) == F.col(hash_))
    played = keyed.join(sized(plays), same)
    parts = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col(copies).cast("int")), F.col(cuts))
    played = played.withColumn(part, F.explode(parts))
    text = F.when(F.col(part) < 0, F.col("text")).otherwise(first_words(F.col("text"), F.col(part).cast("int")))
    return played.withColumn("text", text).drop(id_, hash_, source_, copies, cuts, n, own, part)
