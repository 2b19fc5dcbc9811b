"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups.

The texts are read twice.  The first pass leaves slim rows (id, hash, digest), which are grouped with
map-side partial aggregation, so a group that holds a third of all rows arrives as one row per task.
The second pass keeps the texts whose hash occurs more than once, and only these are moved: each is
compared with the one text of the row that stays.  That side has one row per hash and both sides come
from an exchange, so a hot hash can be split over tasks and never multiplies rows.  Rows whose bytes
differ from the keeper's (hash collisions) are grouped again by the bytes themselves.

The hashes that repeat reach the second pass by broadcast up to a checked number of rows; beyond it
the pass is a shuffled join, which moves each text once.

Cases: a null text is empty; empty texts are equal to each other; very long texts are whole; null ids
sort last (a class of null ids only has a null ``keep_id``, and all its rows stay); rows that repeat an
id and a text all count in ``group_size`` and are all marked as kept (``deduplicate`` keeps one of
them); an id that repeats with different texts is one row for each; an empty table gives an empty
result; other columns pass through ``deduplicate`` unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import BROADCAST_ROWS, WS, fresh, sized, whole_text
from corvane.plans.scratch import materialize, release


def normalised(text: Column | None = None) -> Column:
    """Each run of white space becomes one space."""
    return F.regexp_replace(whole_text() if text is None else text, f"{WS}+", " ")


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def classes(docs: DataFrame, hash_fn=content_hash) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    ``hash_fn`` is a parameter so that tests can force collisions.
    """
    keyed = docs.select("doc_id", normalised().alias("_t"))
    keyed = keyed.select("doc_id", "_t", hash_fn(F.col("_t")).alias("_h"))
    slim = materialize(keyed.select("doc_id", "_h", F.unhex(F.sha2("_t", 256)).alias("_sha")), "slim")
    groups = materialize(slim.groupBy("_h").agg(F.min("doc_id").alias("_k"), F.count(F.lit(1)).alias("_n")), "hashes")
    repeated = materialize(groups.where("_n > 1").select("_h", "_k"), "repeated")
    members = materialize(keyed.join(sized(repeated), "_h"), "texts")
    release(repeated)
    keeper = materialize(members.where(F.col("doc_id").eqNullSafe(F.col("_k"))).groupBy("_h").agg(F.min("_t").alias("_kt")), "keepers")
    odd = materialize(members.join(keeper, "_h").where(F.col("_t") != F.col("_kt")).select("doc_id", "_h", "_t"), "collisions")
    if odd.isEmpty():
        found = slim.join(groups, "_h").select("doc_id", F.col("_k").alias("keep_id"), F.col("_n").alias("group_size"), "_sha")
    else:
        # a hash of several texts: its classes are those of the bytes
        mixed = odd.select("_h").distinct()
        plain = slim.join(groups, "_h").join(mixed, "_h", "left_anti").select("doc_id", F.col("_k").alias("keep_id"), F.col("_n").alias("group_size"), "_sha")
        texts = members.join(mixed, "_h", "left_semi").select("doc_id", "_t")
        own = materialize(texts.groupBy("_t").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "bytes")
        apart = texts.join(own, "_t").select("doc_id", "keep_id", "group_size", F.unhex(F.sha2("_t", 256)).alias("_sha"))
        found = plain.unionByName(apart)
        found = materialize(found, "classes")
    release(odd, members, keeper)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    What goes is a slim side, the rows marked as not kept; beyond the broadcast bound the join shuffles.
    """
    found = materialize(classes(docs), "classes")
    id_, sha_, own_ = fresh(docs, "_id", "_gone", "_own")
    gone = materialize(found.where(~F.col("kept")).select(F.col("doc_id").alias(id_), F.unhex("text_sha256").alias(sha_)).distinct(), "gone")
    keyed = docs.withColumn(own_, F.unhex(F.sha2(normalised(), 256)))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own_) == F.col(sha_))
    stay = keyed.join(sized(gone), same, "left_anti")
    # rows that repeat an id and a text are one document
    twice = found.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1")
    twice = materialize(twice.select(F.col("doc_id").alias(id_), F.unhex("text_sha256").alias(sha_)), "twice")
    n = twice.count()
    if n:
        side = F.broadcast(twice) if n <= BROADCAST_ROWS else twice
        again = stay.join(side, same, "left_semi").dropDuplicates(["doc_id", own_])
        stay = stay.join(side, same, "left_anti").unionByName(again)
    return stay.drop(own_)
