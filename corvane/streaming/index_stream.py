"""Streaming extensions: the index grows with new units, events are counted by watermarked windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators import index as ix
from corvane.sources.corpus import units


def append_postings(documents: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Postings of each batch of new documents, written under the batch's number.

    A batch that is run again after a failure overwrites its own folder, so no posting is doubled.
    """

    def write(batch: DataFrame, number: int) -> None:
        post = ix.postings(ix.tokens(units(batch)))
        post.sortWithinPartitions("term", "unit_id").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks need instants; times without a zone are taken in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total): works on streams and on tables alike."""
    w = _timed(events).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, n) of runs of events of one user with smaller gaps."""
    w = _timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return w.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def register_sql(spark: SparkSession) -> None:
    """For SQL: the table function ``tokenize(text)``; ``expressions(text)`` and ``hybrid_tokens(text)`` as arrays; ``lemma(word)`` and a function for each stemmer."""
    from pyspark.sql.functions import pandas_udf, udtf

    from corvane.functions import morphology, snippets, typed

    @udtf(returnType="pos int, token string, rule string")
    class Tokenize:
        def eval(self, text: str):
            for pos, (token, rule) in enumerate(typed.explain(text or "")):
                yield pos, token, rule

    def of_words(function):
        @pandas_udf("string")
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda w: None if w is None else function(w))

        return run

    @pandas_udf("array<struct<category:string,text:string,start:int,end:int>>")
    def expressions(s: pd.Series) -> pd.Series:
        keys = ("category", "text", "start", "end")
        return s.map(lambda t: [dict(zip(keys, e)) for e in typed.expressions(t or "")])

    @pandas_udf("array<string>")
    def hybrid(s: pd.Series) -> pd.Series:
        return s.map(lambda t: typed.hybrid(t or "", snippets.treebank))

    spark.udtf.register("tokenize", Tokenize)
    spark.udf.register("expressions", expressions)
    spark.udf.register("hybrid_tokens", hybrid)
    for name, function in morphology.STEMMERS.items():
        spark.udf.register(name, of_words(function))
