"""Sinks: flat CSV, JSON lines, marked text, judgments, index tables with a manifest."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.plans.scratch import materialize, scratch_folder


def flat(df: DataFrame) -> DataFrame:
    """Lists joined by semicolons, booleans as true/false, numbers to six places, null as empty."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ";")
        elif isinstance(f.dataType, T.DoubleType | T.FloatType):
            c = F.regexp_replace(F.format_string("%.6f", c), r"\.?0+$", "")
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").csv(path, header=True)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_marked_text(units: DataFrame, path: str) -> None:
    """One line of marks and one of text for each unit, a folder per document."""
    line = F.concat(F.lit("[UNIT="), "unit_id", F.lit("]\n"), "text", F.lit("\n"))
    units.select("document_id", line.alias("value")).write.mode("overwrite").partitionBy("document_id").text(path)


def upsert_judgments(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows by (query_id, unit_id); a new row wins, its empty fields keep the old value."""
    keys = ["query_id", "unit_id"]
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, keys, "full_outer")
    rest = [c for c in old.columns if c not in keys]
    keep = [F.coalesce(F.when(F.col(f"b.{c}").cast("string") != "", F.col(f"b.{c}")), F.col(f"a.{c}")).alias(c) for c in rest]
    return joined.select(*keys, *keep)


def save_index(spark: SparkSession, path: str, postings: DataFrame, units: DataFrame, about: dict, dictionary: DataFrame | None = None) -> None:
    """Postings as they come, once: those of ``chunks.postings`` are segments of documents, each sorted by term, so that a
    lookup prunes row groups and pages of every file and no posting is moved.  Terms are ``dictionary`` or those of the postings.
    """
    from corvane.operators.index import terms

    postings.write.mode("overwrite").parquet(f"{path}/postings")
    own = terms(spark.read.parquet(f"{path}/postings")) if dictionary is None else dictionary
    own.write.mode("overwrite").parquet(f"{path}/terms")
    units.write.mode("overwrite").parquet(f"{path}/units")
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "units"))


_saved: dict[tuple[str, str], str] = {}


def saved_index(spark: SparkSession, name: str, units: Callable[[], DataFrame], postings: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index called ``name``, built at its first use in an application and loaded from then on."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _saved:
        path = scratch_folder(spark, "index")
        found = units()
        save_index(spark, path, postings(found), found, {"name": name})
        _saved[key] = path
    return load_index(spark, _saved[key])


_tables: dict[tuple[str, str], DataFrame] = {}


def saved_table(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table called ``name``, written at its first use in an application and read from then on."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _tables:
        _tables[key] = materialize(build(), "saved")
    return _tables[key]


def write_ordered_text(units: DataFrame, path: str) -> None:
    """One file a document, its units in order, marked as in ``write_marked_text``."""
    line = F.concat(F.lit("[UNIT="), "unit_id", F.lit("]\n"), "text", F.lit("\n"))
    dealt = units.select("document_id", "unit_index", line.alias("value")).repartition("document_id").sortWithinPartitions("document_id", "unit_index")
    dealt.select("document_id", "value").write.mode("overwrite").partitionBy("document_id").text(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def purge(spark: SparkSession, folder: str, own: tuple[str, ...]) -> list[str]:
    """Deletes the managed outputs ``own`` below ``folder`` and nothing else; the names that were there."""
    gone = []
    for name in own:
        if name.strip("/") in ("", ".", "..") or "/" in name.strip("/"):
            raise ValueError(f"not an output of its own: {name!r}")
        p, fs = _fs(spark, f"{folder}/{name}")
        if fs.exists(p):
            fs.delete(p, True)
            gone.append(name)
    return gone


def swap(df: DataFrame, path: str, *order: str) -> None:
    """Writes beside ``path`` in the order of ``order``, then puts the result in its place."""
    spark = df.sparkSession
    df.orderBy(*order).write.mode("overwrite").parquet(f"{path}.next")
    new, fs = _fs(spark, f"{path}.next")
    old, _ = _fs(spark, path)
    past, _ = _fs(spark, f"{path}.past")
    if fs.exists(old):
        fs.delete(past, True)
        fs.rename(old, past)
    fs.rename(new, old)
    fs.delete(past, True)


def save_judgments(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Upserts into the judgments at ``path`` and writes them in the order of their keys."""
    p, fs = _fs(spark, path)
    rows = upsert_judgments(spark.read.parquet(path), new) if fs.exists(p) else new
    swap(rows, path, "query_id", "unit_id")


def manifest(inputs: dict[str, DataFrame], about: dict) -> DataFrame:
    """(input, rows, sha256, about): a digest of each input that does not depend on the order of its rows."""
    out = None
    for name, df in inputs.items():
        row = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))), 256)
        parts = [F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]
        total = F.concat_ws("-", *(F.coalesce(F.sum(p), F.lit(0)).cast("string") for p in parts))
        one = df.agg(F.lit(name).alias("input"), F.count(F.lit(1)).alias("rows"), F.sha2(total, 256).alias("sha256"), F.lit(json.dumps(about, sort_keys=True)).alias("about"))
        out = one if out is None else out.unionByName(one)
    return out
