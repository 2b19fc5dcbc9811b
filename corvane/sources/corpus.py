"""Corpus sources: documents to units, web pages to sections, dialogues to turns, files to inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.plans.scratch import materialize

UNIT_SCHEMA = T.StructType(
    [T.StructField(n, k()) for n, k in (
        ("unit_id", T.StringType), ("document_id", T.StringType), ("source_id", T.StringType), ("page_id", T.StringType),
        ("page_number", T.IntegerType), ("section_id", T.StringType), ("section_number", T.StringType), ("section_title", T.StringType),
        ("unit_type", T.StringType), ("unit_index", T.IntegerType), ("text", T.StringType), ("char_count", T.IntegerType), ("word_count", T.IntegerType),
    )]
)


#: Tables whose rows carry long texts.
TEXTS = ("documents", "pages", "conversations")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out if its files give fewer splits than there are cores.

    A file of one row group is one task however many cores wait.  Tables of many splits stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def numbered(df: DataFrame, *by: str) -> DataFrame:
    """Each row with its ``number`` from 1 in the order of ``by``: counted inside key ranges, which start after the rows of those before."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(ranges, *by).withColumn("_range", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    return dealt.withColumn("number", inside).join(F.broadcast(starts), "_range").withColumn("number", F.col("number") + F.col("_start")).drop("_range", "_start")


def units(documents: DataFrame) -> DataFrame:
    """(unit_id, document_id, source_id, lang, unit_index, unit_type, text): the lines that aren't blank."""
    lines = documents.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("unit_index", "text"))
    lines = lines.where(F.trim("text") != "")
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace("text", r"[^\p{Lu}]", ""))
    words = F.size(F.split(F.trim("text"), " +"))
    kind = (
        F.when(letters * 2 <= F.length("text"), "table")
        .when((words <= 8) & (upper * 10 >= letters * 7), "heading")
        .otherwise("paragraph")
    )
    return lines.select(
        F.format_string("D%06d_U%05d", "doc_id", "unit_index").alias("unit_id"),
        F.format_string("D%06d", "doc_id").alias("document_id"),
        F.col("source").alias("source_id"),
        "lang",
        "unit_index",
        kind.alias("unit_type"),
        "text",
    )


#: Lines of a text that count as one page.
PAGE_LINES = 40


def structured(rows: DataFrame) -> DataFrame:
    """Units with their page and the section they stand in, the last heading at or before them."""
    upto = Window.partitionBy("document_id").orderBy("unit_index").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("unit_type") == "heading"
    number = F.sum(heading.cast("int")).over(upto)
    page = (F.floor(F.col("unit_index") / PAGE_LINES) + 1).cast("int")
    return (
        rows.withColumn("page_number", page)
        .withColumn("page_id", F.format_string("%s_P%03d", "document_id", "page_number"))
        .withColumn("_n", number)
        .withColumn("section_title", F.coalesce(F.last(F.when(heading, F.col("text")), ignorenulls=True).over(upto), F.lit("UNKNOWN")))
        .withColumn("section_number", F.when(F.col("_n") > 0, F.col("_n").cast("string")).otherwise(""))
        .withColumn("section_id", F.when(F.col("_n") > 0, F.format_string("%s_SEC_%d", "document_id", "_n")).otherwise(""))
        .drop("_n")
    )


def registry(documents: DataFrame) -> DataFrame:
    """One row a document: its place, size, pages and digest."""
    lines = F.size(F.split("text", "\n"))
    bytes_ = F.octet_length("text").cast("long")
    return documents.select(
        "doc_id", F.format_string("D%06d", "doc_id").alias("document_id"), F.col("source").alias("source_id"), F.format_string("d%06d.txt", "doc_id").alias("filename"),
        bytes_.alias("bytes"), F.ceil(lines / PAGE_LINES).cast("int").alias("page_count"), F.sha2("text", 256).alias("sha256"),
        F.when(bytes_ < 512, "INVALID").otherwise("OK").alias("status"),
    )


def page_sections(pages: DataFrame) -> DataFrame:
    """(page_id, element_index, level, text): headings and paragraphs of raw web pages, tags stripped."""
    cut = F.split(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", ""), r"(?i)(?=<h[1-6][ >]|<p[ >]|<li[ >]|<td[ >])")
    parts = pages.select("page_id", F.posexplode(cut).alias("element_index", "part"))
    level = F.regexp_extract("part", r"(?i)^<h([1-6])", 1)
    text = F.trim(F.regexp_replace(F.regexp_replace("part", r"<[^>]*>", " "), r"\s+", " "))
    return parts.select("page_id", "element_index", F.when(level != "", level.cast("int")).alias("level"), text.alias("text")).where("text != ''")


def turns(conversations: DataFrame) -> DataFrame:
    """Dialogues as units: a conversation is a document, a turn a unit."""
    return conversations.select(
        F.format_string("C%06d", "conv_id").alias("document_id"), F.format_string("C%06d_T%03d", "conv_id", "turn").alias("unit_id"), "role", "text"
    )


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with an explicit schema; lines that don't parse are kept in ``_corrupt_record``."""
    schema = T.StructType([*UNIT_SCHEMA.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def file_inventory(spark: SparkSession, path: str, pattern: str = "*", least: int = 512) -> DataFrame:
    """(path, length, sha256, status) of files below ``path``, in path order by ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    status = F.when(F.col("length") < least, "INVALID").otherwise("OK")
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), status.alias("status"))


def load_evidence(spark: SparkSession, required: dict[str, str], optional: dict[str, str], schemas: dict[str, T.StructType]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables by name, problems): CSV results of an earlier run; what is missing is an empty table and, if required, a problem."""
    tables, problems = {}, []
    for name, path in {**required, **optional}.items():
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            tables[name] = read_csv(spark, path, schemas[name])
            continue
        tables[name] = spark.createDataFrame([], schemas[name])
        if name in required:
            problems.append((name, path, "missing"))
    return tables, spark.createDataFrame(problems, "name string, path string, problem string")


def by_unit(entities: DataFrame) -> DataFrame:
    """(unit_id, entities) of entity rows."""
    return entities.groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct(*(c for c in entities.columns if c != "unit_id")))).alias("entities"))
