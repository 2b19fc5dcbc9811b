from pyspark.sql import functions as F

from corvane.streaming import index_stream


def test_index_grows(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(1, "one two\none", "s", "en"), (2, "two", "s", "en")]
    schema = "doc_id long, text string, source string, lang string"
    for part in (rows[:1], rows[1:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        index_stream.append_postings(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("term").agg(F.sum("tf").alias("n")).collect()
    assert {r.term: r.n for r in got} == {"one": 2, "two": 2}


def test_windows_stream_like_tables(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    query = index_stream.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("w")) == key(index_stream.windowed_counts(events))


def test_sql_functions(spark):
    index_stream.register_sql(spark)
    assert [r.token for r in spark.sql("SELECT * FROM tokenize('GDP rose 7.4%')").collect()] == ["GDP", "rose", "7.4%"]
    assert spark.sql("SELECT porter('hopping') AS s").first().s == "hop"
    assert tuple(spark.sql("SELECT snowball('skies'), lancaster('maximum'), lemma('cities'), porter(NULL)").first()) == ("sky", "maxim", "city", None)
    assert [(e.category, e.text) for e in spark.sql("SELECT expressions('up 7.4% in 2025') AS e").first().e] == [("percentage", "7.4%"), ("year", "2025")]
    assert spark.sql("SELECT hybrid_tokens('up 7.4 per cent now') AS t").first().t == ["up", "7.4 per cent", "now"]
