import __spark_entry__ as entry
from fathom.operators.index import Index
from fathom.sources.corpus import SCHEMA, from_rows
from fathom.streaming.ingest import append_frequencies, term_df


def test_stream_equals_batch(spark, tmp_path):
    corpus = from_rows(spark, [("a.md", "one two two"), ("b.md", "two Three"), ("c.md", "")])
    corpus.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    append_frequencies(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(got.collect()) == sorted(Index(corpus).frequencies.collect())
    assert sorted(term_df(got).collect()) == sorted(Index(corpus).term_df.collect())


def test_entry_points():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert {"search_any", "postings", "related_files"} <= set(names)
