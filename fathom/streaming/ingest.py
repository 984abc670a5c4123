"""Term counts kept up to date over a stream of documents, as an addition to the batch index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index


def append_frequencies(stream: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes the (term, doc_id, tf, first_line) of each micro-batch of (doc_id, relative_path, content) under folder/batch=N.

    A batch that is tried again replaces what it wrote before, so rows come exactly once.
    """

    def write(batch: DataFrame, n: int) -> None:
        Index(batch).frequencies.write.mode("overwrite").parquet(f"{folder}/batch={n}")

    started = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (started.trigger(availableNow=True) if once else started).start()


def term_df(frequencies: DataFrame) -> DataFrame:
    return frequencies.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
