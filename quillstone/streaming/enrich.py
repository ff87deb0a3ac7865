"""Incremental upkeep: new or changed books, and late ranker input, as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstone.operators.tags import tag_books
from quillstone.schema import BOOKS, canonical


def read_new_books(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Books that arrive as Parquet files in a folder."""
    return spark.readStream.schema(BOOKS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tag_stream(books: DataFrame, lexicon: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Tags every micro-batch and appends it to ``target``; a batch that runs twice overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        latest = Window.partitionBy("book_id").orderBy(F.desc("title"))
        once = batch.withColumn("r", F.row_number().over(latest)).filter("r = 1").drop("r")
        tagged = once.drop("domain_tags").join(tag_books(once, lexicon), "book_id")
        canonical(tagged).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return books.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def requests_per_window(rows: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, target_book_id, n): scored candidates per target and tumbling window of requested_at.

    Rows are kept once per rec_id within the watermark; later ones are dropped as late. Works on a
    stream, where the watermark bounds the state, and on a table, where nothing is late."""
    marked = rows.withWatermark("requested_at", late)
    once = marked.dropDuplicates(["rec_id", "requested_at"])
    counted = once.groupBy(F.window("requested_at", window), "target_book_id").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), "target_book_id", "n")
