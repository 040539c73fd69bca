"""Recognition on request: micro-batches of (image_id, line_idx, request_seq, method) against a table of results.

Results are appended once for each line; what is there already isn't read again. A fixed trigger stands for waiting until
requests pause: Spark has ticks, not a debounce. Newer requests come first within a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

KEY = ["image_id", "line_idx"]
#: Lines read together.
CHUNK = 4


def open_requests(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Requests of the batch that have no result and weren't cancelled later, one for each line, the newest first."""
    cancelled = requests.where("method = 'cancelRecognition'").groupBy("image_id").agg(F.max("request_seq").alias("_gone"))
    asked = requests.where("method = 'recognizeText'").groupBy(*KEY).agg(F.max("request_seq").alias("request_seq"))
    asked = asked.join(cancelled, "image_id", "left").where("_gone is null or request_seq > _gone").drop("_gone")
    return asked.join(results.select(*KEY), KEY, "left_anti").orderBy(F.desc("request_seq"))


def in_chunks(requests: DataFrame) -> DataFrame:
    """requests with chunk_no: the lines of an image in groups of CHUNK, the newest requests first."""
    place = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("request_seq"), "line_idx"))
    return requests.withColumn("chunk_no", F.floor((place - 1) / CHUNK).cast("int"))


def first_results(results: DataFrame) -> DataFrame:
    """One row for each line: the result with the smallest request_seq."""
    names = [c for c in results.columns if c not in KEY]
    first = F.min_by(F.struct(*names), F.col("request_seq"))
    return results.groupBy(*KEY).agg(first.alias("_r")).select(*KEY, *[F.col(f"_r.{c}").alias(c) for c in names])


def line_states(lines: DataFrame, requests: DataFrame, results: DataFrame) -> DataFrame:
    """lines (image_id, line_idx) with state: done where there is a result, if only a null one, pending where one was asked for, else absent.

    The columns of the line's result come along as result, null without one. requests may name a line often; results has
    one row for each.
    """
    asked = requests.where("method = 'recognizeText'").select(*KEY, F.lit(True).alias("_asked")).distinct()
    done = results.select(*KEY, F.struct(*[c for c in results.columns if c not in KEY]).alias("result"), F.lit(True).alias("_done"))
    met = lines.join(done, KEY, "left").join(asked, KEY, "left")
    return met.withColumn("state", F.when(F.col("_done"), "done").when(F.col("_asked"), "pending").otherwise("absent")).drop("_done", "_asked")


def serve(
    spark: SparkSession, requests: DataFrame, read: Callable[[DataFrame], DataFrame], results_path: str, schema: str,
    checkpoint: str, every: str = "100 milliseconds", available_now: bool = False,
) -> StreamingQuery:
    """Reads each line once: read takes open requests with chunk_no and returns rows of the results' schema.

    A batch writes to a folder of its own number, which a repeated batch overwrites, so a failure between writing and
    committing adds nothing twice.
    """

    def handle(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        # Only folders of earlier batches count: this one's may be left from an attempt that failed.
        done = session.createDataFrame([], schema)
        if number:
            rows = session.read.schema(f"{schema}, batch long").parquet(results_path)
            done = rows.where(F.col("batch") < number).drop("batch")
        read(in_chunks(open_requests(batch, done))).write.mode("overwrite").parquet(f"{results_path}/batch={number}")

    writer = requests.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
