"""Texts that were read against texts that were expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\v"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def compare(read: DataFrame, expected: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, text, expected, equal) for each text read; blanks at the ends don't count. A text that nobody expects is an error."""
    met = read.select(key, "text").join(expected.select(key, F.col("text").alias("expected")), key, "left")
    missing = F.raise_error(F.concat(F.lit("no expected text for "), F.col(key).cast("string"))).cast("string")
    met = met.withColumn("expected", F.coalesce("expected", missing))
    return met.withColumn("equal", F.coalesce(stripped(F.col("text")) == stripped(F.col("expected")), F.lit(False)))


def error_count(compared: DataFrame, *by: str) -> DataFrame:
    """(by, n_texts, n_errors)."""
    return compared.groupBy(*by).agg(F.count(F.lit(1)).alias("n_texts"), F.count_if(~F.col("equal")).alias("n_errors"))
