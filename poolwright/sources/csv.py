"""Typed CSV: a header, trimmed values, an error for a row that does not fit."""

from pyspark.sql import DataFrame, SparkSession

from poolwright.schema import Model


def read_csv(spark: SparkSession, path: str, model: Model) -> DataFrame:
    return (spark.read.schema(model.schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
            .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path))
