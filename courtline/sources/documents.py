"""Nested documents at the edges: one row a document going out, long tables coming in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def nest(points: DataFrame, key: str, order: list[str], child: str = "points") -> DataFrame:
    """(key, document): JSON with the key and its rows in order. A key's rows meet in one task, as in the document."""
    fields = [c for c in points.columns if c != key]
    rows = F.array_sort(F.collect_list(F.struct(*order, *[c for c in fields if c not in order])))
    return points.groupBy(key).agg(rows.alias(child)).select(key, F.to_json(F.struct(key, child)).alias("document"))


def unnest(documents: DataFrame, key: str, rows: StructType, child: str = "points") -> DataFrame:
    """The long table of nest()'s documents; `rows` is the schema of a child."""
    schema = StructType().add(key, documents.schema[key].dataType).add(child, ArrayType(rows))
    return documents.select(F.from_json("document", schema).alias("d")).select(f"d.{key}", F.explode(f"d.{child}").alias("p")).select(key, "p.*")


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON text a line under `path`, which executors must share."""
    documents.select(F.col("document").alias("value")).write.mode("overwrite").text(path)


def read_documents(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
