"""Readers: tables of a folder, and files of documents or of graph rows in common formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, header: bool = True, sep: str = ",") -> DataFrame:
    """Delimited text with a schema; nothing is inferred, so there is one pass."""
    return spark.read.schema(schema).csv(path, header=header, sep=sep)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_graph_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a dump with one node or relationship a line: vertices id, labels, props; edges id, src, dst, type, props."""
    end = "struct<id: string, labels: array<string>>"
    rows = spark.read.schema(f"type string, id string, labels array<string>, label string, properties map<string, string>, start {end}, `end` {end}").json(path)
    nodes = rows.filter("type = 'node'").select("id", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.col("properties").alias("props"))
    edges = rows.filter("type = 'relationship'").select("id", F.col("start.id").alias("src"), F.col("end.id").alias("dst"), F.col("label").alias("type"), F.col("properties").alias("props"))
    return nodes, edges


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
