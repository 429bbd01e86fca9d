"""Nested JSON: arrays of objects that each hold an array of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.sources.tables import text_schema


def record_type(columns: Sequence[str]) -> str:
    return "struct<" + ",".join(f"`{name}`:string" for name in columns) + ">"


def document_type(field: str, columns: Sequence[str]) -> str:
    """Type of one element that holds its records under ``field``."""
    return f"struct<`{field}`:array<{record_type(columns)}>>"


def read_nested(spark: SparkSession, path: str, field: str, columns: Sequence[str], first_only: bool = False):
    """Records of a JSON file ``[{field: [record, …]}, …]`` with their arrival order.

    ``file_name``, ``element_seq`` and ``ingest_seq`` name the place a record came from: file, element and position
    are all that "first" and "last" can mean on a cluster. A file is read whole, as any JSON array must be.
    """
    elements = F.from_json(F.col("value"), f"array<{document_type(field, columns)}>")
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_name"), F.posexplode(elements).alias("element_seq", "_e"))
    chosen = files.where("element_seq = 0") if first_only else files
    return chosen.select("file_name", "element_seq", F.posexplode(F.col("_e")[field]).alias("ingest_seq", "_r")).select(
        "file_name", "element_seq", "ingest_seq", "_r.*"
    )


def read_records(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Records of a flat JSON array."""
    return spark.read.schema(text_schema(columns)).option("multiLine", True).json(path)


def first_records(df: DataFrame, document: str, field: str, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Records of the first element of a JSON text column."""
    parsed = F.from_json(F.col(document), f"array<{document_type(field, columns)}>")
    return _records(df.select(*keep, F.get(parsed, F.lit(0))[field].alias("_records")), keep)


def all_records(df: DataFrame, document: str, field: str, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Records of all elements of a JSON text column, one after the other."""
    parsed = F.from_json(F.col(document), f"array<{document_type(field, columns)}>")
    return _records(df.select(*keep, F.flatten(parsed[field]).alias("_records")), keep)


def _records(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, F.posexplode("_records").alias("ingest_seq", "_r")).select(*keep, "ingest_seq", "_r.*")


def json_field(document: Column, name: str) -> Column:
    return F.get_json_object(document, f"$.{name}")
