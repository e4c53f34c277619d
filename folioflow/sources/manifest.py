"""Manifest tables: closed schemas, trimmed strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.text import strip

ACT_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("act_id", "act_name", "short_name", "filename", "source_url")]
    + [T.StructField("retrieved_date", T.DateType()), T.StructField("sha256", T.StringType())]
)

JUDGMENT_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("folder", "case_id", "case_name", "citation", "court")]
    + [
        T.StructField("year", T.IntegerType()),
        T.StructField("primary_section", T.StringType()),
        T.StructField("other_sections", T.ArrayType(T.StringType())),
        T.StructField("outcome", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("source_doc_id", T.StringType()),
        T.StructField("html_filename", T.StringType()),
        T.StructField("pdf_filename", T.StringType()),
        T.StructField("retrieved_date", T.DateType()),
        T.StructField("html_sha256", T.StringType()),
        T.StructField("pdf_sha256", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("relevance_score", T.DoubleType()),
        T.StructField("classifier_reasoning", T.StringType()),
        T.StructField("manual_review_notes", T.StringType()),
    ]
)

OUTCOMES = ("conviction-upheld", "conviction-set-aside", "bail-granted", "bail-denied", "other")
STATUSES = ("pending", "approved", "rejected", "needs-review")


def trim_strings(df: DataFrame) -> DataFrame:
    """Trim every string column and every string inside an array."""
    columns = []
    for field in df.schema.fields:
        col = F.col(field.name)
        if isinstance(field.dataType, T.StringType):
            col = strip(col)
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StringType):
            col = F.transform(col, strip)
        columns.append(col.alias(field.name))
    return df.select(*columns)


def read_manifest(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json") -> DataFrame:
    """A manifest table under its schema; an unreadable record stops the read."""
    reader = spark.read.schema(schema)
    if fmt == "json":
        reader = reader.option("mode", "FAILFAST")
    return trim_strings(reader.format(fmt).load(path))
