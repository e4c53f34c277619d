"""File listings and JSON-lines stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.text import is_blank
from folioflow.session import stage_path


def _name_parts(df: DataFrame, name: str) -> DataFrame:
    """Extension (lower case) and stem of a file name."""
    return df.withColumn("extension", F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))).withColumn(
        "stem", F.regexp_replace(name, r"\.[^.]*$", "")
    )


def list_corpus(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root``: folder, filename, extension, stem, length, sha256.

    Files directly in ``root`` have a null folder.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split(":", 1)[-1].rstrip("/") + "/"
    relative = F.substring_index(F.col("path"), base, -1)
    named = files.select(
        F.nullif(F.regexp_extract(relative, r"^(.*)/[^/]*$", 1), F.lit("")).alias("folder"),
        F.regexp_extract(relative, r"([^/]*)$", 1).alias("filename"),
        "length",
        F.sha2("content", 256).alias("sha256"),
    )
    return _name_parts(named, "filename")


def list_pages(pages: DataFrame) -> DataFrame:
    """The same listing for pages kept in a table ``(page_id, url, html)``."""
    named = pages.select(
        "page_id",
        F.lpad(F.col("page_id").cast("string"), 6, "0").alias("folder"),
        F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("filename"),
        F.octet_length("html").alias("length"),
        F.sha2("html", 256).alias("sha256"),
    )
    return _name_parts(named, "filename")


def parse_json_lines(df: DataFrame, line: str, schema: T.StructType, known: Column) -> DataFrame:
    """Parse a column of JSON lines without stopping at bad ones.

    Adds ``record`` and ``outcome``: ``blank``, ``invalid_json``, ``rejected``
    (``known`` does not hold) or ``ok``.  ``known`` refers to ``record``.
    """
    corrupt = "_corrupt"
    full = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    parsed = F.from_json(line, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    out = df.withColumn("record", parsed)
    outcome = (
        F.when(is_blank(F.col(line)), "blank")
        .when(F.col("record").isNull() | F.col("record")[corrupt].isNotNull(), "invalid_json")
        .when(~F.coalesce(known, F.lit(False)), "rejected")
        .otherwise("ok")
    )
    return out.withColumn("outcome", outcome)


def read_jsonl_tolerant(
    spark: SparkSession, path: str, schema: T.StructType, known: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Good records, and the rejected lines with the reason; blank lines vanish."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    parsed = parse_json_lines(lines, "line", schema, F.lit(True) if known is None else known)
    good = parsed.filter("outcome = 'ok'").select(*[F.col("record")[f.name].alias(f.name) for f in schema.fields])
    return good, parsed.filter("outcome in ('invalid_json', 'rejected')").select("line", "outcome")


def read_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of a JSON-lines stage; the first bad line stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_stage(df: DataFrame, path: str, fmt: str = "parquet", **options: str) -> None:
    """Write a stage, replacing what was there; ``options`` are the writer's."""
    df.write.mode("overwrite").format(fmt).options(**options).save(path)


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Cuts the lineage where a result is read several times; unlike a cache the
    table outlives a lost executor.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    write_stage(df, path, **options)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal out a table that is stored in fewer pieces than there are cores.

    Costly text work on one row group would otherwise run in one task.  A
    table with enough splits, which is any large one, is left as it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
