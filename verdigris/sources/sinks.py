"""Writers of the documents and tables that others read; each overwrites what it wrote before."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_markdown(rows: DataFrame, path: str, by: list[str]) -> None:
    """Markdown documents (column ``markdown``) as text files, in one folder for each value of ``by``."""
    rows.select(*by, F.col("markdown").alias("value")).write.mode("overwrite").partitionBy(*by).text(path)


def write_entities(batches: DataFrame, path: str) -> None:
    """Entity batches as JSON, ``{"entities": [...]}`` for each source section, readable by ``parsers.entity_batches``."""
    rows = batches.select(F.array(F.struct(*batches.columns)).alias("entities"))
    rows.write.mode("overwrite").json(path)


def write_ranges(rows: DataFrame, path: str) -> None:
    """Hops partitioned by framework and major version, so that a reader of one range prunes the others."""
    major = F.floor(F.col("hop_from") / 1000000).cast("int")
    rows.withColumn("major", major).write.mode("overwrite").partitionBy("framework", "major").parquet(path)
