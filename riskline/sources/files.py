"""Readers and writers with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskline.operators.lineage import written
from riskline.sources import schema as sc


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns of a text table, cast to its types; others are dropped unread."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def _text_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, nullValue="NA", inferSchema=False)


def read_subjects(spark: SparkSession, path: str) -> DataFrame:
    """Person table from CSV, under its file column names or ours."""
    return _typed(_text_table(spark, path).withColumnsRenamed(sc.SUBJECT_RENAMES), sc.SUBJECT)


def read_procedures(spark: SparkSession, path: str) -> DataFrame:
    """Procedure table (id, type, date) from CSV; columns by position."""
    raw = _text_table(spark, path)
    return _typed(raw.toDF(*sc.PROCEDURE.names), sc.PROCEDURE)


def read_panel_csv(spark: SparkSession, path: str) -> DataFrame:
    """Panel from CSV, under its file column names and event labels or ours."""
    raw = _text_table(spark, path).withColumnsRenamed(sc.PANEL_RENAMES)
    event = F.col("first_event")
    for label, ours in sc.EVENT_LABELS.items():
        raw = raw.withColumn("first_event", F.when(event == label, ours).otherwise(event))
    return _typed(raw, sc.PANEL)


def write_panel(panel: DataFrame, root: str, analysis: str) -> None:
    """Panel as Parquet under its analysis name, split by race and sex for stratum reads."""
    _by_folder(panel, ["race", "sex"]).write.mode("overwrite").partitionBy("race", "sex").parquet(f"{root}/analysis={analysis}")


def _by_folder(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows dealt by folder in tasks of about equal size: a large folder is written by many, small ones by one."""
    return df.hint("rebalance", *[F.col(c) for c in columns])


def read_panel(spark: SparkSession, root: str, analysis: str = "main", stratum: tuple[str, object] | None = None) -> DataFrame:
    """Panel of one analysis, or of one race or sex stratum; only its folders are read."""
    df = spark.read.schema(sc.PANEL).parquet(f"{root}/analysis={analysis}")
    if stratum is not None:
        df = df.where(F.col(stratum[0]) == stratum[1])
    return df.select(*sc.PANEL_COLUMNS)


def write_strata(df: DataFrame, root: str, columns: Sequence[str] = ("race", "sex"), levels: dict | None = None) -> None:
    """One folder tree per column with a folder per value; values outside ``levels`` are left out."""
    # The strata that are written.
    levels = levels or {"race": (1, 2, 3), "sex": ("M", "F")}
    df = written(df, "strata")
    for c in columns:
        kept = _by_folder(df.where(F.col(c).isin(list(levels[c]))), [c])
        kept.write.mode("overwrite").partitionBy(c).parquet(f"{root}/by_{c}")


def read_stratum(spark: SparkSession, root: str, column: str, value, schema: T.StructType | None = None) -> DataFrame:
    """One stratum written by ``write_strata``; other folders are pruned."""
    df = spark.read.schema(schema or sc.PANEL).parquet(f"{root}/by_{column}")
    return df.where(F.col(column) == value)


def result_path(
    root: str, analysis: str = "main", every_years: float | None = 10, reps: int = 0,
    stratum: str | None = None, weight_kind: str = "adherence",
) -> str:
    """Folder of a result, unique per analysis, protocol, stratum, weighting and replicate mode."""
    protocol = "none" if every_years is None else f"{every_years:g}yr"
    mode = "point" if reps == 0 else f"bootstrap{reps}"
    return (
        f"{root}/analysis={analysis}/weights={weight_kind}/protocol={protocol}/stratum={stratum or 'all'}/mode={mode}"
    )


def write_result(df: DataFrame, path: str, fmt: str = "parquet", order: Sequence[str] = ()) -> None:
    """Write a result as Parquet, or as CSV with a header.

    With ``order`` the files, read by name one after the other, give the rows in that order.
    """
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("nullValue", "NA").csv(path)
    else:
        writer.parquet(path)


def with_place(df: DataFrame, name: str) -> DataFrame:
    """Rows of Parquet files with their place, from 1, when the files are read by name one after the other.

    Only the number of rows of each file is ordered.
    """
    at = df.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = at.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    placed = at.join(sizes.select("_file", F.coalesce(ahead, F.lit(0)).alias("_ahead")), "_file")
    return placed.withColumn(name, F.col("_ahead") + F.col("_row") + 1).drop("_file", "_row", "_ahead")


def read_result(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Read a result back with its schema; nothing is inferred."""
    if fmt == "csv":
        return _typed(_text_table(spark, path), schema)
    return spark.read.schema(schema).parquet(path)
