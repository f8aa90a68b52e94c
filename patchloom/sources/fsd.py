"""Implicates on disk: Parquet by implicate number, partial reads, and a catalog of what a folder holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchloom.functions.threads import in_parallel


def write_implicates(df: DataFrame, path: str, m_col: str = "M") -> str:
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(m_col).parquet(path)
    return path


def read_implicates(spark: SparkSession, path: str, columns: Sequence[str] | None = None, m: int | None = 1, match: DataFrame | None = None, m_col: str = "M") -> DataFrame:
    """The first m implicates (all for None) and the named columns, of rows that match has: partitions, columns and rows are left out in the scan where they can be."""
    df = spark.read.parquet(path)
    if m is not None:
        df = df.where(F.col(m_col) <= m)
    if match is not None:
        df = df.join(match.distinct(), match.columns, "left_semi")
    return df.select(*dict.fromkeys([m_col, *columns])) if columns else df


#: Columns that every data set has for its own sake, and what a name's letter says of whom its rows are.
HOUSEKEEPING, RESPONDENT = ("M", "year", "hid", "weight"), {"H": "Household", "P": "Person"}
#: Footers that are read at a time.
READERS = 8


def data_sets(spark: SparkSession, root: str, pattern: str = "*.parquet") -> list[str]:
    """The paths of the data sets under a folder, listed by Spark's own file source, so any store that Spark reads will do."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).select("path")
    return [r[0] for r in files.select(F.regexp_replace("path", r"/(part-[^/]*|[^/]*=[^/]*/.*)$", "").alias("p")).distinct().orderBy("p").collect()]  # one row a data set


def _columns(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, var, type) from footers alone, some data sets at a time."""
    schemas = in_parallel([lambda p=p: spark.read.parquet(p).schema for p in paths], READERS)
    found = [(p, f.name, f.dataType.simpleString()) for p, schema in zip(paths, schemas, strict=True) for f in schema]
    return spark.createDataFrame(found, T.StructType([T.StructField(c, T.StringType()) for c in ("path", "var", "type")]))


def catalog(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, var, type) of the data sets under a folder, from listings and footers alone."""
    return _columns(spark, data_sets(spark, root, pattern))


def lookup(spark: SparkSession, root: str, var: Sequence[str] | None = None, year: Sequence[str | int] | None = None, pattern: str = "*.parquet") -> DataFrame:
    """(var, acs_year, respondent, survey, vintage, path) of the variables under a folder, sorted; those named, of the years given.

    Data sets are named survey_vintage_year_letter_kind, with further parts before the year if need be; what a name does not
    tell is null. Only footers of the years asked for are read. Columns of HOUSEKEEPING and replicate weights are no variables.
    """
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    part = lambda pattern, k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    known = spark.createDataFrame([(p,) for p in data_sets(spark, root, pattern)], "path string").select(
        "path", part(r"(\d{4})_[^_]*_[^_]*$", 1).alias("acs_year"), F.create_map(*[F.lit(v) for kv in RESPONDENT.items() for v in kv])[part(r"_(.)_[^_]*$", 1)].alias("respondent"),
        part(r"^([^_]*)_([^_]*)", 1).alias("survey"), part(r"^([^_]*)_([^_]*)", 2).alias("vintage"),
    )
    if year is not None:
        known = known.where(F.col("acs_year").isin([str(y) for y in year]))
    columns = _columns(spark, [r.path for r in known.select("path").orderBy("path").collect()]).drop("type")
    columns = columns.where(~F.col("var").isin(*HOUSEKEEPING) & ~F.col("var").rlike(r"^rep_\d*$"))
    if var is not None:
        columns = columns.where(F.col("var").isin(list(var)))
    out = columns.join(known, "path").select("var", "acs_year", "respondent", "survey", "vintage", "path")
    return out.orderBy(*out.columns)
