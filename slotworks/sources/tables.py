"""Readers for study, series, label, grade and manifest tables.

Every reader takes an explicit schema (no inference pass) and returns the
canonical column names of the library.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..operators.labels import unpivot


def read_table(spark: SparkSession, path, schema: T.StructType | str | None = None, fmt: str | None = None) -> DataFrame:
    fmt = fmt or ("csv" if str(path).rstrip("/").endswith((".csv", ".csv.gz")) else "parquet")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def read_studies(spark: SparkSession, path, labels: list[str], key: str = "StudyInstanceUID", report: str | None = "Report",
                 fmt: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """(study_id STRING, report, labels DOUBLE NULL). `columns` is the header order of
    a CSV file; ids are read as strings so that no digit is lost."""
    schema = None
    if columns is not None:
        text = {key, report}
        schema = T.StructType([T.StructField(c, T.DoubleType() if c in labels else T.StringType()) for c in columns])
        missing = (set(labels) | text - {None}) - set(columns)
        if missing:
            raise ValueError(f"columns missing: {sorted(missing)}")
    df = read_table(spark, path, schema, fmt)
    cols = [F.col(f"`{key}`").cast("string").alias("study_id")]
    if report:
        cols.append(F.col(f"`{report}`").alias("report"))
    return df.select(*cols, *[S.null_if_nan(F.col(f"`{c}`").cast("double")).alias(c) for c in labels])


SERIES = T.StructType([T.StructField("StudyInstanceUID", T.StringType()), T.StructField("SeriesInstanceUID", T.StringType()),
                       T.StructField("Fat_Suppression", T.IntegerType()), T.StructField("Anatomical_Plane", T.StringType())])


def read_series(spark: SparkSession, path, names: dict[str, str] | None = None, schema: T.StructType | None = None,
                fmt: str | None = None, keep: list[str] = ()) -> DataFrame:
    """(study_id, series_id, fat_sup INT, plane) plus `keep`; all four are required."""
    names = names or {"study_id": "StudyInstanceUID", "series_id": "SeriesInstanceUID", "fat_sup": "Fat_Suppression", "plane": "Anatomical_Plane"}
    df = read_table(spark, path, schema, fmt)
    absent = [v for v in names.values() if v not in df.columns]
    if absent:
        raise ValueError(f"series columns missing: {absent}")
    types = {"study_id": "string", "series_id": "string", "fat_sup": "int", "plane": "string"}
    return df.select(*[F.col(f"`{names[c]}`").cast(t).alias(c) for c, t in types.items()], *keep)


def read_label_sources(spark: SparkSession, files: dict[str, tuple[str, dict[str, str]]], labels: list[str],
                       key: str = "StudyInstanceUID", fmt: str | None = None) -> DataFrame:
    """Long (source, study_id, label, p). Each source gives its path and a rename from
    its column names to labels (e.g. {'ACL__label': 'ACL'}); other columns are not read."""
    def one(name, path, rename):
        df = read_table(spark, path, fmt=fmt)
        back = {v: k for k, v in rename.items()}
        wide = df.select(F.col(f"`{key}`").cast("string").alias("study_id"), *[F.col(f"`{back.get(c, c)}`").alias(c) for c in labels])
        long = unpivot(wide, ["study_id"], labels, "label", "p")
        return long.select(F.lit(name).alias("source"), "study_id", "label", S.null_if_nan("p").alias("p"))

    return reduce(DataFrame.unionByName, [one(n, *spec) for n, spec in files.items()])


def read_grades_jsonl(spark: SparkSession, path, key_map: dict[str, str], key: str = "study") -> DataFrame:
    """One JSON object per line -> (study_id, label, grade INT NULL)."""
    schema = T.StructType([T.StructField(key, T.StringType()), *[T.StructField(k, T.DoubleType()) for k in key_map]])
    df = spark.read.schema(schema).json(path)
    wide = df.select(F.col(key).alias("study_id"), *[F.col(k).alias(v) for k, v in key_map.items()])
    return unpivot(wide, ["study_id"], list(key_map.values()), "label", "grade").withColumn("grade", F.col("grade").cast("int"))


def read_manifest(spark: SparkSession, path, member: T.StructType | str, array_field: str | None = None, lines: bool = False) -> DataFrame:
    """One row per member.

    A JSON array or a document holding the array in `array_field` is parsed per
    file; `lines` reads one member per line, which splits into many tasks.
    """
    member = T._parse_datatype_string(member) if isinstance(member, str) else member
    if lines:
        return spark.read.schema(member).json(path)
    if array_field is None:
        return spark.read.schema(member).json(path, multiLine=True)
    whole = spark.read.schema(T.StructType([T.StructField(array_field, T.ArrayType(member))])).json(path, multiLine=True)
    return whole.select(F.explode(array_field).alias("_m")).select("_m.*")
