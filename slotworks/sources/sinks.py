"""Prediction, report and publish-once sinks."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.labels import pivot_labels


def write_predictions(df: DataFrame, path: str, labels: list[str], value: str = "prob", key: str = "study_id", fmt: str = "csv",
                      mode: str = "errorifexists") -> None:
    """Wide, in the fixed label order, sorted by id through a range partitioning."""
    wide = pivot_labels(df, [key], labels, value).select(key, *[f"`{c}`" for c in labels]).orderBy(key)
    writer = wide.write.mode(mode)
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path))


def _hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def publish_once(df: DataFrame, path: str, receipt: DataFrame) -> None:
    """Publish `df` at path/data and then its receipt at path/receipt, once.

    An existing output is refused. Data is staged beside the target and renamed
    when complete; the receipt comes last, so a reader that waits for it never
    sees half an output. A failed attempt removes what it made itself.
    """
    spark = df.sparkSession
    fs, target = _hadoop_path(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    staging = f"{path}__staging"
    fs_s, staged = _hadoop_path(spark, staging)
    if fs_s.exists(staged):
        raise FileExistsError(staging)
    try:
        df.write.mode("errorifexists").parquet(f"{staging}/data")
        receipt.coalesce(1).write.mode("errorifexists").json(f"{staging}/receipt")  # one small row
        if not fs.rename(staged, target):
            raise OSError(f"could not publish {path}")
    except Exception:
        if fs_s.exists(staged):
            fs_s.delete(staged, True)
        raise


def write_report(metrics: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines in which no number is NaN or infinite: those become null."""
    clean = [F.when(S.is_finite(f.name), F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name)
             for f in metrics.schema]
    metrics.select(*clean).write.mode(mode).option("ignoreNullFields", False).json(path)
