"""Report, sample and model sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_report(df: DataFrame, path: str, list_sep: str = ";") -> None:
    """CSV report; a list column is written as its joined text."""
    flat = df.select(
        *[
            (F.concat_ws(list_sep, f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name))
            for f in df.schema.fields
        ]
    )
    flat.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_samples(df: DataFrame, path: str, partition_by: Sequence[str] = ("study",)) -> None:
    """Parquet sample table stored by study, so that study filters prune files."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
