"""Saving of Python models that hold other models or a table next to their parameters."""

from __future__ import annotations

from pyspark.ml import Model, PipelineModel
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession


class _Writer(MLWriter):
    def __init__(self, instance: "CompositeModel"):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        m = self.instance
        extra = {"parts": len(m.parts), "table": m.table is not None}
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata=extra)
        for i, part in enumerate(m.parts):
            PipelineModel([part]).write().overwrite().save(f"{path}/parts/{i}")
        if m.table is not None:
            m.table.write.mode("overwrite").parquet(f"{path}/table")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> "CompositeModel":
        spark = SparkSession.getActiveSession()
        meta = DefaultParamsReader.loadMetadata(path, spark)
        model = self.cls()
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        model.parts = [PipelineModel.load(f"{path}/parts/{i}").stages[0] for i in range(meta["parts"])]
        model.table = spark.read.parquet(f"{path}/table") if meta["table"] else None
        return model


class CompositeModel(Model, MLWritable, MLReadable):
    """Model with fitted ``parts`` and an optional ``table``."""

    def __init__(self):
        super().__init__()
        self.parts: list[Model] = []
        self.table: DataFrame | None = None

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)
