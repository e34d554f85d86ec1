"""Segmentation of books as they arrive.

A book is one row, and its walk and assembly are expressions over that row, so the batch plan
runs on a stream as it is: no state, no watermark, and each input row gives its chunks once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import models
from ..plans.segment import segment_documents


def segment_stream(docs: DataFrame, model: models.BoundaryModel | None = None) -> DataFrame:
    """docs: a streaming frame with doc_id and text."""
    return segment_documents(docs, model)


def start(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: str | T.StructType = "doc_id bigint, text string", model: models.BoundaryModel | None = None, **trigger) -> StreamingQuery:
    """Segments the Parquet files that come to ``source`` and appends chunks to ``sink``; a file is taken once, also after a restart."""
    docs = spark.readStream.schema(schema).parquet(source)
    out = segment_stream(docs, model).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return out.format("parquet").trigger(**(trigger or {"availableNow": True})).start(sink)
