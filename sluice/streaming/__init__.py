"""Incremental ingestion: rows are appended as they come, and a snapshot is queried as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluice.plans.context import ROW_ID, DatasetSpec, QueryContext


def ingest(spec: DatasetSpec, stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Evaluates filters and metrics of a stream and appends them to a Parquet table; ends when it has read all."""
    ctx = spec.over(stream)
    ids = [] if ctx.id_column is None else [ctx.row_id.alias(ROW_ID)]
    flat = stream.select(*ids, *(ctx.filter(n).alias(f"f_{n}") for n in ctx.predicates), *(ctx.metric(n).alias(f"m_{n}") for n in ctx.metrics))
    return flat.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, spec: DatasetSpec, path: str) -> QueryContext:
    """What has been ingested so far; later rows don't change it."""
    df = spark.read.parquet(path)
    row_id = F.col(ROW_ID) if spec.id_column is not None else None
    return QueryContext(df, {n: F.col(f"f_{n}") for n in spec.filters}, {n: F.col(f"m_{n}") for n in spec.metrics}, row_id, spec.block_bits)
