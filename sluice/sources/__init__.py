"""Tables, row ids, and seeded synthetic inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.plans.context import ROW_ID
from sluice.sources.shared import durable


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_set(spark: SparkSession, ids: list[int]) -> DataFrame:
    """An explicit set of row ids; order and repeats don't matter."""
    return spark.createDataFrame([(i,) for i in ids], f"{ROW_ID} long").distinct()


def latest(values: DataFrame) -> DataFrame:
    """(row_id, seq, value) to one value a row: the last written."""
    return values.groupBy(ROW_ID).agg(F.max_by("value", "seq").alias("value"))


def number_rows(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with dense row ids from 0 in the given order.

    Rows are range-partitioned and numbered within partitions; only the number of
    rows of each partition goes to the driver.  The placed rows are written to the
    shared folder, so that both passes see the same ones, ties and lost executors
    included; rows of equal order get their ids in any order.
    """
    own = F.struct("*").alias("_row")
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).select(own, F.monotonically_increasing_id().alias("_at"))
    placed = durable(placed.select("_row", F.shiftright("_at", 33).cast("int").alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_at")))
    starts, at = [], 0
    for r in sorted(placed.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        starts.append((r["_part"], at))
        at += r["n"]
    first = df.sparkSession.createDataFrame(starts, "_part int, _first long")
    return placed.join(first, "_part").select((F.col("_at") + F.col("_first")).alias(ROW_ID), "_row.*")


def synthetic_trades(spark: SparkSession, n: int, instruments: int = 10, currencies: int = 5, seed: int = 42) -> DataFrame:
    """Trades with an instrument, a currency, a price and a quantity in [0, 1)."""
    return spark.range(n).select(
        F.col("id").alias(ROW_ID),
        F.concat(F.lit("instrument"), F.floor(F.rand(seed) * instruments).cast("string")).alias("instrument"),
        F.concat(F.lit("ccy"), F.floor(F.rand(seed + 1) * currencies).cast("string")).alias("ccy"),
        F.rand(seed + 2).alias("price"),
        F.rand(seed + 3).alias("qty"),
    )


def synthetic_rows(spark: SparkSession, blocks: int, runny: float = 0.33, dirty: float = 0.33, seed: int = 42) -> DataFrame:
    """Row ids of a set whose blocks are long runs, dense or sparse by the given shares."""
    kind = F.rand(seed)
    keys = spark.range(blocks).select("id", F.when(kind < runny, "run").when(kind < runny + dirty, "dense").otherwise("sparse").alias("kind"))
    rows = keys.select("id", "kind", F.explode(F.sequence(F.lit(0), F.lit(65_535))).alias("low"))
    share = F.when(F.col("kind") == "dense", 0.5).otherwise(0.02)
    kept = F.when(F.col("kind") == "run", F.floor(F.col("low") / 4096) % 2 == 0).otherwise(F.rand(seed + 1) < share)
    return rows.where(kept).select((F.shiftleft("id", 16) + F.col("low")).alias(ROW_ID))
