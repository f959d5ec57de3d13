"""A folder of mesh tables as a stream: time series of summaries over snapshots as they arrive.

Snapshots that a simulation writes as Parquet cells (level, i, j, k, fields, with the columns it and time) are read as a
stream; each micro-batch is aggregated by snapshot, and late files of a known snapshot are added to it while the
watermark allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_cells(spark: SparkSession, folder: str, schema: StructType | str, files_a_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def summaries(cells: DataFrame, fields: tuple[str, ...], volume: float, delay: str = "10 minutes") -> DataFrame:
    """(window, it, n_cells, <field>_total): volume-weighted sums of each snapshot.

    cells needs `written` (TIMESTAMP, the event time), `it` and `level`; volume is that of a level-1 cell, and a cell of
    level L has 8^(L-1) times less. State is one row a snapshot and window, dropped once the watermark passes it.
    """
    own = F.lit(volume) / F.pow(F.lit(8.0), F.col("level") - 1)
    sums = [F.sum(F.col(f) * own).alias(f"{f}_total") for f in fields]
    return (
        cells.withWatermark("written", delay)
        .groupBy(F.window("written", "1 hour"), "it")
        .agg(F.count(F.lit(1)).alias("n_cells"), *sums)
    )
