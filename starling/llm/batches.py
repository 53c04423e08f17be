"""How many rows go to a Python worker at a time, and intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starling.session import run_folder

#: Spark's own 10,000 are too many for whole texts.
BATCH_ROWS = 1000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's batches of rows for Python workers to what whole texts allow; a lower setting stays."""
    if int(spark.conf.get(ARROW_ROWS)) > BATCH_ROWS:
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))


def stored(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: packed, read by columns, and what is shuffled from
    it twice alike is shuffled once."""
    folder = run_folder(df.sparkSession, kind)
    df.write.parquet(f"{folder}/rows")
    return df.sparkSession.read.parquet(f"{folder}/rows")
