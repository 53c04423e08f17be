"""Scoring of orders as they arrive. Nothing is kept between rows, so no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from starling.plans.risk_model import RiskModel, with_freight_share


def score_stream(model: RiskModel, orders: DataFrame, out: str, progress: str) -> StreamingQuery:
    """Scores what has arrived and appends it to Parquet files; ``progress`` remembers what was read."""
    return (model.score(with_freight_share(orders)).writeStream.format("parquet")
            .option("path", out).option("checkpointLocation", progress)
            .trigger(availableNow=True).start())
