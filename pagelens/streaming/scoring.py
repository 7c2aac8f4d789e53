"""Continuous scoring: pages arrive as rows or files, are read, turned into features and scored, without state between batches.

Bin edges and models are fixed before the stream starts, so a page gets the same result at any time
and in any batch; re-delivered pages within the watermark are dropped by key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagelens.operators.boosting import Model, score
from pagelens.plans.features import page_features
from pagelens.runtime import discard, durable
from pagelens.sources import page_json


def deduplicated(stream: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """A stream with each key once within the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Rows per tumbling window of event time and group; rows later than ``delay`` are left out once their window is done."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def score_batches(
    stream: DataFrame, models: dict[str, Model], edges: dict[str, Sequence[float]] | None, write: Callable[[DataFrame, int], None], checkpoint: str, key: str = "page_no", **trigger
) -> StreamingQuery:
    """Start scoring; ``write`` gets each batch's scored features and its number."""

    def each(batch: DataFrame, number: int) -> None:
        # Features are computed once, however many models and writers read them.
        made = durable(page_features(page_json.pages(batch, key), None, edges, key), "batch")
        out = made
        for target, model in models.items():
            out = score(out, model, f"pred_{target}")
        write(out, number)
        discard(made)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
