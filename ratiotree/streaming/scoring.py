"""Scores for streams. A model is an expression over each row, so no state and no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.boost import Boosted, predict_boosted
from ..operators.tree import Tree, predict_tree


def score_stream(rows: DataFrame, model: Tree | Boosted, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write the scored rows of a stream to parquet; ``once``: what is there now, then end."""
    scored = predict_boosted(rows, model) if isinstance(model, Boosted) else predict_tree(rows, model)
    out = scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()
