"""Our own addition: inputs that arrive over time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirespark.sources.cabinet import INPUT_NAMES


def incremental(spark: SparkSession, path: str, state: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Hands over inputs that have come since the last call, once each; `state` keeps what was seen."""
    rows = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", INPUT_NAMES).schema("path string, modificationTime timestamp, length long, content binary").load(path)
    rows.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(handle).start().awaitTermination()
