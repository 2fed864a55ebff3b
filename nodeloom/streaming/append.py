"""Entities that arrive as JSON lines, appended to a saved graph or sent to an index as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nodeloom.operators.graph import RELATIONS


def entity_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """id, name, object, relations of every line of every file that appears in the folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder).filter(F.trim("value") != "")
    v = F.parse_json("value")
    get = lambda k, kind: F.try_variant_get(v, f"$.{k}", kind)
    return lines.select(get("id", "string").alias("id"), get("name", "string").alias("name"), get("object", "variant").alias("object"), F.coalesce(get("relations", RELATIONS), F.array().cast(RELATIONS)).alias("relations"))


def append_to(stream: DataFrame, saved: str, checkpoint: str, hook: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Each micro-batch joins the saved graph's entities exactly once: a batch that runs again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        rows = hook(batch).withColumns({"object": F.to_json("object"), "batch": F.lit(number)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "name").parquet(f"{saved}/arrived")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrived(spark: SparkSession, saved: str) -> DataFrame:
    rows = spark.read.parquet(f"{saved}/arrived")
    return rows.select("id", "name", F.parse_json("object").alias("object"), "relations")
