"""Incremental ingestion of activity files with Structured Streaming.

The analysis itself has no streaming semantics (no watermark, window or
late-data rule): it is a batch study over complete timelines.  What can run
continuously is the stateless first step, turning newly arriving role-table
files into normalised events, so that batch runs read a ready event table.
Exactly-once output comes from the file sink plus its checkpoint folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.activity import role_events
from ..schema import ACTIVITY_RAW, ROLES
from ..sources.files import typed_activity


def activity_stream(spark: SparkSession, role_dirs: dict[str, str], fmt: str = "csv") -> DataFrame:
    """Union of the role-table streams as normalised events."""
    parts = []
    for name, _, act, _ in ROLES:
        if name not in role_dirs:
            continue
        if fmt == "csv":
            # text columns whose names must agree with each file's header
            text = T.StructType([T.StructField(c, T.StringType()) for c in ACTIVITY_RAW.fieldNames()])
            reader = spark.readStream.schema(text).option("enforceSchema", False)
            src = typed_activity(reader.option("header", True).option("multiLine", True).option("escape", '"').csv(role_dirs[name]))
        else:
            src = spark.readStream.schema(ACTIVITY_RAW).parquet(role_dirs[name])
        parts.append(role_events(src, act))
    if not parts:
        raise ValueError("no role directories given")
    return reduce(DataFrame.unionByName, parts)


def ingest_events(
    spark: SparkSession, role_dirs: dict[str, str], sink_path: str, checkpoint: str, fmt: str = "csv", once: bool = True
) -> StreamingQuery:
    """Append new events to a Parquet table; ``once`` processes what is there
    and stops (scheduled runs), otherwise it keeps running."""
    writer = (
        activity_stream(spark, role_dirs, fmt)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")
    return writer.start(sink_path)
