"""Topics as folders of JSON lines: published by batches, read as a stream or as a bounded history.

Events are read at least once and in no given order; a reader that keeps a checkpoint goes on
where it ended, and one without starts with what is there. Handlers are functions of a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

SCHEMA = "topic string, key string, at timestamp, payload string"


def publish(events: DataFrame, folder: str, topic: str, key: str, at: str = "at") -> None:
    """Append rows to a topic; the payload is the row as JSON."""
    rows = events.select(F.lit(topic).alias("topic"), F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"), F.to_json(F.struct(*events.columns)).alias("payload"))
    rows.write.mode("append").partitionBy("topic").json(folder)


def subscribe(spark: SparkSession, folder: str, topic: str, payload: str | StructType | None = None, files: int = 16) -> DataFrame:
    """The stream of a topic, at most ``files`` files a batch; payload: its schema, then the fields stand beside the key."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).json(folder).where(F.col("topic") == topic)
    return rows if payload is None else rows.select("topic", "key", F.col("at").alias("published"), F.from_json("payload", payload).alias("p")).select("topic", "key", "published", "p.*")


def history(spark: SparkSession, folder: str, topic: str, most: int = 500) -> DataFrame:
    """The newest events of a topic; the limit is the feature."""
    return spark.read.schema(SCHEMA).json(folder).where(F.col("topic") == topic).orderBy(F.desc("at"), "key", "payload").limit(most)


def handled(stream: DataFrame, handlers: dict[str, Callable[[DataFrame], None]], checkpoint: str) -> StreamingQuery:
    """Each batch given to the handlers by topic until the stream is used up. A handler that fails stops the query, so
    its batch comes again: a handler must bear events twice."""

    def each(batch: DataFrame, _: int) -> None:
        for topic, handle in handlers.items():
            own = batch.where(F.col("topic") == topic)
            if not own.isEmpty():
                handle(own)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
