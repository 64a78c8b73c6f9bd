"""Streaming: JSON files into an index in micro-batches, and windowed counts over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from larkspur.plans.mapping import Mapping
from larkspur.sources.ingest import append, typed


def read_json(spark: SparkSession, path: str, mapping: Mapping, files_per_batch: int = 100) -> DataFrame:
    """A stream of NDJSON files; lines that can't be read keep their text in ``_bad``."""
    fields = [T.StructField(n, T.StringType()) for n in mapping.properties] + [T.StructField("_bad", T.StringType())]
    return spark.readStream.schema(T.StructType(fields)).option("columnNameOfCorruptRecord", "_bad").option("maxFilesPerTrigger", files_per_batch).json(path)


def start(stream: DataFrame, mapping: Mapping, path: str, checkpoint: str, dead: str | None = None, every: str | None = None) -> StreamingQuery:
    """Appends each micro-batch to an index: ids and times are filled in, of one id the last row stays, unreadable
    lines go to ``dead``. Without ``every`` what is there is drained once."""

    def batch(df: DataFrame, number: int) -> None:
        df.persist()
        if dead is not None:
            df.where(F.col("_bad").isNotNull()).select("_bad").write.mode("append").text(dead)
        good = df.where(F.col("_bad").isNull()).drop("_bad")
        source = F.to_json(F.struct(*[c for c in good.columns if c != "_id"]))
        good = good.withColumns({"_source": source, "_id": F.coalesce("_id", F.expr("uuid()")), "@timestamp": F.coalesce("`@timestamp`", F.current_timestamp().cast("string")), "_at": F.monotonically_increasing_id()})
        last = good.groupBy("_id").agg(F.max_by(F.struct(*[f"`{c}`" for c in good.columns if c != "_id"]), "_at").alias("r")).select("_id", "r.*").drop("_at")
        append(typed(last, mapping), path)
        df.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def windowed_counts(stream: DataFrame, time: str, keys: list[str], size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window and keys; rows later than ``late`` behind the latest are dropped."""
    window = F.window(F.col(f"`{time}`"), size, slide) if slide else F.window(F.col(f"`{time}`"), size)
    return stream.withWatermark(time, late).groupBy(window.alias("window"), *keys).agg(F.count("*").alias("doc_count"))


def session_counts(stream: DataFrame, time: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Counts by session of a key, closed after ``gap`` without a row."""
    return stream.withWatermark(time, late).groupBy(F.session_window(F.col(f"`{time}`"), gap).alias("session"), key).agg(F.count("*").alias("doc_count"))
