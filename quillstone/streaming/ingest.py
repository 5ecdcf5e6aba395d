"""Chunk files as they arrive, and jobs as their events come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import files, store

#: Order of the states of a job: a later one is never replaced by an earlier one.
STATES = ["queued", "running", "done", "failed", "cancelled"]


def ingest_chunks(spark: SparkSession, incoming: str, path: str, checkpoint: str, schema: str, by: str = "src", key: str = "cid") -> StreamingQuery:
    """Take all files that have come in since the last run, and end. The checkpoint holds which ones have been taken.

    A batch's sources are merged with what is there of them: of rows of one key the new one stays. A batch that is taken
    again after a failure gives the same rows, so it does no harm.
    """

    def take(batch: DataFrame, number: int) -> None:
        session, new = batch.sparkSession, batch.dropDuplicates([key])
        if store.exists(session, path):
            there = session.read.parquet(path).join(new.select(by).distinct(), by, "left_semi").join(new.select(key), key, "left_anti")
            new = new.unionByName(there.select(*new.columns))
        # a folder can't be read and replaced at once
        staged = store.scratch(session, "batch")
        new.write.parquet(staged)
        files.ingest(session.read.parquet(staged), path, by)

    stream = spark.readStream.schema(schema).json(incoming)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_states(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """job, state, at: the furthest state of each job of a stream of events (job, state, ts), an hour's jobs at a time; what comes later than late is left out.

    A job that was cancelled stays so whatever is said of it afterwards.
    """
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    hour = F.window("ts", "1 hour")
    seen = events.withWatermark("ts", late).groupBy(hour, "job").agg(F.max(F.struct(rank.alias("rank"), "ts", "state")).alias("m"))
    return seen.select("job", F.col("m.state").alias("state"), F.col("m.ts").alias("at"))
