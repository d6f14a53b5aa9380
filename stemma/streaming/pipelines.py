"""Incremental ingest, stateful pairing and event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from stemma.operators import dag
from stemma.plans.storage import lean_writes
from stemma.sources import rawlog, schemas


def stream_stanzas(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of log stanzas (value, f, b) from files that appear in ``folder``, with their file and block."""
    stanza = spark.readStream.text(folder, lineSep=rawlog.END)
    return stanza.select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))


def batch_records(stanzas: DataFrame, number: int) -> DataFrame:
    """Records of one micro-batch; their numbers follow those of all earlier batches."""
    numbered = rawlog.number_stanzas(stanzas.withColumn("i", F.monotonically_increasing_id()))
    return rawlog.parse_stanzas(numbered.withColumn("seq", F.col("seq") + F.lit(number * (1 << 40))))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append the edges of new log files to ``out/edges`` and their records to ``out/records``; what is there is not read again.

    A batch that runs again replaces its own rows, so each record is ingested once.
    """

    def batch(stanzas: DataFrame, number: int) -> None:
        with lean_writes(stanzas.sparkSession), lean_writes(spark):
            batch_records(stanzas, number).write.mode("overwrite").parquet(f"{out}/records/batch={number}")
            kept = spark.read.schema(schemas.RECORD).parquet(f"{out}/records/batch={number}")
            dag.edges(kept).write.mode("overwrite").parquet(f"{out}/edges/batch={number}")

    return stream_stanzas(spark, folder).writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()


def pair_stream(events: DataFrame, before: str, after: str, *, keep_ms: int = 3_600_000) -> DataFrame:
    """(key, before_order, after_order) over a stream of (key, order, kind): ``dag.paired_once`` with state that expires.

    The state of a key is its last ``before`` row, until the next row under
    the key takes it or no row comes for ``keep_ms``.
    """

    def pair(key, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        out, held = [], state.get[0] if state.exists else None
        found = pd.concat(list(rows)).sort_values("order")
        for order, kind in zip(found["order"], found["kind"], strict=True):
            if kind == before:
                held = int(order)
            else:
                if held is not None:
                    out.append((key[0], held, int(order)))
                held = None
        if held is None:
            if state.exists:
                state.remove()
        else:
            state.update((held,))
            state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame(out, columns=["key", "before_order", "after_order"]).astype("int64")

    own = events.filter(F.col("kind").isin(before, after)).groupBy("key")
    return own.applyInPandasWithState(pair, "key long, before_order long, after_order long", "held long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def pair_micro_batches(events: DataFrame, before: str, after: str, out: str, checkpoint: str) -> StreamingQuery:
    """The same pairing with its open rows in a table under ``out/open``, for stores without state support."""
    spark = events.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        kept = f"{out}/open/batch={number - 1}"
        seen = rows.select("key", "order", "kind")
        if number:
            seen = seen.unionByName(spark.read.schema("key long, order long, kind string").parquet(kept))
        seen.persist()
        dag.paired_once(seen, ["key"], "order", "kind", before, after).write.mode("overwrite").parquet(f"{out}/pairs/batch={number}")
        last = seen.groupBy("key").agg(F.max(F.struct("order", "kind")).alias("m")).select("key", "m.order", "m.kind")
        last.filter(F.col("kind") == before).write.mode("overwrite").parquet(f"{out}/open/batch={number}")
        seen.unpersist()

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()


def event_windows(events: DataFrame, *, late: str = "10 minutes", size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """(start, event_type, n) in tumbling or sliding windows of event time; a plain timestamp column is cast, as watermarks need it."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return timed.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events without a longer gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
