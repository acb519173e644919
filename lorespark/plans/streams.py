"""Event queries: the events table, ordered by time, as the requests and signs of life of its users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import corpus, shared
from ..streaming import events as op
from ._base import query


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "events")


@query("x1_debounce", """WITH e AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts = lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS THEN 1 ELSE 0 END AS s FROM events),
 g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM e) SELECT user_id, min(ts) AS "first", max(ts) AS "last", count(*) AS events FROM g GROUP BY user_id, b""")
def x1_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.debounce(_events(spark, sf_dir), "user_id", "ts", "6 hours")


@query("x1_debounce_stream", """WITH e AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS s FROM events),
 g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM e) SELECT user_id, min(ts) AS "first", max(ts) AS "last", count(*) AS events FROM g GROUP BY user_id, b""")
def x1_debounce_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read as a stream of files, every burst as it stands once all input is in."""
    e = _events(spark, sf_dir)
    stream = spark.readStream.schema(e.schema).parquet(f"{sf_dir}/events.parq*").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "100000 days")
    folder = shared.folder(spark, "bursts")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/bursts")

    op.debounce(stream, "user_id", "ts", "6 hours").writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(f"{folder}/bursts").select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "events")


@query("x6_reconcile", "SELECT time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '1970-01-01') AS start, count(DISTINCT user_id) AS sources, count(*) AS events FROM events GROUP BY 1")
def x6_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.reconcile(_events(spark, sf_dir), "ts", "12 hours")


@query("x7_stalls", "SELECT user_id, since, ts AS until, round(epoch(ts) - epoch(since), 3)::DOUBLE AS silence FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS since FROM events) WHERE round(epoch(ts) - epoch(since), 3) >= 86400")
def x7_stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.stalls(_events(spark, sf_dir), "user_id", "ts", 86400)


@query("x4_coalesce_requests")
def x4_coalesce_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.coalesce(_events(spark, sf_dir), "user_id", "ts", "event_type", 8 * 3600 * 1000, 3)


@query("x9_due_retries", "SELECT event_id AS id, ts + INTERVAL 2 SECOND AS next_attempt_at FROM events WHERE event_type = 'error' AND ts + INTERVAL 2 SECOND <= TIMESTAMP '2024-01-05'")
def x9_due_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "retry").otherwise("done").alias("status"), (F.col("ts") + F.expr("interval 2 seconds")).alias("next_attempt_at"))
    return op.due(j, F.lit("2024-01-05").cast("timestamp_ntz")).select("id", "next_attempt_at")


@query("x11_progress", "SELECT user_id, count(*) FILTER (event_type <> 'error') AS done, count(*) FILTER (event_type = 'error') AS failed, max(ts) AS \"last\", max_by(event_type, (ts, event_id)) AS phase FROM events GROUP BY user_id")
def x11_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.progress(_events(spark, sf_dir), "user_id")
