"""Change detection between snapshots, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot(files: DataFrame) -> DataFrame:
    """path, md5 of files (path, content or text)."""
    return files.select("path", F.md5("content" if "content" in files.columns else "text").alias("md5"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, state (added, changed, deleted) by one full join of two snapshots."""
    joined = old.select("path", F.col("md5").alias("was")).join(new.select("path", F.col("md5").alias("is")), "path", "full")
    state = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(F.col("was") != F.col("is"), "changed")
    return joined.select("path", state.alias("state")).where("state is not null")


def updated(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old snapshot with the new one's paths put in place."""
    return old.join(new.select("path"), "path", "left_anti").unionByName(new)


def follow(files: DataFrame, apply, checkpoint: str):
    """A streaming query that hands every batch of arriving files to ``apply(batch, number)`` exactly once."""
    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """window start, event_type, n, total: tumbling counts; over a stream with a watermark, over a table without."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    return rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n: runs of a user's events without a longer pause."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
