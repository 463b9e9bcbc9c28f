"""Backlog of streams as a table.

:class:`ProgressTable` is a listener that appends every trigger's progress to a table. From it :func:`offsets` gives one row
per trigger, source and partition, and :func:`backlog` how far each trigger left the partition behind, how fast it
drained, and how long the rest takes at that rate. The table outlives the query and the driver: reports read it, the stream
is not asked.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

PROGRESS = "query_id string, run_id string, trigger long, progress string"

#: Of a progress report, what the reports need. Offsets are JSON whose shape depends on the source.
_REPORT = ("name string, timestamp string, batchDuration long, numInputRows long, "
           "sources array<struct<description string, startOffset string, endOffset string, latestOffset string, "
           "numInputRows long>>")


class ProgressTable(StreamingQueryListener):
    """Appends (query_id, run_id, trigger, progress as JSON) to ``path``, one small file a trigger. A trigger that runs
    again after a restart has a new ``run_id``; :func:`offsets` takes the last report of each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._ended: dict[str, threading.Event] = {}

    def _end_of(self, run_id: str) -> threading.Event:
        return self._ended.setdefault(run_id, threading.Event())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        (self.spark.createDataFrame([(str(p.id), str(p.runId), p.batchId, p.json)], PROGRESS).coalesce(1)
         .write.mode("append").parquet(self.path))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end_of(str(event.runId)).set()

    def wait_for(self, query: StreamingQuery, seconds: float = 60) -> bool:
        """After the end of ``query``: until its last progress is written (reports arrive behind the query)."""
        return self._end_of(str(query.runId)).wait(seconds)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROGRESS).parquet(path)


def offsets(progress: DataFrame) -> DataFrame:
    """One row per (query_id, trigger, source, topic, partition): start_offset, end_offset, latest_offset (longs), the
    trigger's time, duration_ms and input_rows.

    A source that numbers the partitions of topics, ``{"topic": {"0": 17}}``, gives a row for each; one that numbers its
    log, ``{"logOffset": 3}`` or ``3``, gives one row with that name (or null) as the partition and a null topic. Offsets
    that a source does not report are null (the start of a first trigger; the latest of files). Sources without
    any numbers give no row."""
    last = progress.groupBy("query_id", "trigger").agg(F.max_by("progress", F.get_json_object("progress", "$.timestamp"))
                                                       .alias("progress"))
    report = F.from_json("progress", _REPORT)
    src = last.select("query_id", "trigger", report.alias("r")).select(
        "query_id", "trigger", F.col("r.name").alias("query"), F.to_timestamp("r.timestamp").alias("at"),
        F.col("r.batchDuration").alias("duration_ms"), F.posexplode("r.sources").alias("source", "s"))
    flat = src.select("*", *[_flat(F.col(f"s.{n}Offset")).alias(n) for n in ("start", "end", "latest")])
    places = flat.withColumn("place", F.explode(F.map_keys("end")))

    def at_place(name):
        return F.try_element_at(F.col(name), F.col("place")).alias(f"{name}_offset")
    return places.select("query_id", "query", "trigger", "source", F.col("s.description").alias("description"),
                         F.col("place.topic").alias("topic"), F.col("place.part").alias("partition"), at_place("start"),
                         at_place("end"), at_place("latest"), "at", "duration_ms",
                         F.col("s.numInputRows").alias("input_rows"))


def _flat(text):
    """Offset JSON as a map from struct(topic, part) to the number."""
    place = "struct<topic string, part string>"

    def numbers(topic, found):
        entries = F.map_entries(F.from_json(found, "map<string,string>"))
        listed = F.transform(entries, lambda e: F.struct(
            F.struct(topic.alias("topic"), e["key"].alias("part")).cast(place).alias("key"),
            e["value"].try_cast("long").alias("value")))
        return F.filter(listed, lambda e: e["value"].isNotNull())

    none = F.lit(None).cast("string")
    plain = F.when(text.try_cast("long").isNotNull(), F.array(F.struct(
        F.struct(none.alias("topic"), none.alias("part")).cast(place).alias("key"), text.try_cast("long").alias("value"))))
    objects = F.map_entries(F.from_json(text, "map<string,string>"))
    nested = F.flatten(F.transform(F.filter(objects, lambda e: e["value"].startswith("{")),
                                   lambda e: numbers(e["key"], e["value"])))
    return F.map_from_entries(F.coalesce(plain, F.concat(numbers(none, text), nested)))


def backlog(offsets: DataFrame) -> DataFrame:
    """:func:`offsets` with lag, drained, drain_rate (offsets a second) and seconds_left.

    The lag is what lay behind ``end_offset`` at that trigger: up to the latest offset the source reported or, for sources
    that report none, up to the last offset that the table holds of the partition (the lag of a finished replay).
    ``drained`` counts from the trigger's start, or from the end of the trigger before where the source gives no start;
    it is null for a first trigger without either. The window is per partition of a source: its rows are its triggers."""
    part = Window.partitionBy("query_id", "source", "topic", "partition")
    latest = F.coalesce(F.col("latest_offset"), F.max("end_offset").over(part))
    start = F.coalesce(F.col("start_offset"), F.lag("end_offset").over(part.orderBy("trigger")))
    rate = F.col("drained") * 1000.0 / F.nullif(F.col("duration_ms"), F.lit(0))
    return (offsets.withColumn("lag", latest - F.col("end_offset")).withColumn("drained", F.col("end_offset") - start)
            .withColumn("drain_rate", rate)
            .withColumn("seconds_left", F.when(F.col("lag") == 0, F.lit(0.0))
                        .when(F.col("drain_rate") > 0, F.col("lag") / F.col("drain_rate"))))


def backlog_by_window(backlog: DataFrame, window: str = "1 minute") -> DataFrame:
    """Per query, source and window of time: triggers, rows in, offsets drained and their rate, and the lag at the end."""
    per_trigger = backlog.groupBy("query_id", "query", "source", "trigger").agg(
        F.max("at").alias("at"), F.max("duration_ms").alias("duration_ms"), F.max("input_rows").alias("input_rows"),
        F.sum("lag").alias("lag"), F.sum("drained").alias("drained"))
    return per_trigger.groupBy("query_id", "query", "source", F.window("at", window).alias("w")).agg(
        F.count(F.lit(1)).alias("triggers"), F.sum("input_rows").alias("input_rows"), F.sum("drained").alias("drained"),
        (F.sum("drained") * 1000.0 / F.nullif(F.sum("duration_ms"), F.lit(0))).alias("drain_rate"),
        F.max_by("lag", "trigger").alias("lag")).select("query_id", "query", "source", F.col("w.start").alias("window_start"),
                                                        "triggers", "input_rows", "drained", "drain_rate", "lag")
