"""Measure how the largest task grows with a hot key: naive per-key plans vs the plans of this library.

One key gets every third row of ``events`` (a third of the data). Each variant runs under its own job group; the
Spark event log (written into the scratch folder, no UI) gives the records read by every task, and the report lists
the largest shuffle read of a single task per variant. The chunked operators run with a small ``target_rows`` so the
ratio of chunk size to table size is what a 100 TB table would see with the default target.

usage: python scripts/skew_report.py [sf_dir] > SKEW.md
"""

from __future__ import annotations

import glob
import json
import os
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from incidentry.operators.bruteforce import brute_force_incidents  # noqa: E402
from incidentry.operators.incidents import instant_and_accumulated  # noqa: E402
from incidentry.operators.scan import segmented_running_sum  # noqa: E402
from incidentry.operators.upsert import latest_per_key  # noqa: E402
from incidentry.session import build_session  # noqa: E402
from incidentry.sources.tables import read_table  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = f"/tmp/checkpoints/incidentry/eventlog/{uuid.uuid4().hex}"
    os.makedirs(log_dir, exist_ok=True)
    spark = build_session("local[8]", shuffle_partitions=32, app="skew-report",
                          extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                 "spark.eventLog.compress": "false",
                                 "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    sc = spark.sparkContext
    ev = read_table(spark, sf_dir, "events").withColumn(
        "k", F.when(F.col("event_id") % 3 == 0, F.lit("hot")).otherwise(F.col("user_id").cast("string")))
    n = ev.count()
    err = (F.col("event_type") == "error").cast("int")
    events = ev.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"),
                       F.col("ts").alias("timestamp"), "k",
                       F.when(F.col("event_type") == "error", "high").otherwise("medium").alias("severity"),
                       F.lit("d").alias("description"))
    failed = ev.where(F.col("event_type") == "error").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.col("ts").alias("timestamp"),
        F.lit("login_failed").alias("type"), F.create_map(F.lit("ip"), F.col("k")).alias("metadata"))

    w = Window.partitionBy("k").orderBy("ts", "event_id")
    variants = {
        "running count: naive Window.partitionBy(key)":
            lambda: ev.select("event_id", F.sum(err).over(w.rowsBetween(Window.unboundedPreceding, 0))),
        "running count: chunked scan, hot keys only (operators/scan.py)":
            lambda: segmented_running_sum(ev, "k", ["ts", "event_id"], err, "o", ranges=64),
        "accumulated incidents: naive row_number over key":
            lambda: events.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("timestamp", "id")))
            .where((F.col("severity") == "high") | (F.col("rn") >= 3)),
        "accumulated incidents: group-limited window + id join (T2)":
            lambda: instant_and_accumulated(events, key="k", threshold=3),
        "latest per key: naive row_number = 1":
            lambda: ev.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(F.col("ts").desc())))
            .where("rn = 1"),
        "latest per key: max_by partial aggregate (T5)":
            lambda: latest_per_key(ev.select("k", "ts", "event_id"), "k", ["ts", "event_id"]),
        "brute force: chunked multi-state fold (T3)":
            lambda: brute_force_incidents(failed, 86400, 3)[0],
    }
    for name, build in variants.items():
        sc.setJobGroup(name, name)
        build().write.format("noop").mode("overwrite").save()
    sc.setJobGroup("done", "done")
    spark.stop()

    stage_group, task_reads, task_inputs = {}, {}, {}
    for path in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if os.path.isdir(path) or os.path.basename(path).startswith("appstatus"):
            continue
        with open(path) as fh:
            for line in fh:
                e = json.loads(line)
                kind = e.get("Event")
                if kind == "SparkListenerJobStart":
                    grp = (e.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in e.get("Stage IDs", []):
                        stage_group[sid] = grp
                elif kind == "SparkListenerTaskEnd":
                    m = e.get("Task Metrics") or {}
                    sid = e["Stage ID"]
                    r = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                    i = (m.get("Input Metrics") or {}).get("Records Read", 0)
                    task_reads.setdefault(sid, []).append(r)
                    task_inputs.setdefault(sid, []).append(i)
    by_group = {}
    for sid, reads in task_reads.items():
        grp = stage_group.get(sid)
        if grp in variants:
            cur = by_group.setdefault(grp, [0, 0])
            cur[0] = max(cur[0], max(reads))
            cur[1] += sum(reads)
    print(f"# Largest task with a hot key ({sf_dir}, {n} rows, one key = 1/3 of the rows)\n")
    print("Largest shuffle read of one task, and all shuffle reads of the variant, from the Spark event log "
          "(32 shuffle partitions, no partition coalescing).\n")
    print("| variant | largest task (records) | all shuffle reads (records) |")
    print("|---|---|---|")
    for name in variants:
        mx, tot = by_group.get(name, [0, 0])
        print(f"| {name} | {mx} | {tot} |")


if __name__ == "__main__":
    main()
