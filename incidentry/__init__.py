"""incidentry — operations-log analytics on Spark.

Batch: ``sources`` (read logs, rules, stores) → ``operators`` (normalise, tag, filter, events, incidents, counts,
logins, upserts, products) → ``plans`` (composed jobs and reports). Streams: ``streaming`` (the same operators on
streaming DataFrames, state processors, topic-chained queries). Fixed values shared with the application live in
``constants``.
"""
