"""Streaming ingestion gives the same events as the batch route."""

import os

from behaviorlens.operators import activity
from behaviorlens.sources import fixtures
from behaviorlens.streaming.ingest import ingest_events


def test_stream_matches_batch(spark, tmpdir_path):
    events = fixtures.table(spark, "/root/testdata/sf0.001", "events")
    tables = fixtures.role_tables_from_events(events)
    dirs = {}
    for name, df in tables.items():
        d = os.path.join(tmpdir_path, "in", name)
        df.write.parquet(d)
        dirs[name] = d
    sink = os.path.join(tmpdir_path, "events")
    q = ingest_events(spark, dirs, sink, os.path.join(tmpdir_path, "ckpt"), fmt="parquet")
    q.awaitTermination(120)
    streamed = spark.read.parquet(sink)
    batch = activity.build_timeline(tables)
    assert streamed.count() == batch.count() == events.count()
    assert streamed.exceptAll(batch).count() == 0
