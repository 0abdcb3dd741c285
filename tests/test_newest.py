"""Numbering by time: places equal those of one window, and no window holds all rows."""

import datetime

from sonoplan.operators import reads
from sonoplan.plans import queries


def test_places(spark):
    day = [None if k % 50 == 7 else datetime.date(2020, 1, 1 + (k * k) % (3 if k < 200 else 1)) for k in range(400)]
    df = spark.createDataFrame([(k, d) for k, d in enumerate(day)], "playlist_id bigint, created_at date").repartition(7)
    got = {r["playlist_id"]: r["place"] for r in reads.newest_numbered(df, "playlist_id", "place").collect()}
    want = sorted(range(400), key=lambda k: (day[k] or datetime.date(1, 1, 1), k), reverse=True)
    assert got == {k: place for place, k in enumerate(want, 1)}
    assert reads.newest_numbered(df.limit(0), "playlist_id", "place").count() == 0


def test_query_has_no_single_partition(spark):
    plan = queries.QUERIES["newest_playlists"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
