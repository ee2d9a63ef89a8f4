"""One event of each user and week of the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.plans import catalog
from tidewater.sources.tables import table


def test_one_event_of_every_user_and_week(spark, sf):
    found = catalog.queries()["stream_first_of_week"](spark, sf).select("event_id", "user_id", F.col("week").cast("date").alias("week")).collect()
    rows = table(spark, sf, "events").select("event_id", "user_id", F.date_trunc("week", "ts").cast("date").alias("week")).collect()
    assert len({(r["user_id"], r["week"]) for r in found}) == len(found)
    assert {(r["user_id"], r["week"]) for r in found} == {(r["user_id"], r["week"]) for r in rows}
    assert {tuple(r) for r in found} <= {tuple(r) for r in rows}
