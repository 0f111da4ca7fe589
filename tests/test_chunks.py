"""Chunks of long histories: as many as the driver can plan, with the epochs of one fold."""

import random
from datetime import datetime, timedelta

from infratrace.operators import epochs


def test_chunks_are_bounded(spark):
    rng = random.Random(2)
    rows = [("i", datetime(2026, 1, 1) + timedelta(minutes=k), datetime(2026, 1, 1), f"o{k:04d}", [f"c{rng.randint(0, 3)}"]) for k in range(1200)]
    df = spark.createDataFrame(rows, "indicator_id string, effective_at timestamp, collected_at timestamp, observation_id string, ids array<string>")
    assert epochs._chunks(df, 1).select("chunk").distinct().count() <= epochs.MOST_CHUNKS * 32  # 1,200 before
    told = [{r["observation_id"]: r["epoch"] for r in x.collect()} for x in (epochs.assign_epochs(df, 0, 1), epochs.assign_epochs(df))]
    assert told[0] == told[1]
