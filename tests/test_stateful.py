"""Streams with state against plain Python, for several ways to deal rows to micro-batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratalens.plans.stateful_queries import _store
from stratalens.streaming import stateful as S

START = datetime(2024, 3, 1)
LIFE, DELAY = timedelta(minutes=30), timedelta(minutes=20)


def _requests(seed, n=120, projects=4):
    rng = random.Random(seed)
    return [(rng.randrange(projects), k, START + timedelta(seconds=rng.randrange(6 * 3600))) for k in range(n)]


def _plain(rows, sure):
    out, made = set(), {}
    for project, request, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        if ts <= sure:
            hit = project in made and ts < made[project] + LIFE
            if not hit:
                made[project] = ts
            out.add((project, request, ts, hit, made[project]))
    return out


@pytest.mark.parametrize("parts", [1, 4])
def test_detections_by_event_time(spark, tmp_path, parts):
    rows = _requests(7)
    rows.sort(key=lambda r: r[2] + timedelta(seconds=hash((r[1], 5)) % 1000))  # out of order, within the delay
    size = -(-len(rows) // parts)
    schema = "project long, request long, ts timestamp_ntz"
    folder = S.land([spark.createDataFrame(rows[k : k + size], schema) for k in range(0, len(rows), size)], str(tmp_path / "landed"))
    with _store(spark):
        found, late = S.run_append(S.detections(S.landed(spark, folder, schema), LIFE, "20 minutes"))
    got = {(r.project, r.request, r.ts, r.hit, r.made) for r in found.collect()}
    assert got == _plain(rows, max(r[2] for r in rows) - DELAY) and late == 0
    assert {r[3] for r in got} == {True, False}


def test_matched_within_an_interval(spark, tmp_path):
    """Repeated deliveries count once, late ones (behind the watermark of the batch before the last) are counted, requests without a
    review come out when none can follow."""
    at = lambda m: START + timedelta(minutes=m)
    schema = "event_id long, user_id long, ts timestamp_ntz"
    asked = [[(1, 1, at(0)), (2, 2, at(5)), (1, 1, at(0))], [(3, 1, at(60)), (4, 3, at(200))], [(6, 4, at(400))], [(5, 9, at(1)), (7, 5, at(500))]]
    given = [[(11, 1, at(10))], [(12, 1, at(65)), (12, 1, at(65)), (13, 2, at(90))], [(14, 4, at(405))], [(15, 3, at(2)), (16, 5, at(505))]]
    frames = []
    for name, parts in (("asked", asked), ("given", given)):
        folder = S.land([spark.createDataFrame(p, schema) for p in parts], str(tmp_path / name))
        frames.append(S.landed(spark, folder, schema).withColumn("ts", F.col("ts").cast("timestamp")))
    found, late = S.run_append(S.matched(*frames, "user_id", "30 MINUTES", "20 minutes", "leftOuter"))
    got = {(r.user_id, r.request, r.review) for r in found.collect()}
    assert {(1, 1, 11), (1, 3, 12), (4, 6, 14), (5, 7, 16), (2, 2, None), (3, 4, None)} == got
    assert late == 2
