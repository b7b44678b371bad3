"""Reminders over whole sessions against a plain fold; sessions cross midnight and some have no commit."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tracelode.operators import steps


def _fold(items: list[tuple], most: int, seconds: int) -> list[tuple]:
    fired, state = [], {}
    for session, at, _, commit in sorted(items):
        n, first = state.get(session, (0, at))
        if n and (at - first).total_seconds() >= seconds:
            fired.append((session, at, n))
            n = 0
        n, first = n + 1, (at if n == 0 else first)
        if n >= most or commit:
            fired.append((session, at, n))
            n = 0
        state[session] = n, first
    return sorted(fired)


def _due(spark, items):
    rows = spark.createDataFrame(items, "session_id long, at timestamp_ntz, id long, is_commit boolean").repartition(3)
    return sorted((r["session_id"], r["fired_at"], r["n_items"]) for r in steps.due_points(rows, 10, 1800, F.col("is_commit")).collect())


def test_reminders_over_midnight(spark):
    night = datetime(2024, 5, 1, 23, 50)
    ten = [(1, night + timedelta(seconds=75 * i), i, False) for i in range(10)]  # the ninth and tenth stand after midnight
    slow = [(2, night, 20, False), (2, night + timedelta(minutes=35), 21, False)]
    daily = [(3, night + timedelta(days=i), 30 + i, False) for i in range(3)]
    assert _due(spark, ten + slow + daily) == [(1, ten[-1][1], 10), (2, slow[1][1], 1), (3, daily[1][1], 1), (3, daily[2][1], 1)]
    draw, items = random.Random(7), []
    for session in range(6):
        at = night
        for i in range(120):
            at += timedelta(seconds=draw.choice([0, 20, 90, 400, 2500, 30_000]))
            items.append((session, at, 1000 * session + i, session > 1 and draw.random() < 0.05))
    assert _due(spark, items) == _fold(items, 10, 1800)
