"""Budgets with reservations: outcomes by hand, and the same over a restart as in one run."""

import pytest

from tessera.sources.tablelog import Table
from tessera.streaming import reservations
from tessera.streaming.reservations import DAY, Limits

SCHEMA = "account string, at long, seq long, kind string, request long, tokens long"
HOUR = 3_600_000_000
LIMITS = Limits(daily=100, per_query=60, hold_seconds=3600)
FIRST = [
    ("a", 0, 1, "reserve", 1, 50),
    ("a", 1, 2, "reserve", 2, 61),  # more than one query may ask
    ("a", 2, 3, "reserve", 3, 60),  # 50 are reserved
    ("a", 3, 4, "settle", 1, 30),
    ("a", 4, 5, "reserve", 5, 60),  # 30 used and 60 reserved
    ("a", 5, 6, "settle", 99, 5),  # never reserved
    ("b", 0, 7, "reserve", 7, -1),
    ("b", 1, 8, "reserve", 8, None),
]
SECOND = [
    ("a", 4 + HOUR, 9, "reserve", 9, 50),  # the reservation of 5 has just run out
    ("a", 5 + HOUR, 10, "settle", 5, 60),  # too late
    ("a", DAY, 11, "reserve", 11, 40),  # a new day; 9 has run out
    ("a", DAY + 1, 12, "settle", 11, 45),
    ("a", DAY + 2, 13, "reserve", 13, 55),
    ("a", DAY + 3, 14, "reserve", 14, 1),
]
WANT = {
    1: ("granted", 0, 50), 2: ("per_query", 0, 50), 3: ("daily", 0, 50), 4: ("settled", 30, 0), 5: ("granted", 30, 60), 6: ("unknown", 30, 60), 7: ("per_query", 0, 0), 8: ("granted", 0, 0),
    9: ("granted", 30, 50), 10: ("unknown", 30, 50), 11: ("granted", 0, 40), 12: ("settled", 45, 0), 13: ("granted", 45, 55), 14: ("daily", 45, 55),
}


@pytest.mark.parametrize("parts", [[FIRST + SECOND], [FIRST, SECOND], [FIRST[:3], FIRST[3:], SECOND[:2], SECOND[2:]]])
def test_outcomes(spark, tmp_path, parts):
    table = Table(spark, str(tmp_path / "t"), "seq", 2)
    for i, rows in enumerate(parts):
        rows = [(a, 20_000 * DAY + at, *rest) for a, at, *rest in rows]
        # each run ends and the next one goes on from the checkpoint
        spark.createDataFrame(rows[::-1], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        reservations.record(stream, LIMITS, table, "q", str(tmp_path / "point")).awaitTermination()
        assert table.read().count() == sum(map(len, parts[: i + 1]))
    assert {r.seq: (r.outcome, r.used, r.reserved) for r in table.read().collect()} == WANT
