"""Helpers of the tests, apart from fixtures: test modules import nothing from a conftest."""

from __future__ import annotations

from datetime import datetime, timezone


def at(day: str, clock: str = "12:00:00") -> int:
    return int(datetime.strptime(f"{day} {clock}", "%Y-%m-%d %H:%M:%S").replace(tzinfo=timezone.utc).timestamp())


def table(df, *columns) -> list[tuple]:
    return in_order(tuple(r) for r in df.select(*columns).collect())


def in_order(rows) -> list[tuple]:
    return sorted(rows, key=lambda row: [str(v) for v in row])
