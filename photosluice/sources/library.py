"""Scoped sources over a table of assets; all reach the scan as pushed filters."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_day(value: date | datetime | str) -> date:
    """A day from a date, a point in time or ISO text."""
    if isinstance(value, datetime):
        return value.date()
    if isinstance(value, date):
        return value
    return date.fromisoformat(value)


def _moment(d: date) -> datetime:
    return datetime(d.year, d.month, d.day, tzinfo=UTC)


def between(assets: DataFrame, start: date, stop: date) -> DataFrame:
    """Assets captured in [start 00:00, stop 00:00) UTC; those without a time never match."""
    t = F.col("captured_at")
    return assets.where((t >= F.lit(_moment(start))) & (t < F.lit(_moment(stop))))


def library(assets: DataFrame) -> DataFrame:
    """All assets with a time in 1970..2100."""
    return between(assets, date(1970, 1, 1), date(2101, 1, 1))


def by_year(assets: DataFrame, year: int) -> DataFrame:
    return between(assets, date(year, 1, 1), date(year + 1, 1, 1))


def date_range(assets: DataFrame, first: date | str, last: date | str) -> DataFrame:
    """Assets of the days ``first`` to ``last``, both included."""
    return between(assets, as_day(first), as_day(last) + timedelta(days=1))


def recent_window(run_date: date | str, days=None, weeks=None, months=None) -> tuple[date, date]:
    """[start, stop) of exactly one of days, weeks or months (30 days each) up to the run date."""
    given = [(n, x) for n, x in (("days", days), ("weeks", weeks), ("months", months)) if x is not None]
    if len(given) != 1:
        raise ValueError("recent needs exactly one of days, weeks, months")
    unit, n = given[0]
    if n <= 0:
        raise ValueError(f"{unit} must be positive")
    day = as_day(run_date)
    return day - timedelta(days=n * {"days": 1, "weeks": 7, "months": 30}[unit]), day + timedelta(days=1)


def recent(assets: DataFrame, run_date: date | str, **window) -> DataFrame:
    return between(assets, *recent_window(run_date, **window))


def album(assets: DataFrame, members: DataFrame, album_id: str) -> DataFrame:
    """Assets that ``members`` (``album_id``, ``asset_id``) puts in the album."""
    return assets.join(members.where(F.col("album_id") == album_id).select("asset_id"), "asset_id", "left_semi")


def build_source(assets: DataFrame, type: str, run_date=None, members: DataFrame | None = None, **p) -> DataFrame:
    """The source of the given type; ValueError on unknown types and missing parameters."""

    def need(*names):
        missing = [n for n in names if p.get(n) in (None, "")]
        if missing:
            raise ValueError(f"source {type} needs {', '.join(missing)}")

    if type == "library":
        return library(assets)
    if type == "year":
        need("year")
        return by_year(assets, int(p["year"]))
    if type == "date_range":
        need("from", "to")
        return date_range(assets, p["from"], p["to"])
    if type == "recent":
        if run_date is None:
            raise ValueError("source recent needs run_date")
        return recent(assets, run_date, **{k: p.get(k) for k in ("days", "weeks", "months")})
    if type == "album":
        need("album_id")
        if members is None:
            raise ValueError("source album needs a table of album members")
        return album(assets, members, p["album_id"])
    raise ValueError(f"unknown source type {type!r}")
