"""Pure functions of the control plane: cron expressions and template variables."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

_RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
_VARIABLE = re.compile(r"\{([A-Za-z_][A-Za-z0-9_]*)\}")


def _field(text: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for item in text.split(","):
        body, _, step = item.partition("/")
        by = int(step) if step else 1
        if by < 1:
            raise ValueError(f"step must be positive in {item!r}")
        if body == "*":
            first, last = low, high
        elif "-" in body:
            first, last = map(int, body.split("-", 1))
        else:
            first = int(body)
            last = high if by > 1 else first
        if not low <= first <= last <= high:
            raise ValueError(f"{item!r} is outside {low}-{high}")
        out.update(range(first, last + 1, by))
    return out


def parse_cron(expression: str) -> tuple[set[int], set[int], set[int], set[int], set[int], bool, bool]:
    """Minutes, hours, days, months, weekdays (0 = Sunday) and whether days and weekdays are restricted."""
    fields = expression.split()
    if len(fields) != 5:
        raise ValueError("a cron expression has five fields")
    minute, hour, day, month, week = (_field(f, *r) for f, r in zip(fields, _RANGES))
    return minute, hour, day, month, {d % 7 for d in week}, fields[2] != "*", fields[4] != "*"


def next_run(expression: str, after: datetime) -> datetime | None:
    """First minute after ``after`` (UTC) that the expression names, None if there is none in 8 years.

    Where both days and weekdays are restricted, either suffices.
    """
    minutes, hours, days, months, weekdays, by_day, by_week = parse_cron(expression)
    now = after.astimezone(UTC) if after.tzinfo else after.replace(tzinfo=UTC)
    t = now.replace(second=0, microsecond=0) + timedelta(minutes=1)
    end = t + timedelta(days=8 * 366)
    while t < end:
        week = (t.weekday() + 1) % 7
        fits = {(False, False): True, (True, False): t.day in days, (False, True): week in weekdays}.get((by_day, by_week), t.day in days or week in weekdays)
        if t.month not in months or not fits:
            t = t.replace(hour=0, minute=0) + timedelta(days=1)
        elif t.hour not in hours:
            t = t.replace(minute=0) + timedelta(hours=1)
        elif t.minute not in minutes:
            t += timedelta(minutes=1)
        else:
            return t
    return None


def fill_template(value, variables: dict):
    """``value`` with every ``{NAME}`` in its texts replaced; unknown names stay."""
    if isinstance(value, str):
        return _VARIABLE.sub(lambda m: str(variables.get(m[1], m[0])), value)
    if isinstance(value, dict):
        return {k: fill_template(v, variables) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return type(value)(fill_template(v, variables) for v in value)
    return value


def undefined_variables(value, variables: dict) -> list[str]:
    """Names in ``value`` that have no value, sorted."""
    if isinstance(value, str):
        return sorted({n for n in _VARIABLE.findall(value) if n not in variables})
    parts = value.values() if isinstance(value, dict) else value if isinstance(value, list | tuple) else ()
    return sorted({n for p in parts for n in undefined_variables(p, variables)})
