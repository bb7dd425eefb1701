"""Configuration files and progress reports of runs."""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any, TextIO

from photosluice.functions.control import fill_template, undefined_variables
from photosluice.plans.spec import Step, override, parse_pipeline, validate
from photosluice.plans.stages import PIPELINES
from photosluice.sources.library import as_day

PREFIX = "@@PROGRESS@@"


def load_config(path: str | None, default: str = "config.json") -> dict:
    """Settings from JSON, or YAML by its suffix. No file at the default place is no settings; a
    given path must exist; an empty file is no settings; anything but an object is an error."""
    p = Path(path or default)
    if not p.exists():
        if path:
            raise FileNotFoundError(path)
        return {}
    text = p.read_text()
    if p.suffix in (".yaml", ".yml"):
        import yaml

        found = yaml.safe_load(text)
    else:
        found = json.loads(text) if text.strip() else None
    if found is None:
        return {}
    if not isinstance(found, Mapping):
        raise ValueError(f"{p} must hold an object")
    return dict(found)


def pipeline_of(config: Mapping) -> tuple[Step, ...]:
    """Checked steps of a configuration: ``pipeline`` (a name or steps), ``pipeline_settings`` by
    alias, ``variables`` for templates and ``run_date``."""
    variables = dict(config.get("variables") or {})
    raw = config.get("pipeline")
    if raw is None:
        raise ValueError("the configuration has no pipeline")
    raw = PIPELINES[raw][1] if isinstance(raw, str) and raw in PIPELINES else raw
    raw = json.loads(raw) if isinstance(raw, str) else raw
    settings = config.get("pipeline_settings") or {}
    missing = undefined_variables([raw, settings], variables)
    if missing:
        raise ValueError(f"undefined variables: {', '.join(missing)}")
    steps = override(parse_pipeline(fill_template(raw, variables)), fill_template(settings, variables))
    run_date = config.get("run_date")
    return validate(steps, {"run_date": as_day(run_date)} if run_date else None)


class NoProgress:
    """Reports nothing."""

    def begin(self, stage: str, total: int | None = None) -> None: ...

    def advance(self, completed: int) -> None: ...

    def end(self, **counts: Any) -> None: ...


class JsonProgress(NoProgress):
    """Progress as lines of JSON behind a prefix, at most once a second or every 2 % of a stage."""

    def __init__(self, out: TextIO | None = None, clock: Callable[[], float] = time.monotonic):
        self.out, self.clock = out or sys.stdout, clock
        self.stage, self.total, self.last_time, self.last_done = "", None, float("-inf"), 0

    def _say(self, **what: Any) -> None:
        print(PREFIX + json.dumps(what), file=self.out, flush=True)

    def begin(self, stage: str, total: int | None = None) -> None:
        self.stage, self.total, self.last_time, self.last_done = stage, total, float("-inf"), 0
        self._say(type="begin", stage=stage, total=total)

    def advance(self, completed: int) -> None:
        now = self.clock()
        step = self.total and completed - self.last_done >= 0.02 * self.total
        if now - self.last_time >= 1 or step or completed == self.total:
            self.last_time, self.last_done = now, completed
            self._say(type="advance", stage=self.stage, completed=completed, total=self.total)

    def end(self, **counts: Any) -> None:
        self._say(type="end", stage=self.stage, **counts)


def read_progress(line: str) -> dict | None:
    """What a progress line says; null for any other line."""
    if not line.startswith(PREFIX):
        return None
    try:
        found = json.loads(line[len(PREFIX) :])
    except ValueError:
        return None
    return found if isinstance(found, dict) else None
