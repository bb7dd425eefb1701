"""Pipelines as data: steps, aliases, overrides, validation before anything runs.

A step is written as a stage name, ``[name, config]``, ``[name, config, alias]``, an object with
``stage``, ``config`` and ``alias``, or a :class:`Step`. Forks hold pipelines in ``branches``: an
object by name, pairs, objects with ``name`` and ``pipeline``, or bare pipelines.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import date
from typing import Any

from photosluice.sources.library import as_day

FORKS = ("fork", "fork.by_selection")


@dataclass(frozen=True)
class ConfigParam:
    """A declared setting of a stage."""

    key: str
    type: type
    default: Any = None
    required: bool = False
    description: str = ""
    min: float | None = None
    max: float | None = None
    choices: tuple | None = None

    def checked(self, value: Any, stage: str) -> Any:
        where = f"{stage}.{self.key}"
        if value is None:
            if self.required:
                raise ValueError(f"{where} is required")
            return None
        try:
            value = self._coerced(value)
        except (TypeError, ValueError) as e:
            raise ValueError(f"{where} must be {self.type.__name__}, not {value!r}") from e
        if self.choices and value not in self.choices:
            raise ValueError(f"{where} must be one of {', '.join(map(str, self.choices))}")
        if self.min is not None and value < self.min:
            raise ValueError(f"{where} must be at least {self.min}")
        if self.max is not None and value > self.max:
            raise ValueError(f"{where} must be at most {self.max}")
        return value

    def _coerced(self, value: Any) -> Any:
        if self.type is bool:
            if isinstance(value, bool):
                return value
            return {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}[str(value).strip().lower()] if str(value).strip().lower() in ("true", "1", "yes", "false", "0", "no") else _refuse(value)
        if self.type is int:
            if isinstance(value, bool) or (isinstance(value, float) and not value.is_integer()):
                _refuse(value)
            return int(value)
        if self.type is float:
            return _refuse(value) if isinstance(value, bool) else float(value)
        if self.type is date:
            return as_day(value)
        if self.type is str:
            return value if isinstance(value, str) else _refuse(value)
        if self.type in (list, tuple):
            return list(value) if isinstance(value, list | tuple) else _refuse(value)
        return value


def _refuse(value: Any) -> Any:
    raise ValueError(value)


@dataclass(frozen=True)
class StageDef:
    """A registered stage: ``run(df, env, **config)`` gives the next frame."""

    name: str
    run: Callable
    params: tuple[ConfigParam, ...] = ()
    description: str = ""
    children: tuple = ()  # of a composite: (stage, config, alias)

    def param(self, key: str) -> ConfigParam | None:
        return next((p for p in self.params if p.key == key), None)


_stages: dict[str, StageDef] = {}


def stage(name: str, *params: ConfigParam, description: str = ""):
    """Register a function as a stage; a name can be given once."""

    def register(fn: Callable) -> Callable:
        _add(StageDef(name, fn, params, description or (fn.__doc__ or "").strip()))
        return fn

    return register


def _add(d: StageDef) -> None:
    if d.name in _stages:
        raise ValueError(f"stage {d.name!r} is already registered")
    _stages[d.name] = d


def alias_stage(name: str, of: str) -> None:
    _add(replace(get_stage(of), name=name))


def composite(name: str, *children: tuple[str, dict, str], description: str = "") -> None:
    """Register a stage made of others.

    A child's setting is reached by its own key if no other child has it, else as ``alias.key``.
    """
    routes = _routes(children)
    params = tuple(replace(p, key=key, default=config.get(p.key, p.default), required=p.required and p.key not in config) for key, (_, p, config) in routes.items())

    def run(df, env, **config):
        given: dict[str, dict] = {alias: dict(c) for _, c, alias in children}
        for key, value in config.items():
            alias, p, _ = routes[key]
            given[alias][p.key] = value
        for child, _, alias in children:
            df = run_stage(df, env, child, given[alias])
        return df

    _add(StageDef(name, run, params, description, tuple(children)))


def _routes(children) -> dict[str, tuple[str, ConfigParam, dict]]:
    seen: dict[str, int] = {}
    for child, _, _ in children:
        for p in get_stage(child).params:
            seen[p.key] = seen.get(p.key, 0) + 1
    return {(p.key if seen[p.key] == 1 else f"{alias}.{p.key}"): (alias, p, config) for child, config, alias in children for p in get_stage(child).params}


def list_stages() -> list[str]:
    return sorted(_stages)


def has_stage(name: str) -> bool:
    return name in _stages


def get_stage(name: str) -> StageDef:
    if name not in _stages:
        raise KeyError(f"unknown stage {name!r}")
    return _stages[name]


@dataclass(frozen=True)
class Step:
    """One step: stage, settings and alias; forks have ``branches`` of steps."""

    stage: str
    config: dict = field(default_factory=dict)
    alias: str | None = None
    branches: tuple[tuple[str, tuple[Step, ...]], ...] = ()


def parse_step(raw: Any) -> Step:
    """A step from any of its written forms."""
    if isinstance(raw, Step):
        return raw
    if isinstance(raw, str):
        name, config, alias = raw, {}, None
    elif isinstance(raw, Mapping):
        if "stage" not in raw:
            raise ValueError(f"a step needs a stage: {raw!r}")
        name, config, alias = raw["stage"], raw.get("config"), raw.get("alias")
    elif isinstance(raw, Sequence) and 1 <= len(raw) <= 3:
        name, config, alias = [*raw, None, None][:3]
    else:
        raise ValueError(f"not a step: {raw!r}")
    if not isinstance(name, str):
        raise ValueError(f"a stage is named by text: {name!r}")
    if config is None:
        config = {}
    if not isinstance(config, Mapping):
        raise ValueError(f"settings of {name} must be an object")
    config = dict(config)
    branches: tuple = ()
    if name in FORKS:
        branches = parse_branches(config.pop("branches", None), name)
    return Step(name, config, alias, branches)


def parse_branches(raw: Any, name: str = "fork") -> tuple[tuple[str, tuple[Step, ...]], ...]:
    if isinstance(raw, Mapping):
        pairs = list(raw.items())
    elif isinstance(raw, Sequence) and not isinstance(raw, str):
        pairs = []
        for i, b in enumerate(raw):
            if isinstance(b, Mapping):
                pairs.append((b.get("name", f"branch_{i}"), b.get("pipeline")))
            elif isinstance(b, Sequence) and not isinstance(b, str) and len(b) == 2 and isinstance(b[0], str) and isinstance(b[1], Sequence) and not isinstance(b[1], str):
                pairs.append((b[0], b[1]))
            else:
                pairs.append((f"branch_{i}", b))
    else:
        pairs = []
    if not pairs:
        raise ValueError(f"{name} needs branches")
    out = []
    for branch, pipeline in pairs:
        if not isinstance(branch, str) or not branch:
            raise ValueError(f"a branch of {name} needs a name")
        if branch in [b for b, _ in out]:
            raise ValueError(f"{name} has two branches named {branch!r}")
        out.append((branch, parse_pipeline(pipeline)))
    return tuple(out)


def parse_pipeline(raw: Any) -> tuple[Step, ...]:
    """Steps of a written pipeline, each with an alias that is unique in it."""
    if isinstance(raw, str):
        raw = json.loads(raw)
    if not isinstance(raw, Sequence):
        raise ValueError("a pipeline is a list of steps")
    steps = [parse_step(s) for s in raw if s is not None]
    taken = {s.alias for s in steps if s.alias}
    if len(taken) < sum(1 for s in steps if s.alias):
        raise ValueError("an alias is given twice")
    out = []
    for s in steps:
        name = s.alias
        if not name:
            base = name = s.stage.rpartition(".")[2]
            n = 2
            while name in taken:
                name, n = f"{base}_{n}", n + 1
            taken.add(name)
        out.append(replace(s, alias=name))
    return tuple(out)


def override(pipeline: tuple[Step, ...], settings: Mapping[str, Mapping]) -> tuple[Step, ...]:
    """``pipeline`` with settings by alias, or by path ``<alias>.branches.<branch>.<alias>`` into forks.

    Branches may also be given nested, as an object of objects. Unknown aliases and branches raise.
    """
    for key, values in settings.items():
        pipeline = _override(pipeline, key.split("."), values, key)
    return pipeline


def _override(pipeline, path, values, key):
    at = next((i for i, s in enumerate(pipeline) if s.alias == path[0]), None)
    rest = path[1:]
    if at is None:
        # aliases may hold dots themselves
        at = next((i for i, s in enumerate(pipeline) if key.endswith(s.alias) and ".".join(path) == s.alias), None)
        rest = []
        if at is None:
            raise KeyError(f"unknown alias {path[0]!r} in {key!r}")
    s = pipeline[at]
    if rest:
        if rest[0] == "branches":
            rest = rest[1:]
        branch = next((b for b, _ in s.branches if rest and ".".join(rest).startswith(b)), None)
        if branch is None:
            raise KeyError(f"unknown branch in {key!r}")
        inner = ".".join(rest)[len(branch) :].lstrip(".")
        if not inner:
            raise KeyError(f"{key!r} names a branch, not a step")
        s = _in_branch(s, branch, {inner: values})
    else:
        if not isinstance(values, Mapping):
            raise ValueError(f"settings of {key!r} must be an object")
        values = dict(values)
        for branch, inner in (values.pop("branches", None) or {}).items() if s.branches else ():
            s = _in_branch(s, branch, inner)
        s = replace(s, config=s.config | values)
    return (*pipeline[:at], s, *pipeline[at + 1 :])


def _in_branch(s: Step, branch: str, settings: Mapping) -> Step:
    if branch not in [b for b, _ in s.branches]:
        raise KeyError(f"unknown branch {branch!r}")
    return replace(s, branches=tuple((b, override(p, settings) if b == branch else p) for b, p in s.branches))


def checked_config(name: str, config: Mapping) -> dict:
    """A stage's settings, coerced and checked, with defaults filled in."""
    d = get_stage(name)
    unknown = [k for k in config if d.param(k) is None]
    if unknown:
        raise ValueError(f"{name} has no setting {', '.join(map(repr, unknown))}")
    out = {}
    for p in d.params:
        out[p.key] = p.checked(config[p.key] if config.get(p.key) is not None else p.default, name)
    return out


def validate(pipeline: tuple[Step, ...], defaults: Mapping | None = None) -> tuple[Step, ...]:
    """``pipeline`` with all settings checked, forks included; errors show before anything runs.

    ``defaults`` (such as a run date) fill settings of that name which a step leaves out.
    """
    out = []
    for s in pipeline:
        d = get_stage(s.stage)
        given = {k: v for k, v in (defaults or {}).items() if d.param(k) and s.config.get(k) is None}
        out.append(replace(s, config=checked_config(s.stage, given | s.config), branches=tuple((b, validate(p, defaults)) for b, p in s.branches)))
    return tuple(out)


def run_stage(df, env, name: str, config: Mapping):
    return get_stage(name).run(df, env, **checked_config(name, config))


def run_steps(df, env, pipeline: tuple[Step, ...]):
    """The frame after all steps; forks run their branches on what reaches them."""
    from photosluice.operators.flow import fork, fork_by_selection

    for s in pipeline:
        if s.branches:
            run = {b: (lambda frame, p=p: run_steps(frame, env, p)) for b, p in s.branches}
            df = fork(df, run) if s.stage == "fork" else fork_by_selection(df, run)
        else:
            df = get_stage(s.stage).run(df, env, **s.config)
        watch = getattr(env, "observations", None)
        if watch is not None:
            df = _observed(df, s, watch)
    return df


def _observed(df, s: Step, watch: list):
    """``df`` that counts its records by the way when it is computed; nothing runs for it."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation()
    watch.append((s.alias, s.stage, seen))
    return df.observe(seen, F.count("*").alias("records"))


def describe(pipeline: tuple[Step, ...]) -> list[dict]:
    """Steps, settings and their declared types, ready for JSON."""
    out = []
    for s in pipeline:
        d = get_stage(s.stage)
        params = [
            {"key": p.key, "type": p.type.__name__, "default": p.default, "required": p.required, "description": p.description, "min": p.min, "max": p.max, "choices": list(p.choices) if p.choices else None}
            for p in d.params
        ]
        item = {"stage": s.stage, "alias": s.alias, "description": d.description, "config": s.config, "params": params}
        if s.branches:
            item["branches"] = {b: describe(p) for b, p in s.branches}
        if d.children:
            item["children"] = [{"stage": c, "alias": a} for c, _, a in d.children]
        out.append(item)
    return out
