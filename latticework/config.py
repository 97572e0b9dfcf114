"""Settings from TOML, with defaults; unknown keys are an error."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path


@dataclass
class Resolution:
    min_confidence: float = 0.3
    import_depth: int = 3
    signature_ceiling: int = 500


@dataclass
class Querying:
    max_depth: int = 5
    top_k: int = 10
    cache_entries: int = 256
    cache_seconds: float = 300.0


@dataclass
class Watching:
    debounce_ms: int = 100
    suppress_seconds: int = 5
    max_file_bytes: int = 1 << 20


@dataclass
class Editing:
    max_files: int = 100
    max_edits: int = 500
    allow: list[str] = field(default_factory=lambda: ["*"])
    deny: list[str] = field(default_factory=list)


@dataclass
class Config:
    resolution: Resolution = field(default_factory=Resolution)
    querying: Querying = field(default_factory=Querying)
    watching: Watching = field(default_factory=Watching)
    editing: Editing = field(default_factory=Editing)
    ignore: list[str] = field(default_factory=list)


def _fill(target, values: dict, at: str = "") -> None:
    known = {f.name for f in fields(target)}
    for k, v in values.items():
        if k not in known:
            raise ValueError(f"unknown setting {at}{k}")
        now = getattr(target, k)
        if is_dataclass(now):
            _fill(now, v, f"{at}{k}.")
        elif type(v) is not type(now) and not (isinstance(now, float) and type(v) is int):
            raise ValueError(f"{at}{k} is a {type(now).__name__}")
        else:
            setattr(target, k, type(now)(v))


def load(path: str | None = None) -> Config:
    """The defaults, changed by a file if there is one."""
    out = Config()
    if path and Path(path).exists():
        _fill(out, tomllib.loads(Path(path).read_text()))
    return out
