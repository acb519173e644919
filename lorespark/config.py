"""Settings: defaults, then a YAML file, then the environment, each checked against the default's type."""

from __future__ import annotations

import dataclasses
import json
import logging
import os
from dataclasses import dataclass, field


# The defaults of all settings below.


@dataclass
class Chunking:
    max_tokens: int = 256
    min_tokens: int = 60
    overlap_tokens: int = 40
    safety_tokens: int = 4


@dataclass
class Search:
    limit: int = 20
    semantic_top_k: int = 30
    snippet_tokens: int = 32
    chunks_per_document: int = 2
    max_subqueries: int = 4
    min_coverage: float = 0.5
    rerank: bool = False
    rerank_top_n: int = 20


@dataclass
class Indexing:
    exclude: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    max_file_bytes: int = 64 << 20
    debounce_ms: int = 2000
    reconcile_seconds: int = 900
    stall_seconds: int = 120


@dataclass
class Settings:
    chunking: Chunking = field(default_factory=Chunking)
    search: Search = field(default_factory=Search)
    indexing: Indexing = field(default_factory=Indexing)


def coerce(value: object, like: object, name: str) -> object:
    """value as the type of a default; a text that can't be read so is an error that names the setting."""
    if isinstance(like, bool):
        if isinstance(value, bool):
            return value
        if str(value).lower() in ("1", "true", "yes", "on", "0", "false", "no", "off"):
            return str(value).lower() in ("1", "true", "yes", "on")
    elif isinstance(like, list):
        if isinstance(value, list):
            return [str(x) for x in value]
        return [x.strip() for x in str(value).split(",") if x.strip()]
    else:
        try:
            return type(like)(value)
        except (TypeError, ValueError):
            pass
    raise ValueError(f"{name}: {value!r} is no {type(like).__name__}")


def _merge(target: object, values: dict, path: str) -> None:
    for k, v in values.items():
        name = f"{path}.{k}" if path else k
        if k not in {f.name for f in dataclasses.fields(target)}:
            raise ValueError(f"{name}: no such setting")
        now = getattr(target, k)
        if dataclasses.is_dataclass(now):
            if not isinstance(v, dict):
                raise ValueError(f"{name}: a group of settings is wanted")
            _merge(now, v, name)
        else:
            setattr(target, k, coerce(v, now, name))


def load(path: str | None = None, environ: dict[str, str] | None = None) -> Settings:
    """Settings; the variable LORESPARK_SEARCH__LIMIT sets search.limit."""
    s = Settings()
    if path:
        import yaml

        with open(path, encoding="utf-8") as f:
            _merge(s, yaml.safe_load(f) or {}, "")
    for k, v in (os.environ if environ is None else environ).items():
        if k.startswith("LORESPARK_") and "__" in k:
            group, name = k.removeprefix("LORESPARK_").lower().split("__", 1)
            _merge(s, {group: {name: v}}, "")
    return s


def get(settings: Settings, path: str) -> object:
    """A setting by its dotted path."""
    out: object = settings
    for p in path.split("."):
        out = getattr(out, p)
    return out


def put(settings: Settings, path: str, value: object) -> None:
    """Sets a setting by its dotted path, as the kind of value that it is."""
    values: object = value
    for p in reversed(path.split(".")):
        values = {p: values}
    _merge(settings, values, "")


class JsonLines(logging.Formatter):
    """One compact JSON object an event, with credentials in URLs removed."""

    def format(self, record: logging.LogRecord) -> str:
        import re

        message = re.sub(r"([a-zA-Z][a-zA-Z0-9+.\-]*://)[^\s/@]+@", r"\1", record.getMessage())
        return json.dumps({"time": round(record.created, 3), "level": record.levelname.lower(), "logger": record.name, "message": message} | getattr(record, "fields", {}), separators=(",", ":"), ensure_ascii=False)
