"""Settings from a TOML file: unknown, missing and mistyped keys are errors."""

from __future__ import annotations

import os
import tomllib
from dataclasses import MISSING, dataclass, fields
from pathlib import Path
from typing import Any, get_type_hints

VARIABLE = "FOLIOFLOW_CONFIG"
DEFAULT = Path("folioflow.toml")


class ConfigError(ValueError):
    """A setting that can't be used."""


@dataclass(frozen=True)
class HttpEngine:
    """A hosted engine behind HTTP; ``style`` is the shape of its requests: openai, deepgram or elevenlabs."""

    url: str
    style: str = "openai"
    voice: str = "default"
    model: str = ""
    concurrency: int = 4
    max_chars: int = 1000
    sample_rate: int = 24_000
    timeout_s: float = 120.0
    key_variable: str = ""


@dataclass(frozen=True)
class BatchEngine:
    """A local server that speaks many texts at once. With a ``command`` it is started where none answers ``health_url``.

    ``frame_rate`` above 0 sends a cap of new tokens; ``context_tokens`` above 0 bounds a text by what fits the model beside the
    ``voice_tokens`` of its voice. Takes that miss their duration are spoken again up to ``retries`` times."""

    url: str
    command: str = ""
    health_url: str = ""
    frame_rate: float = 0.0
    context_tokens: int = 0
    voice_tokens: int = 0
    retries: int = 2
    max_batch: int = 64
    max_chars: int = 300
    seed: int = 0
    sample_rate: int = 24_000
    timeout_s: float = 180.0


@dataclass(frozen=True)
class Settings:
    cache: str = "cache"
    output: str = "out"
    engines: dict[str, HttpEngine | BatchEngine] | None = None


def config_path(given: str | None, environment: dict[str, str] | None = None) -> tuple[Path, bool]:
    """The file to read and whether someone asked for it: the argument, else the variable, else the default."""
    environment = os.environ if environment is None else environment
    named = given or environment.get(VARIABLE)
    return (Path(named), True) if named else (DEFAULT, False)


def _typed(where: str, value: Any, want: type) -> Any:
    if want is float and type(value) is int:
        return float(value)
    if type(value) is not want:  # a bool is no number here
        raise ConfigError(f"{where} must be {want.__name__}, not {type(value).__name__}")
    return value


def _built(where: str, raw: Any, kind: type) -> Any:
    if not isinstance(raw, dict):
        raise ConfigError(f"{where} must be a table")
    hints = get_type_hints(kind)
    known = {f.name: f for f in fields(kind)}
    if unknown := sorted(set(raw) - set(known)):
        raise ConfigError(f"{where}: unknown {', '.join(unknown)}")
    if missing := [n for n, f in known.items() if n not in raw and f.default is MISSING]:
        raise ConfigError(f"{where}: missing {', '.join(missing)}")
    return kind(**{n: _typed(f"{where}.{n}", v, hints[n]) for n, v in raw.items()})


def load(given: str | None = None, environment: dict[str, str] | None = None) -> Settings:
    """Settings; all defaults where no file is asked for and the default one isn't there."""
    path, asked = config_path(given, environment)
    if not path.exists():
        if asked:
            raise ConfigError(f"no such file: {path}")
        return Settings(engines={})
    try:
        raw = tomllib.loads(path.read_text(encoding="utf-8"))
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"{path}: {e}") from e
    if unknown := sorted(set(raw) - {"cache", "output", "engines"}):
        raise ConfigError(f"unknown {', '.join(unknown)}")
    engines = {}
    for name, table in raw.get("engines", {}).items():
        kind = BatchEngine if isinstance(table, dict) and "max_batch" in table else HttpEngine
        engines[name] = _built(f"engines.{name}", table, kind)
    return Settings(_typed("cache", raw.get("cache", "cache"), str), _typed("output", raw.get("output", "out"), str), engines)
