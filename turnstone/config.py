"""Settings of a run, from defaults, a profile and a TOML file."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Config:
    target_language: str = "auto"
    min_words: int = 20
    min_characters: int = 100
    max_repetition: float = 0.35
    max_abnormal: float = 0.05
    words_per_paragraph: int = 150
    words_per_chunk: int = 100
    frame_interval_seconds: float = 10.0
    speech_model: str = "base"
    speech_provider: str = "fixed"
    frame_provider: str = "none"
    resume: bool = True
    force: bool = False


# The profiles' model and seconds between frames.
PROFILES = {"fast": ("tiny", 15.0), "balanced": ("base", 10.0), "high-quality": ("medium", 5.0)}


def load(path: str | Path | None = None, profile: str | None = None, **overrides) -> Config:
    """Profile first, then the file's ``[turnstone]`` table (or its top level), then ``overrides``; unknown keys are errors."""
    config = Config()
    if profile is not None:
        model, interval = PROFILES[profile]
        config = replace(config, speech_model=model, frame_interval_seconds=interval)
    if path is not None:
        data = tomllib.loads(Path(path).read_text())
        overrides = {**data.get("turnstone", data.get("tool", {}).get("turnstone", data)), **overrides}
    kinds = {f.name: type(f.default) for f in fields(Config)}
    if unknown := sorted(set(overrides) - set(kinds)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return replace(config, **{k: _as(kinds[k], v, k) for k, v in overrides.items()})


def _as(kind: type, value: object, key: str) -> object:
    """A setting in its kind; switches may be written as words."""
    if kind is bool and not isinstance(value, bool):
        word = str(value).strip().lower()
        if word not in ("true", "false", "yes", "no", "on", "off", "1", "0"):
            raise ValueError(f"{key} is a switch, not {value!r}")
        return word in ("true", "yes", "on", "1")
    return kind(value)
