"""Settings: a dataclass, read from JSON without ever writing to it."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path

from varak.sources.files import ExtractionOptions


@dataclass(frozen=True)
class Logging:
    level: str = "INFO"
    name: str = "varak"


@dataclass(frozen=True)
class Config:
    output_dir: str = "output"
    lexicon_dir: str | None = None
    workers: int | None = None
    pdf_extraction: ExtractionOptions = field(default_factory=ExtractionOptions)
    logging: Logging = field(default_factory=Logging)


def _merge(base, values: dict):
    known = {f.name for f in fields(base)}
    unknown = set(values) - known
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    fit = lambda old, new: _merge(old, new) if is_dataclass(old) else tuple(new) if isinstance(old, tuple) else new
    return replace(base, **{k: fit(getattr(base, k), v) for k, v in values.items()})


def load_config(path: str | Path | None = None) -> Config:
    """The defaults, with what the file sets laid over them, level by level. A missing file means the defaults."""
    if path is None or not Path(path).exists():
        return Config()
    return _merge(Config(), json.loads(Path(path).read_text(encoding="utf-8")))
