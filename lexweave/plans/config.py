"""Configuration: defaults, TOML, discovery."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from lexweave.operators.reports import QualityGates
from lexweave.schema import REPORT_TYPES
from lexweave.sources.sinks import EXPORTERS

SECTION = "lexweave"
STAGES = ("extract", "normalize", "verify", "report")
EXTRACTORS = ("rule", "cvalue")
FUZZY_DEFAULTS = {"threshold": 85, "limit": 3, "scorer": "token_sort_ratio"}


class ConfigError(ValueError):
    """The configuration can't be used."""


@dataclass
class Config:
    output_dir: str = "reports/"
    quality_gates: QualityGates = field(default_factory=QualityGates)
    extractors: list[str] = field(default_factory=lambda: list(EXTRACTORS))
    rules: dict[str, Any] = field(default_factory=dict)
    cvalue: dict[str, Any] = field(default_factory=lambda: {"threshold": 0.25, "min_freq": 1, "min_length": 2, "max_length": 4, "use_ling_filter": True})
    source: str | None = None
    verifier: str = "exact"
    fuzzy: dict[str, Any] = field(default_factory=dict)
    include: list[str] = field(default_factory=lambda: ["verification", "quality_gate", "ontology_update"])
    exporters: list[str] = field(default_factory=lambda: ["json"])
    stages: list[str] = field(default_factory=lambda: list(STAGES))
    log_level: str = "WARNING"
    log_file: str | None = None

    def fuzzy_params(self) -> dict[str, Any]:
        return FUZZY_DEFAULTS | self.fuzzy

    def check(self) -> None:
        for what, given, known in (("stage", self.stages, STAGES), ("extractor", self.extractors, EXTRACTORS), ("report", self.include, REPORT_TYPES), ("exporter", self.exporters, EXPORTERS)):
            if unknown := [x for x in given if x not in known]:
                raise ConfigError(f"unknown {what}: {', '.join(unknown)}")
        if not self.stages:
            raise ConfigError("no stages")
        if self.verifier not in ("exact", "fuzzy"):
            raise ConfigError(f"unknown verifier: {self.verifier}")
        if self.source and not Path(self.source).exists():
            raise ConfigError(f"no such source: {self.source}")


def _plain(x):
    """Keys with underscores, however they were written."""
    return {k.replace("-", "_"): _plain(v) for k, v in x.items()} if isinstance(x, dict) else x


def from_dict(raw: dict[str, Any]) -> Config:
    raw, c = _plain(raw), Config()
    for group in ("extraction", "verifier", "reports", "pipeline", "logging"):
        part = raw.pop(group, {})
        if group == "verifier" and isinstance(part, dict):
            part = {{"type": "verifier", "fuzzy_params": "fuzzy"}.get(k, k): v for k, v in part.items()}
        if group == "logging":
            part = {{"level": "log_level"}.get(k, k): v for k, v in part.items()}
        raw |= part if isinstance(part, dict) else {group: part}
    known = {f.name for f in fields(Config)}
    for k, v in raw.items():
        if k == "quality_gates":
            names = {f.name for f in fields(QualityGates)}
            if bad := v.keys() - names:
                raise ConfigError(f"unknown quality gates: {', '.join(sorted(bad))}")
            c.quality_gates = QualityGates(**v)
        elif k in ("cvalue", "rules", "fuzzy"):
            setattr(c, k, getattr(c, k) | v)
        elif k == "exact":
            continue
        elif k in known:
            setattr(c, k, v)
        else:
            raise ConfigError(f"unknown setting: {k}")
    return c


def load(path: str | Path, section: str = SECTION) -> Config:
    try:
        raw = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise ConfigError(f"can't read {path}: {e}") from e
    found = raw.get("tool", {}).get(section) or raw.get(section)
    if found is None:
        raise ConfigError(f"no section [{section}] or [tool.{section}] in {path}")
    return from_dict(found)


def discover(explicit: str | None = None, start: Path | None = None, section: str = SECTION) -> Config:
    """The file given, else the nearest pyproject.toml with the section, else the user's file, else the defaults."""
    if explicit:
        return load(explicit, section)
    here = (start or Path.cwd()).resolve()
    for folder in (here, *here.parents):
        p = folder / "pyproject.toml"
        if p.exists():
            try:
                return load(p, section)
            except ConfigError as e:
                if "no section" not in str(e):
                    raise
    home = Path.home()
    places = [Path(os.environ[k]) / section / "config.toml" for k in ("XDG_CONFIG_HOME", "APPDATA") if os.environ.get(k)]
    for p in (*places[:1], home / ".config" / section / "config.toml", *places[1:], home / f".{section}" / "config.toml"):
        if p.exists():
            return load(p, section)
    return Config()
