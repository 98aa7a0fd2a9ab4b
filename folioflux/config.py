"""Settings: defaults, then a project file, then its profile, then the environment, then arguments."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

from folioflux.errors import ConfigError

SECTION, PREFIX = "folioflux", "FOLIOFLUX_"
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


@dataclass(frozen=True)
class Settings:
    store: str = "folio-store"
    model: str = "hash-64"
    log_level: str = "WARNING"
    max_retries: int = 3
    retry_base_delay: float = 0.5
    chunk_tokens: int = 128
    chunk_overlap: int = 64

    def __post_init__(self):
        if self.log_level not in LEVELS:
            raise ConfigError("unknown log level", log_level=self.log_level)
        if not self.store or not self.model:
            raise ConfigError("store and model are needed")
        if self.max_retries < 0 or self.retry_base_delay <= 0:
            raise ConfigError("retries must be 0 or more and the delay positive")
        if not 0 <= self.chunk_overlap < self.chunk_tokens:
            raise ConfigError("the overlap must be smaller than a chunk")

    @classmethod
    def load(cls, project: str | Path | None = None, profile: str | None = None, environ: Mapping[str, str] | None = None, **given) -> Settings:
        kinds = {f.name: {"str": str, "int": int, "float": float}[f.type] for f in fields(cls)}
        found: dict = {}
        file = Path(project or ".") / "pyproject.toml"
        if file.exists():
            section = tomllib.loads(file.read_text()).get("tool", {}).get(SECTION, {})
            profiles = section.pop("profiles", {})
            if profile and profile not in profiles:
                raise ConfigError("unknown profile", profile=profile)
            found |= section | profiles.get(profile, {})
        env = os.environ if environ is None else environ
        found |= {k: env[PREFIX + k.upper()] for k in kinds if PREFIX + k.upper() in env}
        found |= {k: v for k, v in given.items() if v is not None}
        if unknown := set(found) - set(kinds):
            raise ConfigError("unknown settings", names=sorted(unknown))
        try:
            return cls(**{k: kinds[k](v) for k, v in found.items()})
        except (TypeError, ValueError) as e:
            raise e if isinstance(e, ConfigError) else ConfigError(f"a setting has the wrong type: {e}") from e


def load_dotenv(path: str | Path, environ: dict | None = None) -> int:
    """Set what a file of KEY=VALUE lines has and the environment lacks; how many were set."""
    env = os.environ if environ is None else environ
    n = 0
    for line in Path(path).read_text().splitlines():
        line = line.strip().removeprefix("export ")
        key, equals, value = line.partition("=")
        if equals and key.strip() and not line.startswith("#") and key.strip() not in env:
            env[key.strip()] = value.strip().strip("\"'")
            n += 1
    return n
