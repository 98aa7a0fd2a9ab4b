"""Timers, numeric events and JSON log records without secrets."""

from __future__ import annotations

import json
import logging
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from folioflux.functions.text import CREDENTIAL

Hook = Callable[["Event"], None]


@dataclass(frozen=True)
class Event:
    name: str
    values: dict[str, float] = field(default_factory=dict)


def emit(hook: Hook | None, name: str, **values: float) -> None:
    """Tell a hook; what it raises is logged and goes no further."""
    if hook is None:
        return
    try:
        hook(Event(name, values))
    except Exception:  # noqa: BLE001
        logging.getLogger("folioflux").warning("an event hook failed")


class Timer:
    """Milliseconds spent in named parts."""

    def __init__(self, clock: Callable[[], float] = time.perf_counter):
        self.clock, self.parts, self._open = clock, {}, []

    def part(self, name: str) -> Timer:
        self._open.append((name, self.clock()))
        return self

    def __enter__(self) -> Timer:
        return self

    def __exit__(self, *_: object) -> None:
        name, begun = self._open.pop()
        self.parts[name] = self.parts.get(name, 0.0) + 1000 * (self.clock() - begun)


class JsonFormatter(logging.Formatter):
    """One JSON object a record; credentials are masked and traces left out."""

    def format(self, record: logging.LogRecord) -> str:
        message = re.sub(CREDENTIAL, "[REDACTED]", record.getMessage())
        return json.dumps({"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": message})
