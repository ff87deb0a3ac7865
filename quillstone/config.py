"""Configuration: a JSON document with dotted lookup, and the scoring parameters read from it."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Scoring:
    """Weights of the pair score: ``alpha`` of the mean keyword similarity against the best one, ``a`` of
    the semantic against the keyword similarity, ``beta`` the penalty per shared tag."""

    # The default weights.
    alpha: float = 0.4
    a: float = 0.6
    beta: float = 0.25

    def __post_init__(self):
        for name in ("alpha", "a"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie between 0 and 1")
        if not 0 <= self.beta < 0.5:
            raise ValueError("beta must be at least 0 and below 0.5")


class Config:
    """Nested settings with ``get("section.key", default)``."""

    _shared: Config | None = None

    def __init__(self, values: dict[str, Any] | None = None):
        self.values = values or {}

    @classmethod
    def load(cls, path: str | Path) -> Config:
        path = Path(path)
        if not path.exists():
            raise FileNotFoundError(f"no configuration at {path}")
        return cls(json.loads(path.read_text(encoding="utf-8")))

    @classmethod
    def shared(cls, path: str | Path | None = None) -> Config:
        """One configuration per process; the first path wins."""
        if cls._shared is None:
            cls._shared = cls.load(path) if path else cls()
        return cls._shared

    def get(self, key: str, default: Any = None) -> Any:
        value: Any = self.values
        for part in key.split("."):
            if not isinstance(value, dict) or part not in value:
                return default
            value = value[part]
        return value

    def scoring(self) -> Scoring:
        return Scoring(**{f.name: float(self.get(f"recommender.{f.name}", f.default)) for f in fields(Scoring)})
