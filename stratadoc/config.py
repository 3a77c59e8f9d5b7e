"""Settings, resolved from the environment once."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    environment: str
    daily_limit: int
    rerank_floor: float
    hosts: tuple[str, ...]

    def host(self, partition: int) -> str:
        """The model host of a partition, in turn."""
        return self.hosts[partition % len(self.hosts)]


def load(env: Mapping[str, str] = os.environ) -> Config:
    """production for production and prod in any case, else development."""
    name = env.get("STRATADOC_ENV", "").strip().lower()
    hosts = tuple(h.strip().rstrip("/") for h in env.get("STRATADOC_MODEL_HOSTS", "http://localhost:11434").split(",") if h.strip())
    return Config(
        "production" if name in ("production", "prod") else "development", int(env.get("STRATADOC_DAILY_LIMIT", "20")), float(env.get("STRATADOC_RERANK_FLOOR", "0.1")), hosts or ("http://localhost:11434",)
    )
