"""Settings, as values or from the environment."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from .functions.patterns import PII_TYPES

PREFIX = "TRACEGAUGE_"


@dataclass(frozen=True)
class Settings:
    evaluators: tuple[str, ...] = ("pii_detection", "secret_detection")
    sample_rates: Mapping[str, float] = field(default_factory=dict)
    exceptions: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    association_exclude: tuple[str, ...] = ("correlation_id",)
    pii_types: tuple[str, ...] = PII_TYPES
    service_name: str | None = None
    dedup_ttl_s: int = 600
    timeout_s: float = 5.0
    max_request_bytes: int = 16 << 20
    emit_spans: bool = True
    judge_redact: bool = True
    judge_concurrency: int = 8
    metrics_window_s: int = 60

    def __post_init__(self):
        if unknown := set(self.pii_types) - set(PII_TYPES):
            raise ValueError(f"unknown PII types: {', '.join(sorted(unknown))}")
        if bad := [k for k, r in self.sample_rates.items() if not 0 <= r <= 1]:
            raise ValueError(f"sample rates must lie in 0..1: {', '.join(bad)}")

    def rate(self, name: str, default: float) -> float:
        return self.sample_rates.get(name, default)

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Settings:
        """Lists are split at commas; sample rates are `a=0.1,b=0.5` or JSON; exceptions are JSON, service to names."""
        out = {}
        for f in fields(cls):
            if (raw := env.get(PREFIX + f.name.upper())) is None:
                continue
            if f.name == "sample_rates":
                pairs = json.loads(raw) if raw.lstrip().startswith("{") else dict(x.split("=", 1) for x in raw.split(",") if x.strip())
                out[f.name] = {k.strip(): float(v) for k, v in pairs.items()}
            elif f.name == "exceptions":
                out[f.name] = {k: tuple(v) for k, v in json.loads(raw).items()}
            elif str(f.type).startswith("tuple"):
                out[f.name] = tuple(x.strip() for x in raw.split(",") if x.strip())
            elif f.type == "bool":
                out[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
            else:
                out[f.name] = {"int": int, "float": float}.get(str(f.type), str)(raw)
        return cls(**out)
