"""Tunables with the environment's values above minimums, and what they lack."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 800
    chunk_overlap: int = 150
    min_chunk: int = 40
    min_table: int = 20
    boilerplate_pages: int = 3
    boilerplate_chars: int = 80
    line_check_chars: int = 15
    line_ratio: float = 0.3
    direct_chars: int = 30
    direct_ratio: float = 0.5
    top_k: int = 5
    pool: int = 30
    rrf_k: int = 60
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    max_input: int = 1000
    green: float = 0.85
    amber: float = 0.60
    cache_hours: float = 1.0


MINIMUMS = {"chunk_size": 1, "chunk_overlap": 0, "min_chunk": 1, "top_k": 1, "pool": 1, "rrf_k": 1, "cache_hours": 0.0}


def from_environment(prefix: str = "TARN_", environ=os.environ) -> Settings:
    """Settings overridden by variables like TARN_CHUNK_SIZE; values that don't parse are ignored, low ones raised."""
    found = {}
    for f in fields(Settings):
        raw = environ.get(prefix + f.name.upper())
        if raw is None or not raw.strip():
            continue
        try:
            value = type(f.default)(raw.strip())
        except ValueError:
            continue
        found[f.name] = max(MINIMUMS.get(f.name, value), value)
    return replace(Settings(), **found)


def problems(s: Settings) -> list[str]:
    """What is inconsistent in the settings; empty if nothing is."""
    out = []
    if s.chunk_overlap >= s.chunk_size:
        out.append("chunk_overlap must be below chunk_size")
    if not 0 <= s.amber <= s.green <= 1:
        out.append("0 <= amber <= green <= 1 must hold")
    if s.pool < s.top_k:
        out.append("pool must hold top_k rows")
    return out


def status(environ=os.environ, secrets: tuple[str, ...] = ("LLM_API_KEY", "WEATHER_API_KEY"), prefix: str = "TARN_") -> dict[str, bool]:
    """Which secrets are set, never their values."""
    return {k: bool(environ.get(prefix + k)) for k in secrets}
