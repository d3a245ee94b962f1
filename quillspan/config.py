"""Settings, each of which an environment variable of the same name in upper case with QUILLSPAN_ before it can change."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    target_volume: int = 0  #: keep passages of this volume only (0: all)
    chunk_target: int = 1200
    chunk_max: int = 1800
    chunk_min: int = 200
    top_dense: int = 30
    top_lexical: int = 30
    top_final: int = 8
    rrf_k: int = 60
    batch: int = 16
    provider: str = "stub"
    work: str = ""
    author: str = ""
    edition: str = ""

    @classmethod
    def from_env(cls) -> Settings:
        found = {f.name: os.environ.get(f"QUILLSPAN_{f.name.upper()}") for f in fields(cls)}
        return cls(**{f.name: type(f.default)(found[f.name]) for f in fields(cls) if found[f.name] is not None})


SETTINGS = Settings.from_env()
