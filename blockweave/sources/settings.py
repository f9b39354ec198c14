"""Settings from the environment, with defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

PREFIX = "BLOCKWEAVE_"


@dataclass(frozen=True)
class Settings:
    """Each field can be set by a variable of its name in capitals, with the prefix."""

    debug: bool = False
    cache_enabled: bool = True
    cache_dir: str = "cache"
    cache_ttl_seconds: int = 86400
    cache_network_ttl_seconds: int = 604800
    cache_analysis_ttl_seconds: int = 86400
    cache_search_ttl_seconds: int = 3600

    @classmethod
    def from_environment(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        given = {}
        for f in fields(cls):
            text = env.get(PREFIX + f.name.upper())
            if text is not None:
                given[f.name] = text.strip().lower() in ("1", "true", "yes", "on") if isinstance(f.default, bool) else type(f.default)(text)
        return cls(**given)
