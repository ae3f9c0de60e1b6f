"""Settings from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    """``PORT``, and ``PRESSWIRE_CHAT_HOST``, ``_MODEL``, ``_KEY`` and ``PRESSWIRE_TIMEOUT``. The key
    shows in no text of the settings."""

    port: int = 3000
    chat_host: str = "http://localhost:11434"
    chat_model: str = "gpt-oss:20b"
    chat_key: str = field(default="", repr=False)
    timeout: float = 30.0

    @classmethod
    def of(cls, env: Mapping[str, str] = os.environ) -> Settings:
        """Those that the environment gives; the others keep their defaults, as do empty ones."""
        names = {"port": "PORT", "chat_host": "PRESSWIRE_CHAT_HOST", "chat_model": "PRESSWIRE_CHAT_MODEL", "chat_key": "PRESSWIRE_CHAT_KEY", "timeout": "PRESSWIRE_TIMEOUT"}
        kinds = {"port": int, "timeout": float}
        return cls(**{k: kinds.get(k, str)(env[n]) for k, n in names.items() if env.get(n)})
