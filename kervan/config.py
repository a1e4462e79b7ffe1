"""Engine settings as one immutable value with checked bounds."""

from __future__ import annotations

import math
import os
from collections.abc import Mapping
from dataclasses import dataclass

_TRUE = frozenset({"1", "true", "yes", "on"})


def env_flag(env: Mapping[str, str], name: str, default: bool) -> bool:
    """1, true, yes or on (any case, padded) is true; anything else set is false; unset is the default."""
    raw = env.get(name)
    return default if raw is None else raw.strip().lower() in _TRUE


def env_number(env: Mapping[str, str], name: str, default, minimum, maximum=math.inf):
    """A number of the default's type within [minimum, maximum]; anything else raises ValueError."""
    raw = env.get(name)
    value = default if raw is None else type(default)(raw)
    if not (minimum <= value <= maximum):
        raise ValueError(f"{name} must lie in [{minimum}, {maximum}]")
    return value


@dataclass(frozen=True)
class EngineConfig:
    """Defaults and bounds are fixed values of the query semantics."""

    max_chunk_chars: int = 1200
    top_k: int = 5
    min_score: float = 0.35
    name_boost: float = 0.12
    max_question_chars: int = 1000
    temperature: float = 0.0
    max_answer_tokens: int = 600
    embedding_model: str = "leaflet-embed-2"
    chat_model: str = "stub-chat"
    app_name: str = "kervan"
    debug: bool = False

    def __post_init__(self) -> None:
        checks = (
            ("max_chunk_chars", self.max_chunk_chars, 100, math.inf),
            ("top_k", self.top_k, 1, math.inf),
            ("min_score", self.min_score, -1.0, 1.0),
            ("name_boost", self.name_boost, 0.0, 1.0),
            ("max_question_chars", self.max_question_chars, 100, math.inf),
            ("temperature", self.temperature, 0.0, 2.0),
            ("max_answer_tokens", self.max_answer_tokens, 1, math.inf),
        )
        for name, value, low, high in checks:
            if isinstance(value, bool) or not (low <= value <= high):
                raise ValueError(f"{name} must lie in [{low}, {high}]")

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> EngineConfig:
        env = os.environ if env is None else env
        return cls(
            max_chunk_chars=env_number(env, "MAX_CHUNK_CHARS", 1200, 100),
            top_k=env_number(env, "RETRIEVAL_TOP_K", 5, 1),
            min_score=env_number(env, "MINIMUM_SIMILARITY_SCORE", 0.35, -1.0, 1.0),
            name_boost=env_number(env, "MEDICINE_NAME_BOOST", 0.12, 0.0, 1.0),
            max_question_chars=env_number(env, "MAX_QUESTION_CHARS", 1000, 100),
            temperature=env_number(env, "CHAT_TEMPERATURE", 0.0, 0.0, 2.0),
            max_answer_tokens=env_number(env, "CHAT_MAX_TOKENS", 600, 1),
            embedding_model=env.get("EMBEDDING_MODEL_NAME", cls.embedding_model),
            debug=env_flag(env, "DEBUG", False),
        )
