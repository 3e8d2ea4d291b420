"""Settings, checked once on the driver."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields
from typing import ClassVar


def read_env_file(path: str) -> dict[str, str]:
    """KEY=VALUE lines; blank lines, comments and quotes around values are dropped."""
    out: dict[str, str] = {}
    if not os.path.exists(path):
        return out
    with open(path, encoding="utf-8") as f:
        for line in map(str.strip, f):
            if line and not line.startswith("#") and "=" in line:
                key, _, value = line.partition("=")
                out[key.strip()] = value.strip().strip("\"'")
    return out


def _bool(text: str) -> bool:
    low = text.strip().lower()
    if low in ("1", "true", "yes", "on"):
        return True
    if low in ("0", "false", "no", "off"):
        return False
    raise ValueError(text)


def read(env: Mapping[str, str], key: str, default, kind: Callable = str, least=None, choices=None):
    """The typed value of a key; a missing or bad one is the default, a small one is raised to ``least``."""
    try:
        value = kind(env[key])
    except (KeyError, ValueError):
        return default
    if choices is not None and value not in choices:
        return default
    return value if least is None else max(least, value)


@dataclass(frozen=True)
class Settings:
    sample_fps: float = 4.0
    max_samples_per_scene: int = 120
    scene_similarity: float = 0.68
    scene_margin: float = 0.03
    video_similarity: float = 0.74
    video_margin: float = 0.03
    embedding_dim: int = 512
    max_entities: int = 8
    max_events: int = 8
    max_keyframes: int = 3
    label_threshold: int = 4
    max_attempts: int = 3
    backoff_base: int = 5
    backoff_multiplier: int = 2
    backoff_max: int = 300
    lease_seconds: int = 120
    poll_seconds: float = 2.0
    url_ttl: int = 3600
    retention_hours: int = 24
    failure_policy: str = field(default="fail_job")
    scene_pipeline: bool = False
    identity_pipeline: bool = False
    corpus_pipeline: bool = False
    corpus_ingest: bool = False
    execution_mode: str = "in_process"
    identity_model: str = "default"
    embedding_model: str = ""
    task_log: str = ""

    #: The least value of each number, and what text settings may be.
    LEAST: ClassVar = {"max_samples_per_scene": 1, "embedding_dim": 16, "max_entities": 1, "max_events": 1, "max_keyframes": 0, "label_threshold": 1, "max_attempts": 1, "backoff_base": 1, "backoff_multiplier": 1, "backoff_max": 1, "lease_seconds": 1, "url_ttl": 1, "retention_hours": 1}
    CHOICES: ClassVar = {"failure_policy": ("fail_job", "fallback_empty"), "execution_mode": ("in_process", "queue")}

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None, env_file: str | None = None, prefix: str = "FRAMELAKE_") -> Settings:
        """From a file, overridden by the environment."""
        known = (read_env_file(env_file) if env_file else {}) | dict(os.environ if env is None else env)
        kinds = {"int": int, "float": float, "bool": _bool, "str": str}
        values = {f.name: read(known, prefix + f.name.upper(), f.default, kinds[str(f.type)], cls.LEAST.get(f.name), cls.CHOICES.get(f.name)) for f in fields(cls)}
        return cls(**values)


def missing(env: Mapping[str, str], required: tuple[str, ...]) -> list[str]:
    """Required keys that are absent or blank."""
    return [k for k in required if not env.get(k, "").strip()]


#: Models that may embed faces, by the names they go by.
MODELS = {"default": "fallback", "fallback": "fallback", "none": "fallback"}


def model_id(name: str, allowed: Mapping[str, str] = MODELS) -> str:
    key = name.strip().lower()
    if key not in allowed:
        raise ValueError(f"unknown identity model {name!r}; known: {', '.join(sorted(allowed))}")
    return allowed[key]


def identity_model(settings: Settings) -> str:
    """The model that embeds faces; an unknown name only matters where the pipeline is on."""
    try:
        return model_id(settings.identity_model)
    except ValueError:
        if settings.identity_pipeline:
            raise
        return MODELS["default"]


def queue_mode(settings: Settings) -> bool:
    """Whether scenes are left to workers that poll the task log."""
    return settings.scene_pipeline and settings.execution_mode == "queue"


#: What a store, a narrative client and an embedding client need from the environment.
STORE_KEYS = ("STORE_ACCOUNT", "STORE_BUCKET", "STORE_KEY_ID", "STORE_SECRET")
CLIENT_KEYS = ("CLIENT_KEY",)


def missing_settings(settings: Settings, env: Mapping[str, str]) -> dict[str, list[str]]:
    """What is missing for storage, narratives, embeddings and identities, as far as these are in use."""
    identities = []
    if settings.identity_pipeline:
        known = settings.identity_model.strip().lower() in MODELS
        identities = ["identity_model"] * (not known) + ["sample_fps"] * (settings.sample_fps < 1) + ["embedding_dim"] * (settings.embedding_dim < 16)
    model = settings.embedding_model.strip()
    return {
        "storage": missing(env, STORE_KEYS),
        "narratives": missing(env, CLIENT_KEYS) if settings.scene_pipeline else [],
        "embeddings": missing(env, CLIENT_KEYS) if model else ["embedding_model"],
        "identities": identities,
    }


def startup_warnings(settings: Settings, env: Mapping[str, str]) -> list[str]:
    """What won't work as it is configured; nothing here stops a start."""
    absent, said = missing_settings(settings, env), []
    if absent["storage"]:
        said.append(f"storage lacks {', '.join(absent['storage'])}: nothing can be stored or signed")
    if absent["narratives"]:
        said.append(f"narratives lack {', '.join(absent['narratives'])}: fallback texts are used")
    if absent["identities"]:
        said.append(f"identities lack {', '.join(absent['identities'])}: faces may not be followed")
    if settings.corpus_ingest:
        said.append("corpus ingest is ignored" if settings.corpus_pipeline else "corpus ingest is ignored, and no corpus is built")
    if queue_mode(settings) and not settings.task_log.strip():
        said.append("queue mode without a task log: no scene will be taken")
    return said
