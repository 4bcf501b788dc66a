"""Settings from YAML-like dictionaries or JSON files, overlaid by environment variables."""

from __future__ import annotations

import copy
import json
import os
from collections.abc import Mapping
from pathlib import Path
from typing import Any

DEFAULTS: dict[str, Any] = {
    "source": {"path": "", "batch_size": 5000, "fields": {"timestamp": "@timestamp", "message": "message", "level": "log_level", "service": "service_name"}},
    "vectors": {"path": "", "dimension": 1024, "batch_size": 100},
    "search": {"max_es_results": 50, "max_vector_results": 50, "rerank": 30, "top_k": 10, "max_results": 20},
    "dedup": {"similarity_threshold": 0.92, "novelty_threshold": 0.05, "time_window_hours": 24, "keep_latest_count": 3},
}
PREFIX = "LOG_AI_"


def coerced(text: str) -> Any:  # noqa: ANN401
    """true and yes, false and no, none and null, whole and decimal numbers, JSON lists and objects;
    else the text."""
    said = {"true": True, "yes": True, "false": False, "no": False, "none": None, "null": None}
    if text.lower() in said:
        return said[text.lower()]
    try:
        return json.loads(text)
    except ValueError:
        return text


class Config:
    def __init__(self, values: Mapping | None = None) -> None:
        self.values = copy.deepcopy(DEFAULTS)
        self.merge(values or {})

    @classmethod
    def load(cls, path: str | None = None, env: Mapping[str, str] | None = None) -> Config:
        """A JSON file (or YAML, where that library is there) under the environment's LOG_AI_A__B=value."""
        values: Mapping = {}
        if path:
            content = Path(path).read_text(encoding="utf-8")
            if path.endswith((".yml", ".yaml")):
                import yaml

                values = yaml.safe_load(content) or {}
            else:
                values = json.loads(content)
        config = cls(values)
        for name, value in (os.environ if env is None else env).items():
            if name.startswith(PREFIX):
                config.set(name[len(PREFIX) :].lower().replace("__", "."), coerced(value))
        return config

    def merge(self, values: Mapping, into: dict | None = None) -> None:
        into = self.values if into is None else into
        for k, v in values.items():
            if isinstance(v, Mapping) and isinstance(into.get(k), dict):
                self.merge(v, into[k])
            else:
                into[k] = v

    def get(self, path: str, default: Any = None) -> Any:  # noqa: ANN401
        at: Any = self.values
        for part in path.split("."):
            if not isinstance(at, Mapping) or part not in at:
                return default
            at = at[part]
        return at

    def set(self, path: str, value: Any) -> None:  # noqa: ANN401
        *parents, last = path.split(".")
        at = self.values
        for part in parents:
            if not isinstance(at.get(part), dict):
                at[part] = {}
            at = at[part]
        at[last] = value

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.values, indent=2, ensure_ascii=False, sort_keys=True), encoding="utf-8")
