"""Settings, series and prompts from files; driver side."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .readers import read_series

# The keys of a settings file that the engine uses.
REQUIRED = ("SERIES_PATH", "N_CHUNKS", "REDIS_EXPIRE", "PROMPTS_PATH")


def load(path: str | Path) -> Any:
    """A JSON or YAML file; YAML needs its library."""
    text = Path(path).read_text()
    if str(path).endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ImportError(f"{path}: install PyYAML or give the file as JSON") from e
    return yaml.safe_load(text)


@dataclass
class Settings:
    values: dict[str, Any]
    prompts: dict[str, list[dict[str, str]]] = field(default_factory=dict)
    series: list[dict[str, Any]] = field(default_factory=list)

    @classmethod
    def of(cls, values: dict[str, Any], sparse: bool = False) -> Settings:
        """``sparse`` leaves series and prompts out. A ValueError lists the keys that are missing."""
        if missing := [k for k in REQUIRED if k not in values]:
            raise ValueError(f"settings lack: {', '.join(missing)}")
        if sparse:
            return cls(values)
        return cls(values, load(values["PROMPTS_PATH"]), load(values["SERIES_PATH"]))

    @classmethod
    def from_file(cls, path: str | Path, sparse: bool = False) -> Settings:
        return cls.of(load(path), sparse)

    @property
    def n_chunks(self) -> int:
        return int(self.values["N_CHUNKS"])

    @property
    def ttl_seconds(self) -> int:
        return int(self.values["REDIS_EXPIRE"])

    def series_frame(self, spark: SparkSession) -> DataFrame:
        return read_series(spark, self.series)

    def prompt(self, name: str) -> list[dict[str, str]]:
        """A prompt's messages; a KeyError for one that the file lacks."""
        return [{"role": m["role"], "content": m["prompt"]} for m in self.prompts[name]]
