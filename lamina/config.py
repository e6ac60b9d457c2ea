"""Settings of a store: defaults, then a JSON file, then the environment."""

from __future__ import annotations

import dataclasses
import json
import logging
import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


@dataclass
class StorageConfig:
    base_path: str = "./lamina_data"
    landing_path: str = "landing"
    warm_path: str = "warm"
    cold_path: str = "cold"
    logs_path: str = "logs"

    def path(self, part: str) -> str:
        """The full path of landing, warm, cold or logs."""
        return f"{self.base_path.rstrip('/')}/{getattr(self, part + '_path')}"


@dataclass
class HotConfig:
    max_records: int = 1_000_000
    eviction_threshold_pct: float = 0.9
    merge_rows: int = 25_000  # batches of fewer rows are merged once they hold so many together; 0: never


@dataclass
class WarmConfig:
    enabled: bool = True
    max_memory_mb: int = 4096
    eviction_threshold_pct: float = 0.85
    target_pct: float = 0.7  # what an eviction brings the tier down to
    aggressive_pct: float = 0.6  # the threshold when asked to make room early
    least_pct: float = 0.1  # what an eviction frees at least
    bytes_per_record: int = 64

    @property
    def max_records(self) -> int:
        return self.max_memory_mb * 1_048_576 // self.bytes_per_record


@dataclass
class ColdConfig:
    compression: str = "snappy"
    max_records_per_file: int = 200_000
    bloom_filter_columns: list[str] = field(default_factory=list)
    sort_columns: list[str] = field(default_factory=list)  # order within files; empty: by time


@dataclass
class QueryConfig:
    output_batch_size: int = 8192
    strict: bool = True


@dataclass
class SchemaConfig:
    time_column: str = "timestamp"


@dataclass
class LoggingConfig:
    level: str = "INFO"
    file: str | None = None  # a name without a folder is in storage.logs_path


@dataclass
class Config:
    storage: StorageConfig = field(default_factory=StorageConfig)
    hot_tier: HotConfig = field(default_factory=HotConfig)
    warm_tier: WarmConfig = field(default_factory=WarmConfig)
    cold_tier: ColdConfig = field(default_factory=ColdConfig)
    query: QueryConfig = field(default_factory=QueryConfig)
    schema: SchemaConfig = field(default_factory=SchemaConfig)
    logging: LoggingConfig = field(default_factory=LoggingConfig)

    def to_dict(self) -> dict[str, Any]:
        return dataclasses.asdict(self)

    def save(self, path: str | os.PathLike) -> None:
        Path(path).write_text(json.dumps(self.to_dict(), indent=2))


#: Environment variable -> (section, key, type).
ENVIRONMENT = {
    "LAMINA_STORAGE_PATH": ("storage", "base_path", str),
    "LAMINA_HOT_MAX_RECORDS": ("hot_tier", "max_records", int),
    "LAMINA_WARM_MAX_MB": ("warm_tier", "max_memory_mb", int),
    "LAMINA_LOG_LEVEL": ("logging", "level", str),
    "LAMINA_QUERY_BATCH_SIZE": ("query", "output_batch_size", int),
    "LAMINA_TIME_COLUMN": ("schema", "time_column", str),
    "LAMINA_STRICT": ("query", "strict", lambda v: v.lower() in ("1", "true", "yes")),
}


def load_config(path: str | os.PathLike | None = None, overrides: Mapping[str, Mapping[str, Any]] | None = None, environ: Mapping[str, str] | None = None) -> Config:
    """Later layers win: defaults, the JSON file, the environment, overrides. Unknown keys raise."""
    config = Config()
    layers: list[Mapping[str, Mapping[str, Any]]] = []
    if path is not None:
        layers.append(json.loads(Path(path).read_text()))
    given = os.environ if environ is None else environ
    from_environment: dict[str, dict[str, Any]] = {}
    for variable, (section, key, kind) in ENVIRONMENT.items():
        if variable in given:
            from_environment.setdefault(section, {})[key] = kind(given[variable])
    layers += [from_environment, overrides or {}]
    for layer in layers:
        for section, values in layer.items():
            if not hasattr(config, section):
                raise KeyError(f"unknown section {section!r}")
            target = getattr(config, section)
            for key, value in values.items():
                if key not in {f.name for f in dataclasses.fields(target)}:
                    raise KeyError(f"unknown setting {section}.{key}")
                setattr(target, key, value)
    return config


_shared: Config | None = None


def get_config(path: str | os.PathLike | None = None) -> Config:
    """The configuration of this process: loaded when first asked for, and again if a path is given."""
    global _shared
    if _shared is None or path is not None:
        _shared = load_config(path)
    return _shared


def reset_config() -> None:
    """The next get_config() loads anew."""
    global _shared
    _shared = None


def log_file(config: Config) -> Path | None:
    """Where the log is written; None if nowhere."""
    if not config.logging.file:
        return None
    file = Path(config.logging.file)
    return file if file.parent != Path(".") else Path(config.storage.path("logs")) / file


def set_level(level: str) -> None:
    logging.getLogger("lamina").setLevel(level.upper())


def logger(config: Config | None = None) -> logging.Logger:
    """The package's logger: warnings to the console, all of the level to the file if one is set."""
    log = logging.getLogger("lamina")
    if not any(getattr(h, "_lamina_console", False) for h in log.handlers):
        console = logging.StreamHandler()
        console.setLevel(logging.WARNING)
        console._lamina_console = True
        log.addHandler(console)
        log.propagate = False
    if config is not None:
        set_level(config.logging.level)
        file = log_file(config)
        if file and not any(isinstance(h, logging.FileHandler) and h.baseFilename == os.path.abspath(file) for h in log.handlers):
            file.parent.mkdir(parents=True, exist_ok=True)
            log.addHandler(logging.FileHandler(file))
    return log
