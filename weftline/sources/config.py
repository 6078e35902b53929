"""Settings of the engine: a mapping, or a YAML file where a YAML library is there."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass
class Settings:
    host: str = ""
    port: str = "8000"
    ssl_cert_file: str = ""
    ssl_key_file: str = ""
    batch_ttl_seconds: int = 2592000
    poll_interval: float = 5.0
    max_job_concurrency: int = 10
    page_size: int = 20
    duration_bounds: tuple[float, float, int] = field(default=(0.1, 2, 15))
    wait_bounds: tuple[float, float, int] = field(default=(0.1, 2, 10))

    @property
    def ssl(self) -> bool:
        return bool(self.ssl_cert_file and self.ssl_key_file)

    def check(self) -> None:
        """Raise for the first setting that cannot be used."""
        if not self.port:
            raise ValueError("port is empty")
        if bool(self.ssl_cert_file) != bool(self.ssl_key_file):
            raise ValueError("certificate and key go together")
        for name in (self.ssl_cert_file, self.ssl_key_file):
            if name and not Path(name).exists():
                raise FileNotFoundError(name)

    def spark_conf(self) -> dict[str, str]:
        return {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def settings(values: Mapping) -> Settings:
    """Settings over the defaults; a name that is not known is an error, not silently ignored."""
    known = {f.name for f in fields(Settings)}
    if unknown := set(values) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return Settings(**values)


def load(path: str) -> Settings:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs a YAML library") from e
    read = yaml.safe_load(Path(path).read_text())
    if not isinstance(read, Mapping):
        raise ValueError(f"{path} holds no mapping")
    return settings(read)


def require(clients: Mapping[str, object]) -> None:
    """Raise for the first client that is missing."""
    for name, client in clients.items():
        if client is None:
            raise ValueError(f"{name} is missing")
