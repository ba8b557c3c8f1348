"""Configuration as small tables: rules, backends and limits, from a YAML file or a mapping."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from trafficlens.functions.scalars import duration_ns

RULES_SCHEMA = (
    "path string, key_query array<string>, key_headers array<string>, value_headers array<string>, "
    "refresh_present boolean, refresh_enabled boolean, ttl_ns bigint, beta double, coefficient double"
)
BACKENDS_SCHEMA = (
    "id string, enabled boolean, scheme string, host string, rate int, timeout_ns bigint, max_timeout_ns bigint, "
    "use_max_timeout_header string, healthcheck string"
)


@dataclass(frozen=True)
class Config:
    """Settings of one cache."""

    rules: list[tuple] = field(default_factory=list)
    backends: list[tuple] = field(default_factory=list)
    env: str = "dev"
    enabled: bool = True
    storage_bytes: int = 0
    eviction_threshold: float = 0.95
    ttl_ns: int = 24 * 3600 * 10**9
    beta: float = 0.4
    coefficient: float = 0.5
    refresh_rate: int = 8
    scan_rate: int = 10_000
    max_versions: int = 3

    def rules_frame(self, spark: SparkSession) -> DataFrame:
        """One row for each rule. Rules are configuration, so this is small by nature."""
        return spark.createDataFrame(self.rules, RULES_SCHEMA)

    def backends_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.backends, BACKENDS_SCHEMA)

    def is_env(self, name: str) -> bool:
        return self.env == name


def _ns(value: Any) -> int:
    return duration_ns(value) if isinstance(value, str) and value else 0


def from_mapping(tree: Mapping[str, Any]) -> Config:
    """A Config from the tree of a configuration file. A cluster or a backend must be given, and ids be unique."""
    cache = tree["cache"]
    upstream = cache.get("upstream") or {}
    nodes = (upstream.get("cluster") or {}).get("backends") or ([upstream["backend"]] if upstream.get("backend") else [])
    if not nodes:
        raise ValueError("neither a cluster nor a backend is configured")
    rules = []
    for path, rule in (cache.get("rules") or {}).items():
        rule = rule or {}
        key, value, refresh = rule.get("cache_key") or {}, rule.get("cache_value") or {}, rule.get("refresh")
        own = refresh or {}
        rules.append((
            path, list(key.get("query") or []), list(key.get("headers") or []), list(value.get("headers") or []),
            refresh is not None, bool(own.get("enabled", False)), _ns(own.get("ttl")), float(own.get("beta") or 0), float(own.get("coefficient") or 0),
        ))
    backends = [
        (n["id"], bool(n.get("enabled")), n.get("scheme"), n.get("host"), int(n.get("rate") or 0), _ns(n.get("timeout")), _ns(n.get("max_timeout")), n.get("use_max_timeout_header"), n.get("healthcheck"))
        for n in nodes
    ]
    seen = [b[0] for b in backends if b[1]]
    if len(seen) != len(set(seen)):
        raise ValueError("two backends have the same id")
    if sum(b[4] for b in backends) <= 0:
        raise ValueError("the backends' rates sum up to nothing")
    refresh, dump = cache.get("refresh") or {}, (cache.get("data") or {}).get("dump") or {}
    return Config(
        rules, backends, cache.get("env", "dev"), bool(cache.get("enabled", True)), int((cache.get("storage") or {}).get("size", 0)),
        float((cache.get("eviction") or {}).get("threshold", 0.95)), _ns(refresh.get("ttl", "24h")), float(refresh.get("beta", 0.4)),
        float(refresh.get("coefficient", 0.5)), int(refresh.get("rate", 8)), int(refresh.get("scan_rate", 10_000)), int(dump.get("max_versions", 3)),
    )


def load_config(path: str) -> Config:
    """A Config from a YAML file."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs PyYAML; pass the tree to from_mapping instead") from e
    with open(path) as f:
        return from_mapping(yaml.safe_load(f))


#: The configuration that the registered queries use over the `events` table.
EVENTS_CONFIG = from_mapping({
    "cache": {
        "env": "dev", "enabled": True,
        "upstream": {"cluster": {"backends": [
            {"id": f"b{i}", "enabled": i < 3, "scheme": "http", "host": f"localhost:{8080 + i}", "rate": rate, "timeout": "5s", "max_timeout": "3m"}
            for i, rate in enumerate((5, 3, 8, 150))
        ]}},
        "data": {"dump": {"max_versions": 3}},
        "storage": {"size": 34359738368}, "eviction": {"threshold": 0.95},
        "refresh": {"enabled": True, "ttl": "24h", "rate": 8, "scan_rate": 10000, "beta": 0.4, "coefficient": 0.5},
        "rules": {
            "/view": {"refresh": {"enabled": True, "ttl": "12h", "beta": 0.5, "coefficient": 0.25}, "cache_key": {"query": ["k"]}},
            "/click": {"refresh": {"enabled": False}, "cache_key": {"query": ["k"]}},
            "/error": {"refresh": {"enabled": True, "beta": 0.9}, "cache_key": {"query": ["k"]}},
        },
    }
})
