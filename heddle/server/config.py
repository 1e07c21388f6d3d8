"""Strict configuration: unknown keys are errors, ${VAR} is expanded in values, defaults and limits are checked."""

from __future__ import annotations

import os
import re
from typing import Any

import yaml

#: Known keys and their defaults. A dict default is a section, a type marks a required or free-form value.
SHAPE: dict[str, Any] = {
    "version": 1,
    "database": {
        "host": "127.0.0.1", "port": 4000, "user": "root", "password": "", "schema": "", "params": "", "max_open_conns": 10, "max_idle_conns": 5,
        "query_timeout_seconds": 30, "startup_wait_seconds": 0, "path": "", "catalog": "",
    },
    "server": {
        "host": "127.0.0.1", "port": 8080, "path": "/graphql", "graphiql": False, "debug": False, "max_query_depth": 15, "hot_reload": False, "reload_interval_seconds": 2,
        "cors": {"enabled": False, "allowed_origins": list},
    },
    "jwt": {
        "algorithm": "", "secret": "", "public_key_file": "", "issuer": "", "audience": "", "leeway_seconds": 0, "role_claim": "role", "anonymous_role": "",
        "role_lookup": {"table": "", "schema": "", "id_claim": "sub", "id_column": "id", "role_column": "role", "username_column": "username", "password_column": "password", "cache_seconds": 0},
    },
    "schema_gen": {"default_page_size": 25, "max_page_size": 200, "tables": {"include": list, "exclude": list}},
    "roles": dict,
    "hooks": {"tables": dict},
}
ALGORITHMS = tuple(f + n for f in ("HS", "RS", "ES") for n in ("256", "384", "512"))
RULE_KEYS = {"allow", "columns", "filter", "presets"}
EVENTS = {f"{w}_{op}" for w in ("before", "after") for op in ("insert", "update", "delete")}


class ConfigError(ValueError):
    pass


class _Loader(yaml.SafeLoader):
    """Doubled keys are errors."""

    def construct_mapping(self, node, deep=False):
        seen = set()
        for key, _ in node.value:
            name = self.construct_object(key, deep=True)
            if name in seen:
                raise ConfigError(f"key {name!r} appears twice")
            seen.add(name)
        return super().construct_mapping(node, deep)


def expanded(value: Any) -> Any:
    """Replace ${VAR} in parsed values, so that comments are never touched; an unset variable is an error."""
    if isinstance(value, str):

        def one(m: re.Match) -> str:
            if m[1] not in os.environ:
                raise ConfigError(f"environment variable {m[1]} is not set")
            return os.environ[m[1]]

        return re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}", one, value)
    if isinstance(value, dict):
        return {k: expanded(v) for k, v in value.items()}
    return [expanded(v) for v in value] if isinstance(value, list) else value


def _section(given: Any, shape: dict[str, Any], where: str) -> dict[str, Any]:
    given = {} if given is None else given
    if not isinstance(given, dict):
        raise ConfigError(f"{where or 'the configuration'} must be a mapping")
    if unknown := [k for k in given if k not in shape]:
        raise ConfigError(f"unknown key {where + '.' if where else ''}{unknown[0]}")
    out = {}
    for key, default in shape.items():
        value, name = given.get(key), f"{where}.{key}".lstrip(".")
        if isinstance(default, dict):
            out[key] = _section(value, default, name)
        elif isinstance(default, type):
            if value is not None and not isinstance(value, default):
                raise ConfigError(f"{name} must be a {default.__name__}")
            out[key] = value if value is not None else default()
        elif value is None or (value in ("", 0) and value is not False and default and key not in ("username_column", "password_column")):
            out[key] = default
        elif type(value) is not type(default):
            raise ConfigError(f"{name} must be a {type(default).__name__}")
        else:
            out[key] = value
    return out


def _roles(roles: dict[str, Any]) -> None:
    for role, rules in roles.items():
        if not isinstance(rules, dict) or set(rules) - {"tables"}:
            raise ConfigError(f"role {role!r} takes tables only")
        for table, ops in (rules.get("tables") or {}).items():
            if ops is None:
                continue
            if not isinstance(ops, dict) or set(ops) - {"select", "insert", "update", "delete"}:
                raise ConfigError(f"role {role!r}, table {table!r}: unknown operation")
            for op, rule in ops.items():
                if rule is not None and not isinstance(rule, bool | dict):
                    raise ConfigError(f"role {role!r}, table {table!r}, {op}: a boolean or a mapping is expected")
                if isinstance(rule, dict) and (unknown := set(rule) - RULE_KEYS):
                    raise ConfigError(f"role {role!r}, table {table!r}, {op}: unknown key {sorted(unknown)[0]!r}")


def parse(text: str) -> dict[str, Any]:
    """A checked configuration with defaults and environment overrides applied."""
    found = _section(expanded(yaml.load(text, _Loader) or {}), SHAPE, "")  # noqa: S506  a safe loader
    db, jwt, gen = found["database"], found["jwt"], found["schema_gen"]
    for key in ("host", "port", "user", "password", "schema", "path"):
        value = os.environ.get(f"HEDDLE_DB_{key.upper()}")
        if value or (value is not None and key == "password"):
            db[key] = int(value) if key == "port" else value
    if not db["schema"] and not db["path"]:
        raise ConfigError("database.schema or database.path is required")
    if jwt["algorithm"] not in ALGORITHMS:
        raise ConfigError(f"jwt.algorithm {jwt['algorithm']!r} is not one of {', '.join(ALGORITHMS)}")
    if jwt["algorithm"].startswith("HS"):
        if len(jwt["secret"].encode()) < 32:
            raise ConfigError("jwt.secret must have 32 bytes at least")
    elif not jwt["public_key_file"]:
        raise ConfigError(f"jwt.public_key_file is required for {jwt['algorithm']}")
    if not found["roles"]:
        raise ConfigError("at least one role must be defined")
    _roles(found["roles"])
    if jwt["anonymous_role"] and jwt["anonymous_role"] not in found["roles"]:
        raise ConfigError(f"jwt.anonymous_role {jwt['anonymous_role']!r} is not defined under roles")
    if gen["default_page_size"] > gen["max_page_size"]:
        raise ConfigError("schema_gen.default_page_size exceeds max_page_size")
    if jwt["role_lookup"]["cache_seconds"] < 0:
        raise ConfigError("jwt.role_lookup.cache_seconds must be >= 0")
    for table, events in found["hooks"]["tables"].items():
        if set(events or {}) - EVENTS:
            raise ConfigError(f"hooks of {table!r}: unknown event")
    return found
