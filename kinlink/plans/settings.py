"""Service settings: command line over environment over file over defaults."""

from __future__ import annotations

import json
import logging
import logging.handlers
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    default_page_size: int = 25
    log_file: str = ""
    log_level: str = "INFO"
    log_files: int = 5
    log_bytes: int = 5 << 20
    mode: str = "int32"
    result_timeout_s: float = 15.0
    #: Settings of the two-party protocol are accepted and have no effect here.
    use_circuit_conversion: bool = False
    boolean_sharing: str = "yao"
    api_key: str = ""

    @classmethod
    def load(cls, path: str | None = None, env: Mapping[str, str] = os.environ, args: Mapping[str, object] | None = None, prefix: str = "KINLINK_") -> Settings:
        """Later sources win; unknown keys of a file are an error."""
        out, kinds = cls(), {f.name: f.type for f in fields(cls)}
        if path:
            with open(path) as f:
                given = {snake(k): v for k, v in json.load(f).items()}
            if unknown := set(given) - set(kinds):
                raise ValueError(f"unknown settings {sorted(unknown)}")
            out = replace(out, **{k: convert(kinds[k], v) for k, v in given.items()})
        from_env = {k: env[prefix + k.upper()] for k in kinds if prefix + k.upper() in env}
        out = replace(out, **{k: convert(kinds[k], v) for k, v in from_env.items()})
        return replace(out, **{k: convert(kinds[k], v) for k, v in (args or {}).items() if v is not None})


def snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def convert(kind: str, value: object) -> object:
    if kind == "bool":
        return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
    return {"int": int, "float": float, "str": str}[kind](value)


def authorized(settings: Settings, header: str | None) -> bool:
    """No key: everyone. Else the header must carry it."""
    return not settings.api_key or header == f'apiKey apiKey="{settings.api_key}"'


def set_up_logging(settings: Settings, component: str) -> logging.Logger:
    """One logger per component, to a rotating file where one is set."""
    log = logging.getLogger(f"kinlink.{component}")
    log.setLevel(settings.log_level)
    if settings.log_file and not log.handlers:
        handler = logging.handlers.RotatingFileHandler(settings.log_file, maxBytes=settings.log_bytes, backupCount=settings.log_files)
        handler.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
        log.addHandler(handler)
    return log
