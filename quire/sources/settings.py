"""Settings of the driver program: precedence, imported keys, and what may be logged."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass
from pathlib import Path

PLACEHOLDERS = ("", "changeme", "your-key-here", "sk-xxx", "none")


@dataclass(frozen=True)
class Service:
    """Where translations come from, and which source each setting came from."""

    base: str | None
    key: str | None
    model: str | None
    source: str


def _given(value: str | None) -> bool:
    return value is not None and value.strip().lower() not in PLACEHOLDERS


def load(path: str | None) -> dict:
    """Settings of a JSON file; a missing or broken file has none."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def import_keys(path: str) -> dict[str, str]:
    """base, key and model of the first enabled service with a real key in a TOML file, else of the first with one."""
    try:
        services = [v for v in tomllib.loads(Path(path).read_text(encoding="utf-8")).values() if isinstance(v, dict)]
    except (OSError, tomllib.TOMLDecodeError):
        return {}
    usable = [s for s in services if _given(s.get("key"))]
    best = next((s for s in usable if s.get("enabled")), usable[0] if usable else {})
    return {k: best[k] for k in ("base", "key", "model") if isinstance(best.get(k), str)}


def resolve(arguments: dict, environment: dict | None = None, file: dict | None = None, imported: dict | None = None) -> Service:
    """Each setting from the first that gives it: arguments, environment (QUIRE_BASE, QUIRE_KEY, QUIRE_MODEL), file, imported keys."""
    env = os.environ if environment is None else environment
    sources = [("arguments", arguments), ("environment", {k: env.get(f"QUIRE_{k.upper()}") for k in ("base", "key", "model")}), ("file", file or {}), ("imported", imported or {})]
    pick = lambda k: next(((name, s[k]) for name, s in sources if _given(s.get(k))), ("none", None))
    return Service(pick("base")[1], pick("key")[1], pick("model")[1], pick("key")[0])


def masked(command: list[str], secret_options: tuple[str, ...] = ("--api-key", "--key")) -> list[str]:
    """A command line for logs: values of secret options are hidden, in either form."""
    out, hide = [], False
    for part in command:
        name, eq, _ = part.partition("=")
        out.append("***" if hide else f"{name}=***" if eq and name in secret_options else part)
        hide = not hide and part in secret_options
    return out


def first_existing(*paths: str | None) -> str | None:
    """The first path that exists."""
    return next((p for p in paths if p and Path(p).exists()), None)


def doctor(required: tuple[str, ...] = ("pyspark", "pandas", "pyarrow", "numpy", "regex"), optional: tuple[str, ...] = ("tiktoken", "duckdb")) -> list[tuple[str, str, str]]:
    """(name, level, detail) of what a run needs: libraries with their versions, and Java."""
    from importlib import metadata, util
    from shutil import which

    rows = []
    for name, missing in [*((n, "FAIL") for n in required), *((n, "WARN") for n in optional)]:
        found = util.find_spec(name) is not None
        rows.append((name, "PASS" if found else missing, metadata.version(name) if found else "not installed"))
    java = which("java") or os.environ.get("JAVA_HOME")
    return [*rows, ("java", "PASS" if java else "FAIL", java or "not found")]
