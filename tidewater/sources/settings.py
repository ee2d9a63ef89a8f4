"""Settings from KEY=VALUE files and the environment."""

from __future__ import annotations

import os
from collections.abc import Iterable


def parse_settings(lines: Iterable[str]) -> dict[str, str]:
    """KEY=VALUE pairs; blank lines and # comments are left out, `export ` and quotes around a value are taken off."""
    out = {}
    for line in lines:
        line = line.strip().removeprefix("export ").strip()
        if line and not line.startswith("#") and "=" in line:
            key, _, value = line.partition("=")
            value = value.strip()
            out[key.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out


def load_settings(path: str, override: bool = False) -> dict[str, str]:
    """The pairs of a file put into the environment; what is set already stays, unless override."""
    with open(path) as f:
        found = parse_settings(f)
    for key, value in found.items():
        if override or key not in os.environ:
            os.environ[key] = value
    return found
