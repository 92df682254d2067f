"""Settings from JSON files."""

from __future__ import annotations

import json
import os
import warnings

from ..plans.config import IGNORED, INCLUDED, Config

NAMES = (".codewhiffrc", ".codewhiffrc.json", "codewhiff.config.json")


def load_config(path: str | None = None, folder: str = ".", names: tuple[str, ...] = NAMES) -> Config:
    """The first readable one of some files, or of ``path`` alone: ``rules`` as they are, ``ignore`` added to the standard ones, ``include`` in
    their place. Without any, the standard settings."""
    for at in [path] if path else [os.path.join(folder, n) for n in names]:
        if not os.path.exists(at):
            continue
        try:
            with open(at, encoding="utf-8") as f:
                given = json.load(f)
        except (OSError, ValueError):
            warnings.warn(f"{at} can't be read as JSON; it is passed by", stacklevel=2)
            continue
        if isinstance(given, list):
            return Config()
        if not isinstance(given, dict):
            continue
        rules, ignore, include = (given.get(k) for k in ("rules", "ignore", "include"))
        return Config(rules if isinstance(rules, dict) else {}, IGNORED + tuple(ignore if isinstance(ignore, list) else ()), tuple(include) if isinstance(include, list) else INCLUDED)
    return Config()


def with_ignored(config: Config, *patterns: str) -> Config:
    return Config(config.rules, (*config.ignore, *patterns), config.include)
