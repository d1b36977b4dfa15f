"""Logging to the console and, if a folder is given, to a file."""

from __future__ import annotations

import logging
from pathlib import Path


def logger(name: str, folder: str | None = None) -> logging.Logger:
    """The logger of a name at level INFO; a second call returns it as it is."""
    log = logging.getLogger(f"tessera.{name}")
    if log.handlers:
        return log
    log.setLevel(logging.INFO)
    log.propagate = False
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if folder:
        Path(folder).mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(Path(folder) / f"{name}.log", encoding="utf-8"))
    for handler in handlers:
        handler.setFormatter(logging.Formatter("%(asctime)s | %(levelname)s | %(message)s"))
        log.addHandler(handler)
    return log
