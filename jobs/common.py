"""What the jobs share: settings, paths and the log."""

from __future__ import annotations

import json
import logging
import os
from typing import Any

log = logging.getLogger("foliant.jobs")


def config(job: str, path: str | None = None) -> dict[str, Any]:
    """The settings of a job from its own config file, with those of another file laid over them; unknown names are an error."""
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{job}.json")) as f:
        out = json.load(f)
    if path is not None:
        with open(path) as f:
            more = json.load(f)
        if unknown := set(more) - set(out):
            raise ValueError(f"unknown settings in {path}: {', '.join(sorted(unknown))}")
        out |= more
    return out


def whole_path(path: str) -> str:
    """A glob that matches `path` alone, since a file stream takes a folder or a glob, and a table may be one file."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/{{{name}}}" if folder else f"{{{name}}}"


def started() -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
