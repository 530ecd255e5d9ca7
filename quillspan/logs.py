"""The driver's log: one rotating file, configured once."""

from __future__ import annotations

import logging
import os
from logging.handlers import RotatingFileHandler
from pathlib import Path

MOST_BYTES, KEPT = 5 * 1024 * 1024, 3
_OURS = "_quillspan"


def logger(name: str) -> logging.Logger:
    return logging.getLogger(f"quillspan.{name}")


def level_of(level: str | int | None) -> int:
    """A level by name or number; ``AUTOCOMPLETE_LOG_LEVEL`` or INFO if none is given."""
    if isinstance(level, int):
        return level
    name = (level or os.environ.get("AUTOCOMPLETE_LOG_LEVEL") or "INFO").upper()
    known = logging.getLevelNamesMapping()
    if name not in known:
        raise ValueError(f"Unknown log level: {name}")
    return known[name]


def configure(level: str | int | None = None, path: str | Path | None = None) -> Path:
    """Sends the root log to a file (``AUTOCOMPLETE_LOG_FILE`` or ``logs/app.log``) that starts anew at 5 MiB, three old ones
    kept. Called again it changes the level, and the file if another one is named; there is never a second handler."""
    to = Path(path or os.environ.get("AUTOCOMPLETE_LOG_FILE") or Path("logs") / "app.log").expanduser().resolve()
    number = level_of(level)
    root = logging.getLogger()
    mine = [h for h in root.handlers if getattr(h, _OURS, False)]
    for h in mine:
        if Path(h.baseFilename) != to:
            root.removeHandler(h)
            h.close()
            mine = []
    if not mine:
        to.parent.mkdir(parents=True, exist_ok=True)
        h = RotatingFileHandler(to, maxBytes=MOST_BYTES, backupCount=KEPT, encoding="utf-8")
        h.setFormatter(logging.Formatter("%(asctime)s | %(levelname)s | %(name)s | %(message)s", "%Y-%m-%d %H:%M:%S"))
        setattr(h, _OURS, True)
        root.addHandler(h)
        mine = [h]
    mine[0].setLevel(number)
    root.setLevel(min(root.level or number, number))
    return to
