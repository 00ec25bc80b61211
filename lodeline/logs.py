"""Messages of the driver to a file and to standard output."""

from __future__ import annotations

import logging
import sys
from pathlib import Path


def to_file(folder: str, name: str, level: int = logging.INFO) -> Path:
    """Send the messages of the root logger to folder/name.log, from DEBUG on, and from `level` on to standard output; the file's path."""
    path = Path(folder, f"{name}.log")
    path.parent.mkdir(parents=True, exist_ok=True)
    own = [(logging.FileHandler(path, encoding="utf-8"), logging.DEBUG), (logging.StreamHandler(sys.stdout), level)]
    root = logging.getLogger()
    root.setLevel(logging.DEBUG)
    for handler, least in own:
        handler.setLevel(least)
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        root.addHandler(handler)
    for noisy in ("py4j", "pyspark"):
        logging.getLogger(noisy).setLevel(logging.WARNING)
    return path
