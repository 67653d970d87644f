"""Logging for scripts; libraries only ask for loggers."""

from __future__ import annotations

import logging


def setup(level: int = logging.INFO, force: bool = False) -> None:
    """A handler on the root logger, with warnings captured; called from main functions only."""
    logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(name)s: %(message)s", force=force)
    logging.captureWarnings(True)
