"""The package's logger. The application chooses handlers; `to_console` is a plain choice."""

from __future__ import annotations

import logging

logger = logging.getLogger("quernstone")


def to_console(level: int = logging.INFO) -> None:
    logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
