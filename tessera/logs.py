"""Logging to a file, the console, or both."""

from __future__ import annotations

import logging
import sys
import threading
from collections.abc import Callable

LOG = logging.getLogger("tessera")
_FORM = logging.Formatter("%(asctime)s [%(levelname)s] %(message)s", "%Y-%m-%d %H:%M:%S")


def set_up(file: str | None = None, level: str = "INFO", console: bool = True) -> logging.Logger:
    """Log from that level up; what was set up before is replaced.  A file that can't be opened is done without."""
    for h in list(LOG.handlers):
        LOG.removeHandler(h)
        h.close()
    LOG.propagate = False
    LOG.setLevel({"WARN": "WARNING"}.get(level.upper(), level.upper()))
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stdout)] if console else []
    try:
        handlers += [logging.FileHandler(file)] if file else []
    except OSError:
        pass
    for h in handlers:
        h.setFormatter(_FORM)
        LOG.addHandler(h)
    return LOG


class Periodic:
    """Logs a report every so many seconds, from a thread of its own, until it is stopped."""

    def __init__(self, report: Callable[[], str], seconds: float = 30.0) -> None:
        self._report, self._seconds, self._end = report, seconds, threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        while not self._end.wait(self._seconds):
            LOG.info("METRICS:\n%s", self._report())

    def start(self) -> Periodic:
        if not self._thread.is_alive():
            self._thread.start()
        return self

    def stop(self) -> None:
        self._end.set()
        if self._thread.is_alive():
            self._thread.join()
