"""Ingestion at fixed times of the day."""

from __future__ import annotations

import datetime as dt
import threading
from collections.abc import Callable

from postmill.plans.service import PostingService


def next_time(now: dt.datetime, every: dt.timedelta) -> dt.datetime:
    """The first multiple of ``every``, counted from the day's start, after now."""
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    return midnight + ((now - midnight) // every + 1) * every


class Schedule:
    """Runs an ingestion over the live boards every six hours (or other fraction of a day), and one at the start
    unless told not to. A time at which a run is still going on is passed over, and so is an error, which goes to
    ``failed``.
    """

    def __init__(self, service: PostingService, templates: dict[str, str], every: dt.timedelta = dt.timedelta(hours=6), at_start: bool = True, failed: Callable[[Exception], None] = print, now: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc)):
        self.service, self.templates, self.every, self.at_start, self.failed, self.now = service, templates, every, at_start, failed, now
        self._ended = threading.Event()
        self._thread = threading.Thread(target=self._work, daemon=True)

    def start(self) -> "Schedule":
        self._thread.start()
        return self

    def stop(self, timeout: float | None = None) -> None:
        """No further runs; waits for one that is going on."""
        self._ended.set()
        self._thread.join(timeout)

    def _run(self) -> None:
        try:
            self.service.ingest_boards(self.templates, self.now())
        except Exception as e:
            self.failed(e)

    def _work(self) -> None:
        if self.at_start:
            self._run()
        while not self._ended.wait((next_time(self.now(), self.every) - self.now()).total_seconds()):
            self._run()
