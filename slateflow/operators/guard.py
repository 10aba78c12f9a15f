"""One action a deck at a time: actions run in threads of their own, their Spark jobs tagged with the deck and in the deck's pool."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class AlreadyRunning(RuntimeError):
    """A deck has an action that hasn't ended."""


class Guard:
    """Starts actions of decks; a second one of the same deck is refused while the first runs.

    The deck's name tags the Spark jobs of its action, by which ``cancel`` ends them, and names its pool: where the session was started with
    ``spark.scheduler.mode`` FAIR, a large deck doesn't hold up small ones. The guard holds within one driver.
    """

    def __init__(self, spark: SparkSession, on_failure: Callable[[str, Exception], None] | None = None):
        self.context, self.on_failure = spark.sparkContext, on_failure
        self._lock, self._running = threading.Lock(), {}

    def start(self, deck: str, action: Callable[[], None]) -> threading.Thread:
        """Run ``action`` beside the caller. What it raises goes to ``on_failure`` (deck, error), as a job's failure."""

        def run() -> None:
            self.context.addJobTag(self.tag(deck))
            self.context.setLocalProperty("spark.scheduler.pool", deck)
            try:
                action()
            except Exception as error:
                if self.on_failure:
                    self.on_failure(deck, error)
            finally:
                with self._lock:
                    self._running.pop(deck, None)

        with self._lock:
            if deck in self._running:
                raise AlreadyRunning(f"deck {deck} is being worked on")
            thread = self._running[deck] = InheritableThread(target=run, daemon=True)
            try:
                thread.start()
            except BaseException:
                del self._running[deck]
                raise
        return thread

    def running(self) -> list[str]:
        with self._lock:
            return sorted(self._running)

    def cancel(self, deck: str) -> bool:
        """End the Spark jobs of a deck's action, which fails by it; False if none runs."""
        with self._lock:
            if deck not in self._running:
                return False
        self.context.cancelJobsWithTag(self.tag(deck))
        return True

    @staticmethod
    def tag(deck: str) -> str:
        # a tag may not hold a comma
        return "deck-" + deck.replace("%", "%25").replace(",", "%2C")
