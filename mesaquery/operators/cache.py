"""A small result cache for repeated questions: least recently used, with an age limit, keyed by the data's revision."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, Row


def revision(df: DataFrame) -> tuple:
    """What a result depends on besides its question: the plan and the files it reads; files are written once, so other data have other names."""
    return df.semanticHash(), tuple(sorted(df.inputFiles()))


class ResultCache:
    """Rows of small results by (question, revision). Threads that ask the same thing at once compute it once."""

    def __init__(self, most: int = 256, seconds: float = 300.0, most_rows: int = 1_000, clock: Callable[[], float] = time.monotonic) -> None:
        self.most, self.seconds, self.most_rows, self.clock = most, seconds, most_rows, clock
        self.rows: OrderedDict[tuple, tuple[float, list[Row]]] = OrderedDict()
        self.lock, self.running = threading.Lock(), {}
        self.computed = 0

    def get(self, question: tuple, data: DataFrame, compute: Callable[[], DataFrame]) -> list[Row]:
        """The rows of ``compute()``, at most ``most_rows`` of which are asked for: results here are ranked lists."""
        key = (question, revision(data))
        while True:
            with self.lock:
                found = self.rows.get(key)
                if found and self.clock() - found[0] <= self.seconds:
                    self.rows.move_to_end(key)
                    return found[1]
                waiting = self.running.get(key)
                if waiting is None:
                    mine = self.running[key] = threading.Event()
                    break
            waiting.wait()
        try:
            rows = compute().limit(self.most_rows).collect()
            with self.lock:
                self.rows[key] = (self.clock(), rows)
                self.rows.move_to_end(key)
                while len(self.rows) > self.most:
                    self.rows.popitem(last=False)
                self.computed += 1
            return rows
        finally:
            with self.lock:
                del self.running[key]
            mine.set()
