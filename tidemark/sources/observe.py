"""Counts of what callers did: calls, errors and seconds by method.

Reads return plans, so their seconds are planning; what executors do is in
Spark's own metrics.
"""

from __future__ import annotations

import functools
import threading
import time
import warnings
from collections import Counter
from collections.abc import Callable, Iterator


def watched(rows: Iterator, counters: Counter, seconds: float) -> Iterator:
    """``rows`` as they come; each wait of more than ``seconds`` for one counts in ``stalls`` and warns."""

    def stalled() -> None:
        counters["stalls"] += 1
        warnings.warn(f"no row for {seconds} s", RuntimeWarning, stacklevel=2)

    while True:
        timer = threading.Timer(seconds, stalled)
        timer.daemon = True
        timer.start()
        try:
            row = next(rows)
        except StopIteration:
            return
        finally:
            timer.cancel()
        yield row


def measured(method: Callable) -> Callable:
    """Counts a method's calls in its object's ``counters``."""
    name = method.__name__

    @functools.wraps(method)
    def run(self, *args, **kwargs):
        counters: Counter = self.counters
        counters[f"calls.{name}"] += 1
        began = time.perf_counter()
        try:
            return method(self, *args, **kwargs)
        except Exception:
            counters[f"errors.{name}"] += 1
            raise
        finally:
            counters[f"seconds.{name}"] += time.perf_counter() - began

    return run
